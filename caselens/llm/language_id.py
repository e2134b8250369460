"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on a bounded
sample of labelled documents (by hashed doc_id; PIECES pieces of each). Every
language that has a labelled document with a letter is learned: the sample is
drawn for each one apart, and holds all documents of those below the quota.
Prediction reads every byte of every text, in segments of SEGMENT bytes
with a state of their own; every position gets a distribution over languages,
and a document's probabilities are the means over its positions.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text where nothing is labelled; documents without a language or a
doc_id teach nothing; rows repeated with doc_id are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import small_batches, unused
from ._text import slices, utf8

SEGMENT = 128
HIDDEN = 12
#: The bound of the training sample: documents in all, though up to LANGUAGE_DOCS of each language whatever their number; and pieces of SEGMENT bytes of each.
TRAIN_DOCS = 2000
LANGUAGE_DOCS = 100
PIECES = 6
UNKNOWN = "und"
_HASHES = 1 << 30

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass
class Network:
    """Both directions stacked: x-weights (2, 3H, 256), h-weights (2, 3H, H), outputs (2, L, H), bias (L). Gates: update, reset, candidate."""

    wx: np.ndarray
    wh: np.ndarray
    wo: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def arrays(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.wo, self.bias]


def start(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return Network(
        draw(2, 3 * hidden, 256, s=0.3), draw(2, 3 * hidden, hidden, s=hidden**-0.5), draw(2, len(languages), hidden, s=hidden**-0.5),
        np.zeros(len(languages), np.float32), languages,
    )


def _forward(net: Network, bytes_: np.ndarray, keep: bool = False):
    """bytes_: (T, B). Scores of each position (T, L, B); with keep, also what the backward pass needs."""
    steps, width = bytes_.shape
    hidden = net.wh.shape[2]
    h = np.zeros((2, hidden, width), np.float32)
    x, u = np.empty((2, 3 * hidden, width), np.float32), np.empty((2, 3 * hidden, width), np.float32)
    scores = np.zeros((steps, len(net.bias), width), np.float32)
    scores += net.bias[:, None]
    saved = []
    for t in range(steps):
        np.take(net.wx[0], bytes_[t], axis=1, out=x[0], mode="clip")
        np.take(net.wx[1], bytes_[steps - 1 - t], axis=1, out=x[1], mode="clip")
        np.matmul(net.wh, h, out=u)
        gates = x[:, : 2 * hidden] + u[:, : 2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        c = gates[:, hidden:] * u[:, 2 * hidden :]
        c += x[:, 2 * hidden :]
        np.tanh(c, out=c)
        if keep:
            saved.append((h, gates, c, u[:, 2 * hidden :].copy()))
            h = c + gates[:, :hidden] * (h - c)
        else:
            h -= c
            h *= gates[:, :hidden]
            h += c
        y = np.matmul(net.wo, h)
        scores[t] += y[0]
        scores[steps - 1 - t] += y[1]
        if keep:
            saved[-1] += (h,)
    return (scores, saved) if keep else scores


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _gradients(net: Network, bytes_: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Backpropagation through time of the mean cross-entropy over all positions that count."""
    steps, width = bytes_.shape
    hidden = net.wh.shape[2]
    scores, saved = _forward(net, bytes_, keep=True)
    p = _softmax(scores)
    total = mask.sum()
    loss = float(-(np.log(np.maximum(p[:, target, np.arange(width)], 1e-12)) * mask).sum() / total)
    d = p
    d[:, target, np.arange(width)] -= 1
    d *= (mask / total)[:, None, :]
    grads = [np.zeros_like(a) for a in net.arrays()]
    grads[3] += d.sum(axis=(0, 2))
    dh = np.zeros((2, hidden, width), np.float32)
    for t in range(steps - 1, -1, -1):
        before, gates, c, uc, h = saved[t]
        dy = np.stack([d[t], d[steps - 1 - t]])
        grads[2] += np.matmul(dy, h.transpose(0, 2, 1))
        dh = dh + np.matmul(net.wo.transpose(0, 2, 1), dy)
        z, r = gates[:, :hidden], gates[:, hidden:]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * z * (1 - z)
        dr = dc * uc * r * (1 - r)
        du = np.concatenate([dz, dr, dc * r], axis=1)
        dx = np.concatenate([dz, dr, dc], axis=1)
        grads[1] += np.matmul(du, before.transpose(0, 2, 1))
        for k, row in ((0, bytes_[t]), (1, bytes_[steps - 1 - t])):
            order = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(row[order]) != 0]))
            grads[0][k][:, row[order][first]] += np.add.reduceat(dx[k][:, order], first, axis=1)
        dh = dh * z + np.matmul(net.wh.transpose(0, 2, 1), du)
    return loss, grads


def train(
    segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 260, batch: int = 192,
    rate: float = 0.02, seed: int = 7,
) -> Network:
    """segments: (n, T) bytes, of which the first lengths[i] count; labels: index of the language. Adam, with a falling rate."""
    rng = np.random.default_rng(seed)
    net = start(languages, seed=seed)
    m, v = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))
    by_label = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for i in range(rounds):
        pick = np.concatenate([rng.choice(own, max(1, batch // len(languages))) for own in by_label])
        rows = segments[pick].T.astype(np.intp)
        mask = (np.arange(rows.shape[0])[:, None] < lengths[pick][None, :]).astype(np.float32)
        _, grads = _gradients(net, rows, mask, labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        step = rate * (1 - i / rounds) + 1e-4
        for a, g, m1, v1 in zip(net.arrays(), grads, m, v):
            g = g / max(1.0, norm)
            m1 += 0.1 * (g - m1)
            v1 += 0.01 * (g * g - v1)
            a -= (step * (m1 / (1 - 0.9 ** (i + 1))) / (np.sqrt(v1 / (1 - 0.99 ** (i + 1))) + 1e-8)).astype(np.float32)
    return net


def _cut(buf: np.ndarray, offsets: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments (n, T), lengths, text of each): all bytes of all texts."""
    sizes = np.diff(offsets)
    parts = -(-sizes // segment)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][owner] + number * segment
    lengths = np.minimum(segment, offsets[1:][owner] - begin)
    at = begin[:, None] + np.arange(segment)
    padded = np.concatenate([buf, np.zeros(segment, np.uint8)])
    rows = padded[np.minimum(at, len(padded) - 1)]
    rows[np.arange(segment)[None, :] >= lengths[:, None]] = 0
    return rows, lengths, owner


def predict(net: Network, buf: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT, width: int = 2048) -> np.ndarray:
    """Mean probabilities of the languages over all positions of each text: (texts, L); zeros for empty texts."""
    out = np.zeros((len(offsets) - 1, len(net.languages)))
    rows, lengths, owner = _cut(buf, offsets, segment)
    for a in range(0, len(rows), width):
        part, length = rows[a : a + width], lengths[a : a + width]
        p = _softmax(_forward(net, np.ascontiguousarray(part.T).astype(np.intp)))
        if (length < segment).any():
            p *= (np.arange(segment)[:, None] < length[None, :])[:, None, :]
        np.add.at(out, owner[a : a + width], p.sum(axis=0, dtype=np.float64).T)
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a letter of any alphabet."""
    upto = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])
    found = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def held_out() -> Column:
    """The documents from which nothing is learned."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def quota(counts: list[int], most: int) -> int:
    """The largest q at which min(q, n) of each language are ``most`` in all."""
    left = most
    for k, n in enumerate(sorted(counts)):
        share = left // (len(counts) - k)
        if n > share:
            return share
        left -= n
    return max(counts, default=0)


def _by_language(labelled: DataFrame, most: int) -> DataFrame:
    """labelled: lang, h, more. For each language about as many rows as its quota, those of the least h, and one at least."""
    found = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    each = max(quota([r.n for r in found], most), min(LANGUAGE_DOCS, most))
    cuts = [(r.lang, _HASHES if r.n <= each else max(int(_HASHES * (each / r.n)), r.least + 1)) for r in found]
    cuts = F.broadcast(labelled.sparkSession.createDataFrame(cuts, "lang string, cut bigint"))
    near = labelled.join(cuts, "lang").filter(F.col("h") < F.col("cut")).drop("cut")
    # Rows that share a doc_id share its hash, so there may be more.
    return near.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")),
    ).filter(F.col("rank") <= 2 * each).drop("rank")


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, pieces: int = PIECES) -> Network | None:
    """Train on a bounded sample of each language of the documents that are not held out; None without any."""
    text = F.regexp_extract("text", r"(?s)\p{L}.*", 0)  # from the first letter on, so a first piece always has one
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)).alias("h"), text.alias("text"))
    step = F.greatest(F.lit(1), F.floor(F.length("text") / pieces)).cast("int")
    starts = F.sequence(F.lit(0), F.least(F.lit(pieces), F.length("text")) - 1)
    cut = labelled.select("lang", "h", F.transform(starts, lambda k: F.col("text").substr(k * step + 1, F.lit(SEGMENT))).alias("pieces"))
    cut = _by_language(cut, train_docs).select("lang", F.explode("pieces"))
    rows = sorted((r[0], r[1].encode()[:SEGMENT]) for r in cut.collect() if any(c.isalpha() for c in r[1]))
    if not rows:
        return None
    languages = sorted({x for x, _ in rows})
    segments, lengths = np.zeros((len(rows), SEGMENT), np.uint8), np.array([len(raw) for _, raw in rows])
    for i, (_, raw) in enumerate(rows):
        segments[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    return train(segments, lengths, np.array([languages.index(x) for x, _ in rows]), languages)


def _label_columns(docs: DataFrame) -> tuple[str, str]:
    return unused("__lang", docs.columns), unused("__score", docs.columns)


def label(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with two more columns: the language and its score."""
    names = _label_columns(docs)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType())))])
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(net)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "text", 1 << 20):
            buf, offsets = utf8(batch.column("text"))
            langs, best = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if net is not None and len(buf):
                p = predict(net, buf, offsets)
                known = has_letter(buf, offsets)
                best = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
                langs = [net.languages[k] if x else UNKNOWN for k, x in zip(p.argmax(axis=1).tolist(), known)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(best, pa.float64())], names=[*batch.schema.names, *names],
            )

    return docs.mapInArrow(kernel, schema)


def language_id(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = label(docs.select("doc_id", "text"), learn(docs, train_docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_known(docs: DataFrame, least: float | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs, with all columns, less those whose language is unknown or has less than the least score.

    By default that is 1.1 times what a guess among the learned languages has: texts in several languages stay.
    """
    net = learn(docs, train_docs)
    if least is None:
        least = min(1.0, 1.1 / len(net.languages)) if net is not None and len(net.languages) > 1 else 0.0
    lang, score = _label_columns(docs)
    return label(docs, net).filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
