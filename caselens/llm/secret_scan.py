"""Secret scans: patterns, and a character convolutional network over every candidate.

Patterns find assignments, access keys and hexadecimal keys in whole texts. A
candidate is what a pattern has found (an assignment's value), and any other run
of at least CANDIDATE key characters that is not shaped like a word: one with a
digit, with both cases beyond its first letter, or of LONG characters. A small
convolutional network in numpy reads each one with the text around it, long ones
in overlapping windows of which the most probable counts.

It is trained on labelled findings, all of them, equal ones once:

* secrets: what the patterns found, as it stands; the same at another place of
  the text, so that not only the words before it tell; and keys drawn from its
  digest in other alphabets and lengths, since a corpus may hold one kind only;
* others: words of the texts, and what is shaped like a candidate without being
  a secret: compounds of words and numbers, groups of digits, numbered paths,
  and, where a tag before them says what they are, digests, identifiers and
  encoded text.

Each round takes one slice of the findings: tasks go on from the same weights,
over all rows they get, and their weights are averaged. A fifth that it has not
seen calibrates it (Platt, on counts of logits) and gives the highest threshold that keeps RECALL of the secrets there, however low that is. What the
patterns found stays whatever its probability; other candidates above the
threshold are added.

Offsets count code points, ends are exclusive. Edge cases: null texts are
empty; without labelled findings nothing is added; repeated rows and null
doc_ids are rows like others; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow, small_batches, stash
from ._text import slices

# The patterns that the task names.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "model")

CANDIDATE, LONG = 8, 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Equal to taking [0-9a-f]+ and AKIA[A-Z0-9]+ and dropping short matches: a run is matched whole or not at all.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")

#: Characters of a candidate in one window, and steps between the windows of a longer one: any STEP characters lie in one.
SPAN, STEP = 56, 28
#: Characters before the window's part of the candidate, and from its start on, that the network reads.
BEFORE, AFTER = 24, SPAN + 24
#: Rows that a task learns from at a time; slices of the findings, one a round; tasks of a round at most; examples to see, in repeated rows if need be.
CHUNK, SLICES, MOST_TASKS, LEAST_SEEN = 8192, 8, 64, 64_000
RECALL = 0.98

_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()), ("row_key", pa.int64()), ("base", pa.list_(pa.string())), ("kind", pa.string()), ("start", pa.int64()),
        ("stop", pa.int64()), ("window", pa.string()), ("size", pa.int32()),
    ]
)
_FOUND_DDL = "doc_id bigint, row_key bigint, base array<string>, kind string, start bigint, stop bigint, window string, size int"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, sorted; leftmost, not overlapping within a kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(*m.span(), "access") for m in _LONG_ACCESS.finditer(text)]  # a shorter run is consumed whole, so none starts within it
    found += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def window(text: str, start: int, size: int = SPAN) -> str:
    """BEFORE characters, size from start on, and as many after them as the network reads."""
    left = text[max(0, start - BEFORE) : start]
    return "\0" * (BEFORE - len(left)) + left + text[start : start + max(size, SPAN) + AFTER - SPAN]


def parts(text: str, size: int) -> Iterator[tuple[str, int]]:
    """Windows over a candidate, and what each has of it; text: as of window()."""
    for k in [0] if size <= SPAN else [*range(0, size - SPAN, STEP), size - SPAN]:
        yield text[k : k + BEFORE + AFTER], min(size, SPAN)


def is_candidate(run: str) -> bool:
    """Whether a run of key characters is shaped unlike a word."""
    if len(run) < CANDIDATE:
        return False
    if len(run) >= LONG or any(c.isdigit() for c in run):
        return True
    return any(c.isupper() for c in run[1:]) and any(c.islower() for c in run)


# --- labelled findings ------------------------------------------------------------------------

_WORD = re.compile(r"[A-Za-z]+")
_ALPHABETS = (
    string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_",
    string.ascii_letters + string.digits + "+/", "0123456789abcdef",
)
#: Tags that say what a run is: no secret.
_DIGEST_TAGS = ("sha256:", "md5 ", "commit ", "etag: ", "checksum ", "rev ")
_ID_TAGS = ("uuid ", "id: ", "order ", "doc/", "ref ", "case ")


def _drawn(seed: int, alphabet: str, size: int) -> str:
    """size characters of an alphabet, the same for a seed."""
    raw = hashlib.shake_128(seed.to_bytes(16, "little")).digest(size)
    return "".join(alphabet[x % len(alphabet)] for x in raw)


def recoded(value: str, seed: int) -> str:
    """A key of 16 to 47 characters of another alphabet, drawn from a finding's digest."""
    key = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8, salt=(seed % (1 << 64)).to_bytes(8, "little")).digest(), "little")
    return _drawn(key, _ALPHABETS[key % len(_ALPHABETS)], 16 + key // 7 % 32)


def compound(text: str, at: int, key: int) -> str:
    """Words that follow a place and a number, written as one: shaped like a candidate, but no secret; empty where there are too few."""
    words = _WORD.findall(text, at, at + 160)[: 3 + key % 5]
    number = str(key // 5 % 10 ** (1 + key // 7 % 4))
    mark = "-_/="[key // 11 % 3]
    if key // 13 % 4 == 0:
        words = [w.capitalize() for w in words]
        mark = ""
    words.insert(key // 17 % (len(words) + 1), number)
    run = mark.join(words)
    return run if len(words) > 2 and len(run) >= 16 else ""


def lookalike(text: str, at: int, key: int) -> tuple[str, str]:
    """(tag, run): digits, a digest, an identifier, encoded text, a short compound or odd capitals, none of them a secret."""
    kind, key = key % 7, key // 7
    hexes = _drawn(key, "0123456789abcdef" if key % 2 else "0123456789ABCDEF", 64)
    if kind == 0:
        digits = _drawn(key, string.digits, 8 + key % 12)
        return "", digits if key % 3 else f"{digits[:3]}-{digits[3:7]}-{digits[7:]}" if key % 2 else f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}"
    if kind == 1:
        return _DIGEST_TAGS[key % len(_DIGEST_TAGS)], hexes[: (32, 40, 64)[key // 7 % 3]]
    if kind == 2:
        return _ID_TAGS[key % len(_ID_TAGS)], "-".join(hexes[x:y] for x, y in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
    if kind == 3:
        return "base64,", base64.b64encode(text[at : at + 60].encode()).decode()[:56]
    words = _WORD.findall(text, at, at + 80)[:2] or ["item"]
    if kind == 6:
        long = max(words, key=len)
        return "", (long[:2].upper() + long[2:], long.upper(), long[:-1] + long[-1:].upper())[key % 3]
    number = str(key % 10 ** (1 + key // 7 % 6))
    run = f"{words[0]}{number}" if kind == 4 else f"{words[0].lower()}{words[-1].capitalize()}{number if key % 2 else ''}"
    return "", run


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its base spans; rows of findings (kind of a pattern), candidates, and for training alone: secrets, words."""
    for batch in slices(batches, "text"):
        out = {f.name: [] for f in _FOUND}

        def put(*row):
            for name, value in zip(out, row):
                out[name].append(value)

        def put_in_place(kind, left, run, right):
            left = left[-BEFORE:]
            put(doc_id, key, None, kind, None, None, window(left + run + right, len(left), len(run)), len(run))

        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            spans = base_spans(text)
            key = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
            draw = key & (1 << 62) - 1
            put(doc_id, key, [f"{k}:{a}:{b}" for a, b, k in spans], None, None, None, None, None)
            words = []
            for m in RUN.finditer(text):
                a, b = m.span()
                if any(x < b and a < y for x, y, _ in spans):
                    continue
                if is_candidate(m[0]):
                    put(doc_id, key, None, "candidate", a, b, window(text, a, b - a), b - a)
                else:
                    words.append((a, b))
            a, b = words[draw % len(words)] if words else (0, 0)
            left, right = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
            for i, (x, y, kind) in enumerate(spans):
                at = ASSIGN.match(text, x).start(2) if kind == "assign" else x
                value = text[at:y]
                put(doc_id, key, None, kind, x, y, window(text, at, y - at), y - at)
                put_in_place("secret", left, value, right)
                put_in_place("secret", text[max(0, at - BEFORE) : at], recoded(value, draw + i), text[y : y + AFTER])
                put_in_place("secret", left, recoded(value, draw - i - 1), right)
            if words:  # of each document a word, and in its place what only looks like a secret
                put(doc_id, key, None, "word", a, b, window(text, a), min(b - a, SPAN))
                if run := compound(text, a, draw):
                    put_in_place("word", left, run, right)
                for part in (draw, draw // 49):
                    tag, run = lookalike(text, a, part)
                    put_in_place("word", left + tag, run, right)
        yield arrow(None, _FOUND, **out)


# --- the network ------------------------------------------------------------------------------


@dataclass
class Network:
    """Embedding (128, E), convolution (C, width, E + 1), dense (2C), and Platt's slope, offset and the threshold."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.dense, self.bias]


def encode(windows: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(characters (n, BEFORE + AFTER), mask of the candidate); 127 stands for all beyond ASCII."""
    n = BEFORE + AFTER
    chars = np.zeros((len(windows), n), np.int64)
    for i, w in enumerate(windows):
        codes = np.frombuffer(w[:n].encode("utf-32-le", "replace"), "<u4")
        chars[i, : len(codes)] = np.minimum(codes, 127)
    at = np.arange(n)[None, :]
    return chars, ((at >= BEFORE) & (at < BEFORE + np.asarray(sizes)[:, None])).astype(np.float32)


def _forward(net: Network, chars: np.ndarray, mask: np.ndarray):
    width = net.conv.shape[1]
    x = np.concatenate([net.embed[chars], mask[:, :, None]], axis=2)
    cols = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2)
    n, steps = cols.shape[:2]
    cols = np.ascontiguousarray(cols).reshape(n * steps, -1)
    h = np.maximum((cols @ net.conv.reshape(len(net.conv), -1).T).reshape(n, steps, -1) + net.conv_bias, 0)
    inside = h * mask[:, width // 2 : width // 2 + steps, None]
    top, mean = h.argmax(axis=1), inside.sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
    pooled = np.concatenate([np.take_along_axis(h, top[:, None], axis=1)[:, 0], mean], axis=1)
    return pooled @ net.dense + net.bias[0], (cols, h, top, pooled)


def fresh(seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    e, c, width = 8, 24, 5
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return Network(
        draw(128, e, s=0.5), draw(c, width, e + 1, s=(width * e) ** -0.5), np.zeros(c, np.float32), draw(2 * c, s=0.2),
        np.zeros(1, np.float32),
    )


def _step(net: Network, m: list[np.ndarray], v: list[np.ndarray], i: int, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> None:
    """Backpropagation of one batch, and Adam's step number i."""
    c, width, e = net.conv.shape[0], net.conv.shape[1], net.conv.shape[2] - 1
    logit, (cols, h, top, pooled) = _forward(net, x, inside)
    d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    steps = h.shape[1]
    dpool = d[:, None] * net.dense
    dh = (dpool[:, c:] / np.maximum(inside.sum(axis=1), 1)[:, None])[:, None, :] * inside[:, width // 2 : width // 2 + steps, None]
    np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], axis=1) + dpool[:, None, :c], axis=1)
    dh = (dh * (h > 0)).reshape(-1, c)
    dcols = (dh @ net.conv.reshape(c, -1)).reshape(len(y), steps, width, e + 1)
    dx = np.zeros((len(y), x.shape[1], e), np.float32)
    for k in range(width):
        dx[:, k : k + steps] += dcols[:, :, k, :e]
    dembed = np.zeros_like(net.embed)
    np.add.at(dembed, x, dx)
    grads = [dembed, (dh.T @ cols).reshape(net.conv.shape), dh.sum(axis=0), pooled.T @ d, d.sum(keepdims=True)]
    for a, g, m1, v1 in zip(net.arrays(), grads, m, v):
        m1 += 0.1 * (g - m1)
        v1 += 0.01 * (g * g - v1)
        a -= 0.01 * (m1 / (1 - 0.9 ** (i + 1))) / (np.sqrt(v1 / (1 - 0.99 ** (i + 1))) + 1e-8)


def train(chars: np.ndarray, mask: np.ndarray, labels: np.ndarray, rounds: int = 500, batch: int = 128, seed: int = 5) -> Network:
    """Backpropagation with Adam on balanced batches of rows at hand; a fifth calibrates and sets the threshold."""
    rng = np.random.default_rng(seed)
    net = fresh(seed)
    apart = rng.random(len(labels)) < 0.2
    fit = [np.flatnonzero(~apart & (labels == k)) for k in (0, 1)]
    if not len(fit[0]) or not len(fit[1]):
        return net
    m, v = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))
    for i in range(rounds):
        pick = np.concatenate([rng.choice(own, batch // 2) for own in fit])
        _step(net, m, v, i, chars[pick], mask[pick], labels[pick])
    held = apart if (apart & (labels == 1)).any() and (apart & (labels == 0)).any() else np.ones(len(labels), bool)
    return calibrate(net, chars[held], mask[held], labels[held])


def platt(net: Network, logit: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """Slope and offset by Newton's method; weight: how many rows a logit stands for."""
    positives, negatives = weight[labels == 1].sum(), weight[labels == 0].sum()
    target = np.where(labels == 1, 1 - 1 / (positives + 2), 1 / (negatives + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = (p * (1 - p) + 1e-6) * weight
        g = np.array([((p - target) * weight * logit).sum(), ((p - target) * weight).sum()])
        hess = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    net.slope, net.offset = float(a), float(b)


def calibrate(net: Network, chars: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> Network:
    """Platt's scaling, then the highest threshold that keeps RECALL of the findings."""
    platt(net, _forward(net, chars, mask)[0].astype(np.float64), labels, np.ones(len(labels)))
    found = np.sort(probability(net, chars, mask)[labels == 1])
    if len(found):
        net.threshold = float(found[int((1 - RECALL) * len(found))])
    return net


def probability(net: Network, chars: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * _forward(net, chars, mask)[0].astype(np.float64) + net.offset, -30, 30)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chars, mask, labels) of CHUNK rows at a time, as they come."""
    rows = (r for b in batches for r in zip(b.column("window").to_pylist(), b.column("size").to_pylist(), b.column("label").to_pylist()))
    while some := list(islice(rows, CHUNK)):
        windows, sizes, labels = zip(*some)
        yield *encode(windows, [min(x, SPAN) for x in sizes]), np.array(labels)


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape).astype(np.float32) for part, a in zip(np.split(flat, cuts[:-1]), like)]


def _learn(batches: Iterator[pa.RecordBatch], start: np.ndarray, done: int, again: int, batch: int = 128) -> Iterator[pa.RecordBatch]:
    """The weights (with Adam's sums) after all rows of a task, from the round's start on; each row at least ``again`` times, labels balanced."""
    like = fresh().arrays()
    state = _shaped(start, like * 3)
    net, m, v = Network(*state[:5]), state[5:10], state[10:]
    n, i, half, rng = 0, done, batch // 2, np.random.default_rng(done)
    for chars, mask, labels in _chunks(batches):
        own = [k for k in (np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)) if len(k)]
        steps = again * -(-max(map(len, own)) // half)
        orders = [np.concatenate([rng.permutation(k) for _ in range(-(-steps * half // len(k)))]) for k in own]
        for s in range(steps):
            pick = np.concatenate([o[s * half : (s + 1) * half] for o in orders])
            _step(net, m, v, i, chars[pick], mask[pick], labels[pick])
            i += 1
        n += len(labels)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "steps": [i - done], "state": [_flat([*net.arrays(), *m, *v]).tolist()]}, schema=_LEARNED)


_LEARNED = pa.schema([("n", pa.int64()), ("steps", pa.int64()), ("state", pa.list_(pa.float64()))])


def _logits(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for chars, mask, labels in _chunks(batches):
        logit = np.concatenate([_forward(net, chars[k : k + 1024], mask[k : k + 1024])[0] for k in range(0, len(labels), 1024)])
        yield pa.RecordBatch.from_pydict({"label": labels.astype(np.int32), "logit": logit.astype(np.float64)})


def _calibrated(net: Network, held: DataFrame) -> Network:
    """calibrate() over a table: Platt's scaling on counts of logits in steps of 1/1000, the threshold as the exact row of its rank."""
    scored = stash(held.mapInArrow(lambda it: _logits(it, net), "label int, logit double").withColumn("bin", F.floor(F.col("logit") * 1000)))
    bins = sorted(tuple(r) for r in scored.groupBy("bin", "label").agg(F.count("*").alias("n"), F.avg("logit").alias("at")).collect())
    _, labels, counts, at = (np.array(x) for x in zip(*bins))
    platt(net, at.astype(float), labels, counts.astype(float))
    found = [(k, n) for k, label, n, _ in bins if label == 1]
    rank, up = int((1 - RECALL) * sum(n for _, n in found)), net.slope >= 0
    for k, n in found if up else found[::-1]:
        if rank < n:
            order = F.col("logit") if up else F.col("logit").desc()
            logit = scored.filter((F.col("label") == 1) & (F.col("bin") == k)).orderBy(order).offset(rank).limit(1).first()["logit"]
            net.threshold = float(1 / (1 + np.exp(-np.clip(net.slope * logit + net.offset, -30, 30))))
            break
        rank -= n
    return net


def train_on(findings: DataFrame) -> Network | None:
    """findings: window, size, label (1: secret). A network that has learned from four fifths of them and is calibrated on the rest; equal ones count once."""
    h = F.xxhash64("window", "size", "label")
    place = lambda salt, n: F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(n))
    known = findings.filter(F.col("label").isin(0, 1)).select("window", "size", "label").distinct()
    rows = stash(known.withColumns({"h": h, "held": place(1, 5) == 0, "slice": place(2, SLICES)}))
    counts = {(r["held"], r["label"]): r["count"] for r in rows.groupBy("held", "label").count().collect()}
    if {label for _, label in counts} != {0, 1}:
        return None
    both = lambda side: (side, 0) in counts and (side, 1) in counts
    fit = rows.filter("NOT held") if both(False) else rows
    held = rows.filter("held") if both(True) else rows
    n = sum(k for (side, _), k in counts.items() if not side or not both(False))
    slices = min(SLICES, -(-n // CHUNK))
    tasks = min(MOST_TASKS, -(-n // (slices * CHUNK)))
    again, done = max(1, -(-LEAST_SEEN // n)), 0
    net = fresh()
    state = np.concatenate([_flat(net.arrays()), np.zeros(2 * sum(a.size for a in net.arrays()))])
    for k in range(slices):
        own = fit.filter(F.col("slice") % slices == k).withColumn("bucket", place(3, tasks).cast("int"))
        own = own.repartitionById(tasks, "bucket").sortWithinPartitions("h", "window", "size", "label")
        own = own.select("window", "size", "label")
        learned = own.mapInArrow(lambda it, s=state, d=done: _learn(it, s, d, again), "n bigint, steps bigint, state array<double>").collect()
        if learned:
            learned.sort(key=lambda r: (r["n"], r["state"][0]))
            state = np.average([r["state"] for r in learned], axis=0, weights=[r["n"] for r in learned])
            done += max(r["steps"] for r in learned)
    return _calibrated(Network(*_shaped(state[: len(state) // 3], net.arrays())), held.select("window", "size", "label"))


_SCORED = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("span", pa.string()), ("probability", pa.float64())])
_SCORED_DDL = "doc_id bigint, row_key bigint, span string, probability double"


def _score(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    """The probability of each candidate, and the span of those that are added."""
    for batch in batches:
        rows = zip(batch.column("window").to_pylist(), batch.column("size").to_pylist())
        windows = ((i, *x) for i, (text, size) in enumerate(rows) for x in parts(text, size))
        p = np.zeros(batch.num_rows)
        while some := list(islice(windows, 1024)):
            owner, texts, sizes = zip(*some)
            np.maximum.at(p, list(owner), probability(net, *encode(texts, sizes)))
        own = zip(batch.column("kind").to_pylist(), batch.column("start").to_pylist(), batch.column("stop").to_pylist(), p >= net.threshold)
        spans = [f"model:{a}:{b}" if kind == "candidate" and found else None for kind, a, b, found in own]
        yield arrow(None, _SCORED, doc_id=batch.column("doc_id"), row_key=batch.column("row_key"), span=spans, probability=p)


def secret_scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, top_probability.

    top_probability is the largest of all its candidates, those of the patterns included; null without any.
    findings: labelled windows (window, size, label) to learn from instead of those of the documents.
    """
    spark = docs.sparkSession
    rows = stash(small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_findings, _FOUND_DDL))
    if findings is None:
        known = rows.filter("kind IN ('assign', 'access', 'hex', 'secret', 'word')")
        findings = known.select("window", "size", (F.col("kind") != "word").cast("int").alias("label"))
    net = train_on(findings)
    whole = rows.filter("kind IS NULL").select("doc_id", "row_key", "base")
    if net is None:
        scored = spark.createDataFrame([], _SCORED_DDL)
    else:
        shared = spark.sparkContext.broadcast(net)
        wanted = rows.filter("kind IN ('assign', 'access', 'hex', 'candidate')").select(
            "doc_id", "row_key", "kind", "start", "stop", "window", "size",
        )
        scored = wanted.mapInArrow(lambda it: _score(it, shared.value), _SCORED_DDL)
    extra = scored.groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("more"), F.max("probability").alias("top"))
    on = F.col("w.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("w.row_key") == F.col("e.row_key"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    both = whole.alias("w").join(extra.alias("e"), on, "left").select("w.doc_id", "base", more.alias("more"), "top")
    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("bigint").alias(f"n_{kind}")
    place = lambda s: F.split(s, ":").getItem(1).cast("bigint")
    order = lambda s: F.when(s.startswith("assign"), 0).when(s.startswith("access"), 1).when(s.startswith("hex"), 2).otherwise(3)
    placed = F.transform(F.concat("base", "more"), lambda s: F.struct(place(s).alias("a"), order(s).alias("k"), s.alias("s")))
    spans = F.array_join(F.transform(F.array_sort(placed), lambda x: x["s"]), ",").alias("spans")
    digest = F.sha2(F.array_join("base", ","), 256).alias("base_sha256")
    return both.select(
        "doc_id", count("assign"), count("access"), count("hex"), digest, spans, F.size("more").cast("bigint").alias("n_model"),
        F.round("top", 6).alias("top_probability"),
    )
