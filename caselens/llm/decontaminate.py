"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Text is lower-cased (A-Z) and cut into words of digits, letters and characters
beyond ASCII. The windows of the benchmark (n successive words of an item, or
the whole item where it is shorter) are hashed and broadcast in blocks of about
MAX_WINDOWS or MAX_BYTES, so the broadcast is bounded whatever the benchmark's
size. Blocks are dealt by window and item, so a window of very many items is
spread, too. BLOCKS_AT_ONCE of them follow each other in a stage; for more, the
documents get numbers of their own, each stage reads the texts and writes marks
(the first for all rows, the others where they hit), and one join by number puts
the marks together: texts are written once, however many blocks there are.
Every window of every document is looked up; hits are verified word by word.

Edge cases: null texts and texts without words are clean; items without words
have no window; repeated items count one each; repeated rows and null doc_ids
are rows like others; other columns of the input are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import small_batches, stash, text_or_empty, unused
from ._text import ALNUM, LOWER, ngrams, slices, span_hash, spans, utf8

#: Benchmark windows that are broadcast at once, about 300 bytes each; and bytes of their texts and item ids.
MAX_WINDOWS = 200_000
MAX_BYTES = 64 << 20
BLOCKS_AT_ONCE = 2
_FILTER = 1 << 22

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARKS = {"n_words": T.LongType(), "n_hit": T.LongType(), "hits": T.BinaryType(), "items": T.ArrayType(T.StringType())}


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id as string, words): every window of every item, as words joined by single blanks."""
    lower = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(lower, F.lit(_WORD), 0).alias("w"),
    ).filter(F.size("w") > 0)
    return words.select(
        "item_id", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))).alias("i"), "w",
    ).select("item_id", F.array_join(F.slice("w", F.col("i") + 1, n), " ").alias("window"))


class WindowSet:
    """Windows by length, hashed; small enough to be broadcast."""

    def __init__(self, rows: list[tuple[str, str]]):
        texts: dict[str, list[str]] = defaultdict(list)
        for item, window in rows:
            texts[window].append(item or "")
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[tuple[bytes, list[str]]]]]] = {}
        grouped = defaultdict(list)
        for window, items in texts.items():
            raw = window.encode()
            grouped[raw.count(b" ") + 1].append((raw, sorted(set(items))))
        for length, found in grouped.items():
            buf = np.frombuffer(b"\n".join(x for x, _ in found), np.uint8)
            offsets = np.cumsum([0, *(len(x) + 1 for x, _ in found)])
            offsets[-1] -= 1
            s, e, owner = spans(buf, offsets, ALNUM)
            hashes, _ = ngrams(span_hash(buf, s, e), owner, length)
            table = defaultdict(list)
            for h, x in zip(hashes.tolist(), found):
                table[h].append(x)
            maybe = np.zeros(_FILTER, bool)
            maybe[hashes & np.uint64(_FILTER - 1)] = True
            self.by_length[length] = (maybe, dict(table))

    def hits(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """(word is hit, [(text, item)]) for the words of a batch of texts."""
        hit = np.zeros(len(starts), bool)
        items = []
        if not len(starts):
            return hit, items
        hashes = span_hash(buf, starts, ends)
        for length, (maybe, table) in self.by_length.items():
            grams, first = ngrams(hashes, owner, length)
            for k in np.flatnonzero(maybe[grams & np.uint64(_FILTER - 1)]).tolist():
                if found := table.get(int(grams[k])):
                    i = int(first[k])
                    words = b" ".join(buf[a:b].tobytes() for a, b in zip(starts[i : i + length].tolist(), ends[i : i + length].tolist()))
                    for raw, own in found:
                        if raw == words:
                            hit[i : i + length] = True
                            items += [(int(owner[i]), x) for x in own]
        return hit, items


def _blocks(benchmark: DataFrame, n: int) -> list[DataFrame]:
    """The benchmark's windows in parts that may be broadcast: about MAX_WINDOWS rows and MAX_BYTES each, written by part if there are several."""
    windows = benchmark_windows(benchmark, n).distinct()
    size = F.octet_length("window") + F.coalesce(F.octet_length("item_id"), F.lit(0))
    rows, total = windows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-rows // MAX_WINDOWS), -(-total // MAX_BYTES))
    if blocks == 1:
        return [windows]
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)))
    written = stash(dealt.repartition("block"), "block")
    return [written.filter(F.col("block") == k).drop("block") for k in range(blocks)]


def mark_names(docs: DataFrame) -> dict[str, str]:
    """The columns that marked() adds: n_words, n_hit, hits and items, by names that docs does not have."""
    return {k: unused(f"__{k}", docs.columns) for k in _MARKS}


def _mark(batches: Iterator[pa.RecordBatch], windows: WindowSet, names: dict[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        buf, offsets = utf8(batch.column("text"))
        buf = LOWER[buf]
        starts, ends, owner = spans(buf, offsets, ALNUM)
        hit, items = windows.hits(buf, starts, ends, owner)
        words = np.bincount(owner, minlength=batch.num_rows)
        upto = np.cumsum(words)
        own = [set(x or ()) for x in batch.column(names["items"]).to_pylist()]
        for i, item in items:
            own[i].add(item)
        for i, before in enumerate(batch.column(names["hits"]).to_pylist()):
            if before:
                hit[upto[i] - words[i] : upto[i]] |= np.unpackbits(np.frombuffer(before, np.uint8), count=words[i]).astype(bool)
        n_hit = np.bincount(owner[hit], minlength=batch.num_rows)
        bits = [np.packbits(hit[e - w : e]).tobytes() if x else b"" for w, e, x in zip(words.tolist(), upto.tolist(), n_hit)]
        marks = [
            pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()),
            pa.array([sorted(x) for x in own], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[: -len(_MARKS)], *marks], names=batch.schema.names)


def _chain(docs: DataFrame, names: dict[str, str], blocks: list[DataFrame]) -> DataFrame:
    """docs with marks of these blocks, in one stage. One block at a time is on the driver."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[k], t) for k, t in _MARKS.items())])
    out = docs.withColumns({names[k]: F.lit(None).cast(t) for k, t in _MARKS.items()})
    for block in blocks:
        windows = WindowSet([(r.item_id, r.window) for r in block.collect()])
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        out = out.mapInArrow(lambda it, shared=shared: _mark(it, shared.value, names), schema)
    return out


@F.pandas_udf(T.BinaryType())
def _either(bits: pd.Series) -> pd.Series:
    """The union of bit strings of one length; empty ones have no bits."""
    return bits.map(lambda parts: np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts]).tobytes() if len(parts) else b"")


@F.pandas_udf(T.LongType())
def _ones(bits: pd.Series) -> pd.Series:
    return bits.map(lambda x: int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()))


def marked(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with the columns of mark_names(): numbers of words and hit words, a bit for each word, item ids.

    Nothing is shuffled, unless the benchmark has more than BLOCKS_AT_ONCE blocks.
    """
    names, blocks = mark_names(docs), _blocks(benchmark, n)
    docs = small_batches(docs)
    if len(blocks) <= BLOCKS_AT_ONCE:
        return _chain(docs, names, blocks)
    row = unused("__row", [*docs.columns, *names.values()])
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    c, parts = {k: F.col(v) for k, v in names.items()}, []
    for k in range(0, len(blocks), BLOCKS_AT_ONCE):
        part = _chain(numbered.select(row, "text"), names, blocks[k : k + BLOCKS_AT_ONCE]).drop("text")
        parts.append(stash(part.filter(c["n_hit"] > 0) if k else part))
    together = reduce(DataFrame.unionByName, parts).groupBy(row).agg(
        F.max(c["n_words"]).alias(names["n_words"]), F.collect_list(F.when(c["n_hit"] > 0, c["hits"])).alias(names["hits"]),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(c["items"])))).alias(names["items"]),
    ).withColumn(names["hits"], _either(c["hits"])).withColumn(names["n_hit"], _ones(c["hits"]))
    return numbered.join(together, row).select(*docs.columns, *names.values())


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    c = {k: F.col(v) for k, v in mark_names(docs).items()}
    digest = F.sha2(F.array_join(c["items"], ","), 256)
    return marked(docs, benchmark, n).select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"),
        digest.alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


def _without_hits(batches: Iterator[pa.RecordBatch], hits: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        buf, offsets = utf8(batch.column("text"))
        starts, ends, owner = spans(LOWER[buf], offsets, ALNUM)
        texts, bits = batch.column("text").to_pylist(), batch.column(hits).to_pylist()
        for i in [i for i, x in enumerate(bits) if x]:
            own = np.flatnonzero(owner == i)
            hit = np.unpackbits(np.frombuffer(bits[i], np.uint8), count=len(own)).astype(bool)
            keep = np.ones(offsets[i + 1] - offsets[i], bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in edges.reshape(-1, 2):
                keep[starts[own[a]] - offsets[i] : ends[own[b - 1]] - offsets[i]] = False
            texts[i] = buf[offsets[i] : offsets[i + 1]][keep].tobytes().decode()
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """docs, with all its columns, without contaminated documents; or, with mode "spans", without the hit words.

    A removed span reaches from the first byte of its first word to the last byte of its last word.
    """
    found, names = marked(docs, benchmark, n), mark_names(docs)
    if mode == "documents":
        return found.filter(F.col(names["n_hit"]) == 0).select(*docs.columns)
    return found.mapInArrow(lambda it: _without_hits(it, names["hits"]), found.schema).select(*docs.columns)
