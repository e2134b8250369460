"""Exact dedup with a minimal perfect hash over the distinct digests of a history.

The index is a table with one row a bucket of digests. Its slots hold full
digests and the locator of the winner. A lookup computes one slot and compares
the whole digest; nonmembers form groups of their own.

Edge cases: a null text counts as empty, all empty texts are equal; a null
doc_id never wins over another; rows repeated with doc_id and text are one
document, kept or dropped together; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._mph import build, slot
from ._spark import look_up, stash, text_or_empty

#: Digests in a bucket of the index, on average; a bucket is one row and about 1 MB.
BUCKET_KEYS = 16_384

_INDEX = "bucket int, seeds binary, digests binary, winners binary, sizes binary"
_FOUND = "digest binary, keep_id bigint, group_size bigint, member boolean"
_NO_ID = -(1 << 63)


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


def winners(digests: DataFrame) -> DataFrame:
    """One row for each distinct digest: the largest doc_id and the number of rows."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _bucketed(stats: DataFrame, buckets: int) -> DataFrame:
    return stats.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _keys(digests: np.ndarray) -> np.ndarray:
    """64-bit keys; all 32 bytes take part."""
    words = np.ascontiguousarray(digests).view("<u8")
    return words[:, 0] + words[:, 1] * np.uint64(3) + words[:, 2] * np.uint64(5) + words[:, 3] * np.uint64(7)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy().astype(np.int64)


def _build_bucket(table: pa.Table) -> pa.Table:
    digests = _digests(table.column("digest"))
    keys = _keys(digests)
    seeds = build(keys)
    at = np.argsort(slot(keys, seeds, len(keys)))
    return pa.table(
        {
            "bucket": table.column("bucket")[:1].combine_chunks(),
            "seeds": [seeds.tobytes()],
            "digests": [digests[at].tobytes()],
            "winners": [_ids(table.column("keep_id"))[at].tobytes()],
            "sizes": [table.column("group_size").to_numpy()[at].astype(np.int64).tobytes()],
        },
        schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("seeds", "digests", "winners", "sizes"))]),
    )


def build_index(history: DataFrame, bucket_keys: int = BUCKET_KEYS, arrivals: int = 0) -> tuple[DataFrame, int]:
    """(index, number of buckets) over the winners() of all documents seen so far.

    Buckets are as many as the larger of the history and the number of rows to be looked up needs.
    """
    stats = stash(winners(with_digest(history)))
    buckets = max(1, -(-max(stats.count(), arrivals) // bucket_keys))
    return stash(_bucketed(stats, buckets).groupBy("bucket").applyInArrow(_build_bucket, _INDEX)), buckets


def _probe(index: pa.Table, new: pa.Table) -> pa.Table:
    digests, ids, sizes = (
        _digests(new.column("digest")), _ids(new.column("keep_id")), new.column("group_size").to_numpy(),
    ) if new.num_rows else (np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    old = {
        c: np.frombuffer(index.column(c)[0].as_py(), t) if index.num_rows else np.zeros(0, t)
        for c, t in (("seeds", np.int64), ("digests", np.uint8), ("winners", np.int64), ("sizes", np.int64))
    }
    stored, n = old["digests"].reshape(-1, 32), len(old["winners"])
    at = slot(_keys(digests), old["seeds"], n)
    member = (stored[at] == digests).all(axis=1) if n else np.zeros(len(digests), bool)
    untouched = np.ones(n, bool)
    untouched[at[member]] = False
    keep, size = ids.copy(), sizes.astype(np.int64)
    keep[member] = np.maximum(ids[member], old["winners"][at[member]])
    size[member] += old["sizes"][at[member]]
    keep = np.concatenate([keep, old["winners"][untouched]])
    rows = [x.tobytes() for x in digests] + [x.tobytes() for x in stored[untouched]]
    return pa.table(
        {
            "digest": pa.array(rows, pa.binary()),
            "keep_id": pa.array(keep, pa.int64(), mask=keep == _NO_ID),
            "group_size": np.concatenate([size, old["sizes"][untouched]]),
            "member": np.concatenate([member, np.zeros(int(untouched.sum()), bool)]),
        }
    )


def merge(index: DataFrame, buckets: int, arrivals: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, member) of history and arrivals together; member: arrivals that the history had."""
    new = _bucketed(winners(with_digest(arrivals)), buckets)
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(_probe, _FOUND)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each document of docs (and of history): doc_id, keep_id, group_size, kept, text_sha256, in_history.

    Without a history, the documents whose hashed doc_id is even count as the
    first delivery, from which the index is built; the others are looked up.
    """
    if history is None:
        even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        history, arrivals = docs.filter(even), docs.filter(~even)
    else:
        arrivals, docs = docs, history.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    index, buckets = build_index(history, arrivals=arrivals.count())
    groups = stash(merge(index, buckets, arrivals))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    found = look_up(with_digest(docs), groups, "digest", "group_size", total)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"),
    )
