"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), with exact links and components.

A document's set holds its distinct 5-word shingles, hashed to 64 bits. Equal
sets are one from the start (sid), so copies never make pairs. Then:

1. Every set sends its smallest hashes (an adaptive prefix: as many as may be
   missing in a partner, plus a tenth) to hash buckets. A set of which fewer
   than a tenth are found in other sets' prefixes has no partner and is done.
2. What is left sends all of its shingles to buckets, which return how many
   sets hold each. A set is done unless enough of its shingles are held by
   others. Its rarest ones - one more than may be missing - name its possible
   partners; groups are the components of that relation.
3. In each group, sets are searched against those of smaller or equal size:
   short inverted lists are merged, the long ones (as many as the overlap allows,
   one less than it) are searched by bisection for candidates that can still
   reach the overlap. Pairs that are connected already are
   skipped, so a group of copies takes one probe each. Groups beyond MAX_GROUP
   are cut into blocks: first each by itself, then each with the first one,
   then all pairs of blocks that still hold different components.

Common shingles (a licence, a page's frame) are found where texts are read: a
task that holds COMMON entries of one keeps them. In step 1 it counts them for
their sets itself, since others hold them; in step 2 it sends one mark, by which
all tasks rank that shingle after those that aren't common. So at most COMMON
entries of a shingle come from a million entries, and none of these rankings
differs between two sets.

Every step is exact. Edge cases: a null, empty or blank text has no set and is
linked with nothing; a text with fewer words than a shingle has one shingle of
all of them; rows repeated with doc_id are rows like others; a null doc_id
never names a component unless all of its members lack one.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import by_bucket, by_key, components, look_up, partitions, runs, small_batches, stash, unused
from ._text import LOWER, NOT_SPACE, ngrams, slices, span_hash, spans, utf8

SHINGLE = 5
#: Sets that one task searches at once; larger groups are cut into blocks of half of it.
MAX_GROUP = 4096
#: Entries that a task of the first steps holds before it sends them.
_HOLD = 1_000_000
#: A shingle that so many of these entries have is common: its entries don't meet in one task.
COMMON = 16
_NO_ID = -(1 << 63)


# --- sets -------------------------------------------------------------------------------------


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of text i are hashes[bounds[i]:bounds[i + 1]]."""
    texts = len(offsets) - 1
    buf = LOWER[buf]
    starts, ends, owner = spans(buf, offsets, NOT_SPACE)
    words = span_hash(buf, starts, ends)
    grams, first = ngrams(words, owner, n)
    of = owner[first]
    counts = np.bincount(owner, minlength=texts)
    for short in range(1, n):  # texts of fewer words: all of them as one
        if (few := counts == short).any():
            own = few[owner]
            more, at = ngrams(words[own], owner[own], short)
            grams, of = np.concatenate([grams, more + np.uint64(short)]), np.concatenate([of, owner[own][at]])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(texts + 1))


def set_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    raw = memoryview(np.ascontiguousarray(grams).view(np.uint8))
    out = np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if b > a:
            out[i] = int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) | 1
    return out


def may_miss(n):
    """How many shingles of a set of n a partner may lack: 100 * intersection >= 80 * union."""
    return n - (4 * n + 4) // 5


def linked(overlap: int, n: int, m: int) -> bool:
    return 100 * overlap >= 80 * (n + m - overlap)


# --- buckets ----------------------------------------------------------------------------------

_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("h", pa.binary()), ("sid", pa.binary()), ("n", pa.binary())])
_PACKED_DDL = "bucket int, kind tinyint, h binary, sid binary, n binary"


def _pack(bucket: np.ndarray, kind: int, h: np.ndarray, sid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with its entries as raw arrays."""
    order = np.argsort(bucket, kind="stable")
    bucket, h, sid, n = bucket[order], h[order], sid[order], n[order].astype(np.int32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    at = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)])) if len(bucket) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[a]) for a, _ in at], pa.int32()), pa.array([kind] * len(at), pa.int8()),
            *(pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for x in (h, sid, n)),
        ],
        schema=_PACKED,
    )


def _unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("sid", np.int64), ("n", np.int32)))


def _common(h: np.ndarray, common: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether an entry's shingle is common, the first entry of each common shingle)."""
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]])) if len(h) else np.zeros(1, np.int64)
    often = np.diff(edge) >= common
    mask = np.zeros(len(h), bool)
    mask[order] = np.repeat(often, np.diff(edge))
    return mask, order[edge[:-1][often]]


def _by_shingle(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _by_set(sid: np.ndarray, buckets: int) -> np.ndarray:
    return _by_shingle(sid.view(np.uint64), buckets)


def _held_prefixes(parts: list[tuple[np.ndarray, ...]], buckets: int, common: int) -> Iterator[pa.RecordBatch]:
    """Entries by shingle, one of each common one; and for the sets of common ones how many they have (kind 3, in the place of h)."""
    h, sid, n = (np.concatenate(x) for x in zip(*parts))
    often, first = _common(h, common)
    send = ~often
    send[first] = True
    yield _pack(_by_shingle(h[send], buckets), 0, h[send], sid[send], n[send])
    found, count = np.unique(sid[often], return_counts=True)
    yield _pack(_by_set(found, buckets), 3, count.astype(np.uint64), found, np.zeros(len(found), np.int32))


_COUNTED = np.dtype([("n", np.int32), ("held", np.int32)])
_MOST = np.iinfo(np.int32).max


def _pack_counts(h: np.ndarray, sid: np.ndarray, n: np.ndarray, held: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Shingles on their way to their sets, with the number of holders beside the set's size (kind 2)."""
    bucket = _by_set(sid, buckets)
    counted = np.zeros(len(n), _COUNTED)
    counted["n"], counted["held"] = n, held
    order = np.argsort(bucket, kind="stable")
    bucket, h, sid, counted = bucket[order], h[order], sid[order], counted[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    at = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)])) if len(bucket) else []
    arrays = [pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for x in (h, sid, counted)]
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in at], pa.int32()), pa.array([2] * len(at), pa.int8()), *arrays], schema=_PACKED)


def _held_all(parts: list[tuple[np.ndarray, ...]], buckets: int, common: int) -> Iterator[pa.RecordBatch]:
    """Entries by shingle; those of common ones go to their sets at once, and a mark (set 0) to their shingle's bucket."""
    h, sid, n = (np.concatenate(x) for x in zip(*parts))
    often, first = _common(h, common)
    none = np.zeros(len(first), np.int64)
    send = np.concatenate([h[~often], h[first]]), np.concatenate([sid[~often], none]), np.concatenate([n[~often], none])
    yield _pack(_by_shingle(send[0], buckets), 0, *send)
    yield _pack_counts(h[often], sid[often], n[often], np.full(int(often.sum()), _MOST), buckets)


def _send_prefixes(batches: Iterator[pa.RecordBatch], buckets: int, common: int) -> Iterator[pa.RecordBatch]:
    """kind 0: prefix hashes of each set, once a task; kind 1: doc_id (as h), sid and size of each document; kind 3: see _held_prefixes()."""
    parts, size, seen = [], 0, set()
    for batch in slices(batches, "text"):
        grams, bounds = shingle_sets(*utf8(batch.column("text")))
        sids, n = set_ids(grams, bounds), np.diff(bounds)
        ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        yield _pack(((sids ^ ids) % buckets).astype(np.int32), 1, ids.view(np.uint64), sids, n)
        fresh = np.zeros(len(sids), bool)
        for i, s in enumerate(sids.tolist()):
            if s and s not in seen:
                seen.add(s)
                fresh[i] = True
        take = np.where(fresh, np.minimum(n, may_miss(n) + np.maximum(1, n // 10)), 0)
        rank = np.arange(len(grams)) - np.repeat(bounds[:-1], n)
        first = rank < np.repeat(take, n)
        parts.append((grams[first], np.repeat(sids, take), np.repeat(n, take)))
        size += int(take.sum())
        if size > _HOLD:
            yield from _held_prefixes(parts, buckets, common)
            parts, size = [], 0
            seen = set()
    if parts:
        yield from _held_prefixes(parts, buckets, common)


def _distinct(h: np.ndarray, sid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (h, sid), sorted by h, and the number of sets that hold each h."""
    order = np.lexsort((sid, h))
    h, sid, n = h[order], sid[order], n[order]
    if not len(h):
        return h, sid, n, np.zeros(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
    h, sid, n = h[new], sid[new], n[new]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    return h, sid, n, np.repeat(np.diff(edge), np.diff(edge))


_META = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("shared", pa.int64())])


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes the documents on, and counts for each set how many of its prefix hashes others hold as well."""
    for table in runs(batches, "bucket", 1):
        docs = table.filter(pc.equal(table.column("kind"), 1))
        ids, sids, n = _unpack(docs)
        ids = ids.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=ids == _NO_ID), pa.array(sids, mask=sids == 0), pa.array(n.astype(np.int64)),
                pa.array(np.zeros(len(n), np.int64)),
            ],
            schema=_META,
        )
        _, sid, _, held = _distinct(*_unpack(table.filter(pc.equal(table.column("kind"), 0))))
        known, sids, _ = _unpack(table.filter(pc.equal(table.column("kind"), 3)))
        for found, count in (np.unique(sid[held > 1], return_counts=True), (sids, known)):
            nothing = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, pa.array(found), nothing, pa.array(count.astype(np.int64))], schema=_META)


def _with_sid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        grams, bounds = shingle_sets(*utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(set_ids(grams, bounds)), pa.array(np.diff(bounds)), batch.column("text").cast(pa.string())],
            names=["sid", "n", "text"],
        )


def _send_all(batches: Iterator[pa.RecordBatch], buckets: int, common: int) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in slices(batches, "text"):
        grams, bounds = shingle_sets(*utf8(batch.column("text")))
        n = np.diff(bounds)
        parts.append((grams, np.repeat(batch.column("sid").to_numpy(), n), np.repeat(n, n)))
        size += len(grams)
        if size > _HOLD:
            yield from _held_all(parts, buckets, common)
            parts, size = [], 0
    if parts:
        yield from _held_all(parts, buckets, common)


def _return_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several sets hold go to their sets, with the number of holders; common ones have the largest number everywhere."""
    for table in runs(batches, "bucket", 1):
        direct = pc.equal(table.column("kind"), 2)
        yield from table.filter(direct).to_batches()
        h, sid, n, held = _distinct(*_unpack(table.filter(pc.invert(direct))))
        common = np.isin(h, h[sid == 0])
        held = np.where(common, _MOST, held)
        send = (held > 1) & (sid != 0)
        yield _pack_counts(h[send], sid[send], n[send], held[send], buckets)


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sid) of the rarest shingles of each set of which enough are held by others: any partner holds one of them."""
    for table in runs(batches, "bucket", 1):
        raw = {c: b"".join(table.column(c).to_pylist()) for c in ("h", "sid", "n")}
        h, sid, counted = np.frombuffer(raw["h"], np.uint64), np.frombuffer(raw["sid"], np.int64), np.frombuffer(raw["n"], _COUNTED)
        order = np.lexsort((h, counted["held"], sid))
        h, sid, n = h[order], sid[order], counted["n"][order].astype(np.int64)
        once = np.ones(len(h), bool)  # rows that repeat a document have sent its set twice
        once[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
        h, sid, n = h[once], sid[once], n[once]
        edge = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1], [True]])) if len(sid) else np.zeros(1, np.int64)
        have = np.repeat(np.diff(edge), np.diff(edge))
        rank = np.arange(len(sid)) - np.repeat(edge[:-1], np.diff(edge))
        take = (have >= n - may_miss(n)) & (rank < may_miss(n) + 1 - (n - have))
        yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(sid[take])], names=["h", "sid"])


# --- search -----------------------------------------------------------------------------------


class Links:
    """Union-find over the sets of a group."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of sorted lists and how many lists have each."""
    total = sum(map(len, lists))
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if total <= 64 and len(lists) > 1:  # a heap of the lists' heads
        merged = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64, total)
    else:  # the same merge by runs, without Python's cost for each entry
        merged = np.sort(np.concatenate(lists), kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1], [True]]))
    return merged[edge[:-1]], np.diff(edge)


def search(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, as pairs of positions: a forest that, with the labels, connects all that is linked.

    labels: sets with equal labels count as connected. side: if given, only pairs of different sides are searched.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by_token = np.argsort(tokens, kind="stable")  # ranks ascend within each inverted list
    sorted_tokens = tokens[by_token]
    edge = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1], [True]]))
    length = np.diff(edge)
    number = np.empty(len(tokens), np.int64)
    number[by_token] = np.repeat(np.arange(len(length)), length)
    postings = owner[by_token]
    entries = np.repeat(np.arange(len(length)), length) * len(order) + postings  # all inverted lists in one ascending array
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [number[a:b] for a, b in zip(bounds, bounds[1:])]  # sorted, as the tokens are
    links, found = Links(labels[order]), []
    sides = None if side is None else side[order]
    for q in range(1, len(order)):
        n = int(sizes[q])
        low = int(np.searchsorted(sizes, -(-4 * n // 5)))
        if low >= q:
            continue
        mine = own[q][length[own[q]] > 1]
        need = -(-4 * (n + int(sizes[low])) // 9)
        if len(mine) < need:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")]
        long = min(need - 1, len(mine) - 1)
        short = mine[: len(mine) - long]
        lists = []
        for t in short.tolist():
            one = postings[edge[t] : edge[t + 1]]
            lists.append(one[np.searchsorted(one, low) : np.searchsorted(one, q)])
        candidates, count = _merged(lists)
        if sides is not None:
            apart = sides[candidates] != sides[q]
            candidates, count = candidates[apart], count[apart]
        needs = -(-4 * (n + sizes[candidates]) // 9)
        able = count >= needs - long
        probes = np.sort(mine[len(mine) - long :])
        for i in np.flatnonzero(able)[np.argsort(-count[able], kind="stable")].tolist():
            c = int(candidates[i])
            if links.find(c) == links.find(q):
                continue
            wanted = probes * len(order) + c  # where each long list has the candidate, if it does
            at = np.searchsorted(entries, wanted)
            overlap = int(count[i]) + int((entries[np.minimum(at, len(entries) - 1)] == wanted).sum())
            if linked(overlap, n, int(sizes[c])):
                links.join(q, c)
                found.append((order[q], order[c]))
    return found


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, "task", 4096):
        keys = table.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        pairs = []
        for a, b in zip(cuts, cuts[1:]):
            rows = table.slice(a, b - a)
            sids, at = np.unique(rows.column("sid").to_numpy(), return_index=True)
            rows = rows.take(pa.array(at)).combine_chunks()
            sets = []
            for batch in slices(iter(rows.to_batches()), "text"):
                grams, bounds = shingle_sets(*utf8(batch.column("text")))
                sets += [grams[x:y] for x, y in zip(bounds, bounds[1:])]
            side = rows.column("side").to_numpy()
            pairs += [(int(sids[i]), int(sids[j])) for i, j in search(sets, rows.column("label").to_numpy(), side if side.any() else None)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], schema=_EDGES,
        )


def _searched(tasks: DataFrame) -> DataFrame:
    """tasks: task long, sid, label, side, text."""
    return stash(by_key(tasks.select("task", "sid", "label", "side", "text"), "task").mapInArrow(_search_groups, "a bigint, b bigint"))


def _large(texts: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Links within groups that are too large for a task; groups: sid, root."""
    width = math.log(1.26)  # sets of linked sizes lie in one class or in two that follow each other
    rows = texts.join(groups, "sid").withColumn("size_class", F.floor(F.log(F.col("n")) / width))
    counts = rows.groupBy("root", "size_class").agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = stash(
        rows.join(counts, ["root", "size_class"]).withColumn(
            "block", F.pmod(F.xxhash64("sid"), F.col("blocks")),
        ).withColumn("cell", F.xxhash64("root", "size_class", "block"))
    )
    edges = _searched(rows.select(F.col("cell").alias("task"), "sid", F.col("sid").alias("label"), F.lit(0).alias("side"), "text"))
    cells = stash(rows.select("root", "size_class", "block", "cell").distinct())
    right = cells.select("root", F.col("size_class").alias("class2"), F.col("block").alias("block2"), F.col("cell").alias("cell2"))
    pairs = cells.join(right, "root").filter("class2 = size_class AND block2 > block OR class2 = size_class + 1")
    first = (F.col("block") == 0) & (F.col("block2") == 0) | (F.col("class2") == F.col("size_class")) & (F.col("block") == 0)
    for step in (pairs.filter(first), pairs):
        labels = components(edges).select(F.col("node").alias("sid"), F.col("root").alias("label"))
        now = stash(rows.select("sid", "cell", "text").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
        spread = now.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        todo = step.join(spread, "cell").join(
            spread.toDF("cell2", "lo2", "hi2"), "cell2",
        ).filter("NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
        todo = stash(todo.select(F.xxhash64("cell", "cell2").alias("task"), "cell", "cell2"))
        ends = todo.select("task", "cell", F.lit(1).alias("side")).unionByName(
            todo.select("task", F.col("cell2").alias("cell"), F.lit(2).alias("side"))
        )
        edges = stash(edges.unionByName(_searched(ends.join(now, "cell"))))
    return edges


def _joined(docs: DataFrame, max_group: int, common: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, n of each document, with other rows of n null), (sid, copies, min_id, root, component_id of each set); root is one sid of the component."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    buckets = 2 * partitions(spark)
    sent = docs.mapInArrow(lambda it: _send_prefixes(it, buckets, common), _PACKED_DDL)
    meta = stash(by_bucket(sent).mapInArrow(_count_shared, "doc_id bigint, sid bigint, n bigint, shared bigint"))
    sets = stash(
        meta.filter("sid IS NOT NULL").groupBy("sid").agg(
            F.max("n").alias("n"), F.sum("shared").alias("shared"), F.min("doc_id").alias("min_id"), F.count("n").alias("copies"),
        )
    )

    alive = sets.filter("shared >= greatest(1, n div 10)").select(F.coalesce("min_id", F.lit(_NO_ID)).alias("rep"))
    whole = docs.withColumn("rep", F.coalesce("doc_id", F.lit(_NO_ID))).join(alive.hint("shuffle_hash"), "rep", "left_semi")
    texts = stash(whole.select("text").mapInArrow(_with_sid, "sid bigint, n bigint, text string").filter("sid <> 0"))

    counted = by_bucket(
        texts.mapInArrow(lambda it: _send_all(it, buckets, common), _PACKED_DDL)
    ).mapInArrow(lambda it: _return_counts(it, buckets), _PACKED_DDL)
    rare = stash(by_bucket(counted).mapInArrow(_rarest, "h bigint, sid bigint"))
    least = stash(rare.groupBy("h").agg(F.min("sid").alias("b"), F.count("*").alias("k")).filter("k > 1"))
    groups = components(rare.join(least, "h").select(F.col("sid").alias("a"), "b")).toDF("sid", "root")

    counts = groups.groupBy("root").count()
    groups = stash(groups.join(counts, "root"))
    small = groups.filter(F.col("count") <= max_group)
    edges = _searched(
        texts.join(small, "sid").select(F.col("root").alias("task"), "sid", F.col("sid").alias("label"), F.lit(0).alias("side"), "text")
    )
    large = groups.filter(F.col("count") > max_group).select("sid", "root")
    if not large.isEmpty():
        edges = edges.unionByName(_large(texts, large, max(1, max_group // 2)))

    reached = components(edges).toDF("sid", "root")
    named = reached.join(sets.select("sid", "min_id"), "sid")
    smallest = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    linked_sets = named.join(smallest, "root").select("sid", "root", "component_id")
    values = sets.select("sid", "copies", "min_id").join(linked_sets, "sid", "left")
    return meta, stash(
        values.select(
            "sid", "copies", "min_id", F.coalesce("root", "sid").alias("root"), F.coalesce("component_id", "min_id").alias("component_id"),
        )
    )


def jaccard_join(docs: DataFrame, max_group: int = MAX_GROUP, common: int = COMMON) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included)."""
    meta, values = _joined(docs, max_group, common)
    values = values.select("sid", "copies", "component_id")
    rows = meta.filter("n IS NOT NULL").select("doc_id", "sid", F.col("n").alias("n_shingles"))
    total = values.agg(F.sum("copies")).first()[0] or 0
    found = look_up(rows.filter("sid IS NOT NULL"), values, "sid", "copies", total)
    return found.select("doc_id", "n_shingles", "component_id").unionByName(
        rows.filter("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def _add_sid(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sids = set_ids(*shingle_sets(*utf8(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sids)], names=[*batch.schema.names, name])


def keep_one(docs: DataFrame, max_group: int = MAX_GROUP, common: int = COMMON) -> DataFrame:
    """docs, with all its columns, less the documents that another one of their component stands for.

    One set stands for a component: one that has its smallest doc_id (null only if
    there is no other), and of its rows one with that doc_id. Documents without a
    set all stay, whatever their doc_id.
    """
    meta, values = _joined(docs, max_group, common)
    best = values.groupBy("root").agg(F.min(F.struct(F.col("min_id").isNull().alias("none"), "min_id", "sid")).alias("best"))
    copies = meta.filter("n IS NOT NULL AND sid IS NOT NULL").groupBy("sid", "doc_id").agg(F.count("*").alias("__rows"))
    own, chosen, id_, rows = (unused(f"__{x}", docs.columns) for x in ("sid", "set", "id", "rows"))
    best = best.select(F.col("best.sid").alias(chosen), F.col("best.min_id").alias(id_))
    of_best = (F.col(chosen) == F.col("sid")) & F.col(id_).eqNullSafe(F.col("doc_id"))
    kept = stash(best.join(copies.withColumnRenamed("__rows", rows), of_best).select(chosen, id_, rows))
    has_set = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())])
    named = docs.filter(has_set).mapInArrow(lambda it: _add_sid(it, own), schema)
    on = (F.col(own) == F.col(chosen)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_))
    out = named.join(kept.select(chosen, id_).hint("shuffle_hash"), on, "left_semi")
    if not kept.filter(F.col(rows) > 1).isEmpty():
        out = out.dropDuplicates(["doc_id", own])
    return out.drop(own).unionByName(docs.filter(~has_set))
