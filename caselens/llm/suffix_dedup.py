"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``length`` bytes covers it that starts anywhere else
as well. Texts are UTF-8; matches stay within a document. A shorter length,
``report``, is looked at along with it: the bytes that strings of this length
would cover are counted, and stay. Passages of some fifty words are found so,
many of which have fewer than ``length`` bytes.

1. Equal texts are one text from the start; one with copies goes as a whole.
2. Anchors: the least hash of K bytes in every run of report - K + 1 positions.
   Every string of ``report`` bytes holds one, at the same place wherever the
   string occurs. Only anchors whose hash occurs again go on.
3. Each task takes the suffixes at its anchors, cut to ``length`` bytes, sorts
   them, front-codes the run (length of the prefix shared with the one before,
   and the rest) and sends it, cut by sampled splitters, to the mergers.
4. A merger combines the runs with a loser tree that keeps, for each loser, the
   prefix it shares with the winner; bytes of known prefixes are never compared
   again. The merged order comes with the common prefix of neighbours.
5. Among suffixes that share K bytes, the order of the texts to their left is
   known too. Joining neighbours from the longest common prefix r down, each
   gets the longest left match l among those it shares r bytes with; what has
   l + r >= length (or report) is covered. This finds every pair without listing
   pairs.

Anchors with more than MAX_GROUP occurrences (of different texts) do not meet
in one task: for these, each string of either length around the anchor is
hashed to 128 bits and counted with a partial aggregation, which is linear.
Tables of counts are written before they are joined, so that adaptive execution
sees both sides and splits the rows of a very common hash over many tasks.

Edge cases: null counts as empty; texts shorter than ``length`` lose nothing;
tables without doc_id or text are refused; other columns are not read;
rows repeated with doc_id are copies of each other; a null doc_id is a row like
others; cuts may fall within a character, so what is kept is bytes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_bucket, look_up, runs, small_batches, stash, text_or_empty
from ._text import _BASE, mix, prefix_hash, slices, utf8

LENGTH = 400
#: Strings of so many bytes are counted where they repeat: fifty short words.
REPORT = 240
K = 64
#: Suffixes that share K bytes in one merger, at most; more go the other way.
MAX_GROUP = 20_000
#: Bytes of suffixes for one merger, on average, and the splitters' sample.
MERGE_BYTES = 8 << 20
SAMPLE = 100_000
_KEYS = ["k1", "k2"]


# --- anchors ----------------------------------------------------------------------------------


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all texts of a buffer."""
    n, w = len(buf), length - k + 1
    starts = offsets[:-1][np.diff(offsets) >= length]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, undo = prefix_hash(buf)
    h = mix((sums[k:] - sums[: n - k + 1]) * undo[: n - k + 1])
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes, the leftmost is least
    padded = np.full(-(-len(keyed) // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    whole = np.zeros(n + 1, np.int8)  # windows that lie within a text
    long = np.diff(offsets) >= length
    whole[offsets[:-1][long]] += 1
    whole[offsets[1:][long] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
    least = np.minimum(behind[windows], ahead[windows + w - 1])
    at = np.unique((least & low).astype(np.int64))
    return at, h[at]


def _send_anchors(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, "text", 1 << 20):
        buf, offsets = utf8(batch.column("text"))
        at, h = anchors(buf, offsets, length, k)
        owner = np.searchsorted(offsets, at, side="right") - 1
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        fresh = np.zeros(batch.num_rows, bool)
        for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
            if key not in seen:
                seen.add(key)
                fresh[i] = True
        own = fresh[owner]
        at, h, owner = at[own], h[own], owner[own]
        if len(seen) > 1_000_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(k1[owner]), pa.array(k2[owner]), pa.array(at - offsets[owner])],
            names=["h", "k1", "k2", "p"],
        )


# --- runs of suffixes -------------------------------------------------------------------------

_ITEM = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("p", "<i8"), ("shared", "<u4"), ("rest", "<u4"), ("left", "<u4")])


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(run: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, reversed left context, k1, k2, p)."""
    items, rests, lefts, before = np.zeros(len(run), _ITEM), [], [], b""
    for i, (suffix, left, k1, k2, p) in enumerate(run):
        shared = shared_prefix(before, suffix)
        rests.append(suffix[shared:])
        lefts.append(left)
        items[i] = k1, k2, p, shared, len(suffix) - shared, len(left)
        before = suffix
    return len(run).to_bytes(4, "little") + items.tobytes() + b"".join(rests) + b"".join(lefts)


def decode(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(prefix shared with the one before, suffix, left, k1, k2, p) in order."""
    n = int.from_bytes(blob[:4], "little")
    items = np.frombuffer(blob, _ITEM, n, 4)
    at = 4 + n * _ITEM.itemsize
    lefts = at + int(items["rest"].sum())
    before = b""
    for k1, k2, p, shared, rest, left in items.tolist():
        before = before[:shared] + blob[at : at + rest]
        yield shared, before, blob[lefts : lefts + left], k1, k2, p
        at += rest
        lefts += left


class LoserTree:
    """Merges sorted runs. Each loser is kept with the prefix it shares with the winner of its match.

    Of two heads with known shares to the last output, the one that shares more
    is the lesser; only for equal shares are bytes compared, from there on.
    """

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.size = 1
        while self.size < len(sources):
            self.size *= 2
        self.heads: list = [next(s, None) for s in sources] + [None] * (self.size - len(sources))
        self.shares = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, lost = self._match(self._play(2 * node), self._play(2 * node + 1))
        self.losers[node] = lost
        return won

    def _match(self, a: int, b: int) -> tuple[int, int]:
        heads, shares = self.heads, self.shares
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y, k = heads[a][1], heads[b][1], shares[a]
        if k:
            x, y = x[k:], y[k:]
        more = shared_prefix(x, y)
        won, lost = (a, b) if x[more:] <= y[more:] else (b, a)
        shares[lost] = k + more
        return won, lost

    def __iter__(self) -> Iterator[tuple]:
        """(prefix shared with the last output, suffix, left, k1, k2, p)."""
        while (head := self.heads[self.winner]) is not None:
            at = self.winner
            yield (self.shares[at], *head[1:])
            new = self.heads[at] = next(self.sources[at], None)
            self.shares[at] = new[0] if new is not None else 0
            won, node = at, (at + self.size) // 2
            while node:
                other = self.losers[node]
                won, self.losers[node] = self._match(won, other)
                node //= 2
            self.winner = won


def _contexts(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    reach = length - k
    for batch in batches:
        for text, k1, k2, places in zip(
            batch.column("text").to_pylist(), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
            batch.column("places").to_pylist(),
        ):
            raw = text.encode()
            for p in places:
                yield raw[p : p + length], raw[max(0, p - reach) : p][::-1], k1, k2, p


def _send_runs(
    batches: Iterator[pa.RecordBatch], splitters: list[bytes], length: int, k: int, hold: int = 25_000,
) -> Iterator[pa.RecordBatch]:
    part, number, run = TaskContext.get().partitionId(), 0, []

    def out():
        run.sort()
        rows, a = [], 0
        while a < len(run):
            bucket = bisect.bisect_right(splitters, run[a][0][:k])
            b = bisect.bisect_left(run, (splitters[bucket],), a) if bucket < len(splitters) else len(run)
            rows.append((bucket, front_code(run[a:b])))
            a = b
        run.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x for x, _ in rows], pa.int32()), pa.array([(part << 20) + number] * len(rows), pa.int64()),
                pa.array([x for _, x in rows], pa.binary()),
            ],
            names=["bucket", "run", "blob"],
        )

    for item in _contexts(batches, length, k):
        run.append(item)
        if len(run) >= hold:
            yield out()
            number += 1
    yield out()


# --- coverage ---------------------------------------------------------------------------------


def cover(group: list[tuple[int, bytes, bytes]], *lengths: int) -> list[list[tuple[int, int]]]:
    """group: (prefix shared with the one before, suffix, left) of suffixes that share K bytes, in order.

    For each length, (l, r) for each: the bytes covered to the left and to the right of its place; (0, 0) for none.
    """
    n = len(group)
    found = [[(0, 0)] * n for _ in lengths]
    least = min(lengths)
    order = sorted(range(n), key=lambda i: group[i][2])
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    sets: list[list[int] | None] = [[rank[i]] for i in range(n)]
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def meet(a: int, b: int, r: int) -> None:
        i, j = order[a], order[b]
        left = shared_prefix(group[i][2], group[j][2])
        if left + r < least:
            return
        for length, own in zip(lengths, found):
            if left + r >= length:
                for x in (i, j):
                    if left > own[x][0] or r > own[x][1]:
                        own[x] = (max(own[x][0], left), max(own[x][1], r))

    for i in sorted(range(1, n), key=lambda i: -group[i][0]):
        r, a, b = group[i][0], find(i - 1), find(i)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        into = sets[a]
        for x in sets[b]:
            at = bisect.bisect_left(into, x)
            if at:
                meet(into[at - 1], x, r)
            if at < len(into):
                meet(x, into[at], r)
            into.insert(at, x)
        sets[b] = None
        up[b] = a
    return found


def _groups(items: Iterator[tuple], k: int) -> Iterator[list[tuple]]:
    group: list[tuple] = []
    for item in items:
        if group and item[0] < k:
            yield group
            group = []
        group.append(item)
    if group:
        yield group


def _merge(batches: Iterator[pa.RecordBatch], length: int, report: int, k: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, a, b, goes): covered stretches around each suffix; goes: by strings of length, otherwise of report."""
    for table in runs(batches, "bucket", 1):
        blobs = defaultdict(list)
        for bucket, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist()):
            blobs[bucket].append(blob)
        rows = []
        for bucket in sorted(blobs):
            for group in _groups(iter(LoserTree([decode(x) for x in blobs[bucket]])), k):
                if len(group) < 2:
                    continue
                distinct: dict[tuple[bytes, bytes], list[tuple]] = {}
                shares, share = [], 0
                for item in group:  # equal contexts are one, covered by each other
                    share = item[0] if not distinct else min(share, item[0])
                    if (own := distinct.get((item[1], item[2]))) is not None:
                        own.append(item)
                        continue
                    distinct[item[1], item[2]] = [item]
                    shares.append(share)
                    share = length
                keys = list(distinct)
                found = cover([(s, *key) for s, key in zip(shares, keys)], length, report) if len(keys) > 1 else [[(0, 0)]] * 2
                for i, key in enumerate(keys):
                    around, whole, before = distinct[key], (len(key[1]), len(key[0])), (0, 0)
                    for least, own, goes in ((length, found[0], True), (report, found[1], False)):
                        left, right = whole if len(around) > 1 and sum(whole) >= least else own[i]
                        if right and (left, right) != before:
                            rows += [(k1, k2, p - left, p + right, goes) for *_, k1, k2, p in around]
                        before = left, right
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(),) * 4 + (pa.bool_(),))],
            names=["k1", "k2", "a", "b", "goes"],
        )


def _send_windows(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of length bytes that holds one of the places, for anchors with too many suffixes."""
    for batch in batches:
        for text, k1, k2, places in zip(
            batch.column("text").to_pylist(), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
            batch.column("places").to_pylist(),
        ):
            buf = np.frombuffer(text.encode(), np.uint8)
            wanted = np.zeros(len(buf) + 1, np.int32)
            for p in places:
                wanted[max(0, p + k - length)] += 1
                wanted[max(0, min(p, len(buf) - length) + 1)] -= 1
            at = np.flatnonzero(np.cumsum(wanted)[: max(0, len(buf) - length + 1)] > 0)
            sums, undo = prefix_hash(buf)
            one = mix((sums[at + length] - sums[at]) * undo[at])
            sums, undo = prefix_hash(mix(buf.astype(np.uint64) + np.uint64(_BASE)).astype(np.uint8))
            two = mix((sums[at + length] - sums[at]) * undo[at] + np.uint64(1))
            same = np.full(len(at), 0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (one.view(np.int64), two.view(np.int64), same + k1, same + k2, at, same + length)],
                names=["h1", "h2", "k1", "k2", "a", "size"],
            )


def _union(stretches: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted stretches, those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_CUT = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64()))), ("n_repeated", pa.int64())]
)
_CUT_DDL = "k1 bigint, k2 bigint, kept binary, spans array<array<bigint>>, n_repeated bigint"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, the spans that go, and the bytes that repeated strings of the shorter length cover."""
    for batch in batches:
        rows = []
        for text, k1, k2, found in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2", "found"))):
            raw, at, kept = text.encode(), 0, []
            spans = _union([(x["a"], x["b"]) for x in found if x["goes"]])
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append((k1, k2, b"".join(kept), spans, sum(b - a for a, b in _union([(x["a"], x["b"]) for x in found]))))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, _CUT)], schema=_CUT)


# --- the operator -----------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), sha (hex) and, from it, 128 bits as two longs."""
    sha = small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"),
    ).withColumn("sha", F.sha2("text", 256))
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("bigint")
    return sha.withColumns({"k1": half(1), "k2": half(17)})


def covered(
    docs: DataFrame, length: int = LENGTH, k: int = K, max_group: int = MAX_GROUP, report: int = REPORT,
) -> tuple[DataFrame, DataFrame]:
    """(texts, stretches): distinct texts that hold repeated anchors, as k1, k2, text, places; and k1, k2, a, b, goes."""
    spark = docs.sparkSession
    report = min(report, length)
    own = keyed(docs)
    long = own.filter(F.octet_length("text") >= report).select("k1", "k2", "text")
    places = stash(long.mapInArrow(lambda it: _send_anchors(it, report, k), "h bigint, k1 bigint, k2 bigint, p bigint").distinct())
    counts = stash(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    usual_place, hot_place = F.when(F.col("n") <= max_group, F.col("p")), F.when(F.col("n") > max_group, F.col("p"))
    again = places.join(counts, "h").groupBy("k1", "k2").agg(
        F.collect_list(usual_place).alias("places"), F.collect_list(hot_place).alias("hot"),
    )
    chosen = own.select("doc_id", "k1", "k2").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).join(again, _KEYS)
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.k1") == F.col("c.k1")) & (F.col("t.k2") == F.col("c.k2"))
    found = own.select("doc_id", "k1", "k2", "text").alias("t").join(chosen.alias("c").hint("shuffle_hash"), same)
    texts = stash(found.select("t.k1", "t.k2", "t.text", "places", "hot"))

    usual = texts.filter(F.size("places") > 0).select("k1", "k2", "text", "places")
    suffixes = usual.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(1, suffixes * 2 * length // MERGE_BYTES)
    splitters: list[bytes] = []
    if buckets > 1:
        rate = min(1.0, SAMPLE / max(1, suffixes))
        some = F.pmod(F.xxhash64("k1", "k2", "p"), F.lit(1 << 20)) < int(rate * (1 << 20))
        heads = usual.select(F.explode("places").alias("p"), "k1", "k2", "text").filter(some)
        head = F.substring(F.encode("text", "UTF-8"), F.col("p").cast("int") + 1, F.lit(k))
        sampled = sorted(r[0] for r in heads.select(head.alias("s")).collect())
        splitters = sorted({bytes(sampled[i * len(sampled) // buckets]) for i in range(1, buckets)}) if sampled else []
    shared = spark.sparkContext.broadcast(splitters)
    sent = usual.mapInArrow(lambda it: _send_runs(it, shared.value, length, k), "bucket int, run bigint, blob binary")
    stretches = by_bucket(sent).mapInArrow(
        lambda it: _merge(it, length, report, k), "k1 bigint, k2 bigint, a bigint, b bigint, goes boolean",
    )

    hot = texts.filter(F.size("hot") > 0).select("k1", "k2", "text", F.col("hot").alias("places"))
    if not hot.isEmpty():
        ddl = "h1 bigint, h2 bigint, k1 bigint, k2 bigint, a bigint, size bigint"
        each = [hot.mapInArrow(lambda it, size=size: _send_windows(it, size, k), ddl) for size in sorted({length, report})]
        windows = stash(each[0] if len(each) == 1 else each[0].unionByName(each[1]))
        twice = stash(windows.groupBy("size", "h1", "h2").count().filter("count > 1").select("size", "h1", "h2"))
        again = windows.join(twice, ["size", "h1", "h2"])
        stretches = stretches.unionByName(
            again.select("k1", "k2", "a", (F.col("a") + F.col("size")).alias("b"), (F.col("size") == length).alias("goes"))
        )
    return texts, stash(stretches)


def _cuts(docs: DataFrame, length: int, k: int, max_group: int, report: int) -> DataFrame:
    """_CUT of each distinct text that has a covered stretch."""
    texts, stretches = covered(docs, length, k, max_group, report)
    lists = stretches.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "goes")).alias("found"))
    both = texts.select("k1", "k2", "text").join(lists.hint("shuffle_hash"), _KEYS)
    return both.select("k1", "k2", "text", "found").mapInArrow(_cut, _CUT_DDL).dropDuplicates(_KEYS)


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (doc_id, k1, k2, ...) with ``copies`` of their text and the columns of its cut.

    Only texts with copies or cuts have values worth joining; texts with very many copies are broadcast. A text
    that has copies needs no bytes: it goes as a whole, or is too short for a cut.
    """
    meta = stash(rows.select("k1", "k2"))
    values = stash(meta.groupBy(*_KEYS).agg(F.count("*").alias("copies")).join(cuts, _KEYS, "left"))
    key = F.concat_ws(" ", F.col("k1"), F.col("k2"))
    wanted = values.filter("copies > 1 OR n_repeated IS NOT NULL").withColumn("key", key).drop(*_KEYS)
    return look_up(rows.withColumn("key", key), wanted, "key", "copies", meta.count())


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, max_group: int = MAX_GROUP, report: int = REPORT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes that repeated strings of ``report`` bytes cover)."""
    cut = _cuts(docs, length, k, max_group, report)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    digests = stash(
        cut.select(
            "k1", "k2", removed.alias("n_removed"), F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated",
        )
    )
    found = _with_cuts(
        stash(keyed(docs).select("doc_id", "k1", "k2", "sha", F.octet_length("text").cast("bigint").alias("n_bytes"))), digests,
    )
    copied = lambda least: (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    whole, empty = copied(length), hashlib.sha256().hexdigest()
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copied(min(report, length)), F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).alias("n_repeated"),
    )


def deduplicated(docs: DataFrame, length: int = LENGTH, k: int = K, max_group: int = MAX_GROUP) -> DataFrame:
    """Per document: doc_id, kept (its bytes that stay) and spans (arrays of start and end, in bytes, of those that go)."""
    cuts = stash(_cuts(docs, length, k, max_group, length).select("k1", "k2", "kept", "spans", "n_repeated"))
    found = _with_cuts(keyed(docs).select("doc_id", "k1", "k2", F.encode("text", "UTF-8").alias("raw")), cuts)
    n = F.octet_length("raw").cast("bigint")
    whole = (F.col("copies") > 1) & (n >= length)
    all_of_it = F.array(F.array(F.lit(0).cast("bigint"), n))
    kept = F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "raw"))
    return found.select(
        "doc_id", kept.alias("kept"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<array<bigint>>"))).alias("spans"),
    )
