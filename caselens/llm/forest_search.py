"""Nearest vectors by inner product: a forest of random-projection trees, one priority queue over all of them, exact reranking.

Vectors that are equal are one class with the smallest k + 1 of its ids, all that
any list of k neighbours can need; so copies cost nothing and lose nothing. A
class gets one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, and
queries get 0: the largest inner product is then the least distance.

Trees. The directions of a tree are random and at right angles, one for each
level; a node splits where the median of its rows in a bounded sample
(SAMPLE classes, by hash) lies. Every class goes to one leaf of each tree.

Search. A query's queue starts with all roots. It pops the node with the least
squared distance to the query's place and pushes its children, of whichever
tree, until the leaves it has popped hold ``budget`` rows. The budget is set by
recall: for some queries (CALIBRATION classes, by hash) the exact neighbours are
found by a scan of all rows, and the budget is what lets the queue reach RECALL
of them. It grows with the data if neighbours are hard to find.

Leaves are dealt into blocks of about BLOCK rows; a leaf with more than that is
cut into several. A query goes once to each block in which it has a leaf. Blocks
with many queries get several copies, so no task holds a hot block's queries.
Each block keeps a query's best k + 1 classes by the exact score, the product
summed over coordinates in order, in double precision; so scores agree wherever
they are computed, and ties go to smaller ids.

Edge cases: a vector that is null, empty, zero, or holds null or non-finite
components takes no part, nor does one of another length than most have (ties: the
shorter). A query's own row is no candidate for it; if one vec_id has several
vectors, the least is its query and the others are candidates like all rows;
rows repeated with vec_id count once. A null vec_id is no query; as a candidate
it comes after all others of its score. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import look_up, partitions, sampled, small_batches, stash
from .vector_codes import finite

TREES = 8
#: Rows a leaf holds, about, where the sample suffices.
LEAF = 256
#: Classes that the trees are fitted on, at most; a leaf has at least 16 of them.
SAMPLE = 16_384
#: Query classes whose exact neighbours set the budget, at most, and the share of those that must be reached.
CALIBRATION = 128
RECALL = 0.96
#: Bytes of a block's vectors, on average, and queries that one copy of a block serves.
BLOCK_BYTES = 1 << 24
BLOCK_QUERIES = 100_000
#: Queries scored at a time.
CHUNK = 512
#: Relative difference up to which scores of matrix products are looked at again.
SLACK = 1e-9


class Forest:
    """Directions (tree, level, coordinate), a threshold for each node by level and place, and, once counted, the rows of each leaf."""

    def __init__(self, sample: np.ndarray, most: float, depth: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.most, self.depth, self.trees = most, depth, trees
        self.directions = np.stack([_directions(rng, depth, sample.shape[1] + 1) for _ in range(trees)])
        self.cuts = [np.zeros((trees, 1 << level)) for level in range(depth)]
        places = self.project(self.extended(sample))
        for t in range(trees):
            leaf = np.zeros(len(sample), np.int64)
            for level in range(depth):
                order = np.argsort(leaf, kind="stable")
                edges = np.searchsorted(leaf[order], np.arange((1 << level) + 1))
                for node, (a, b) in enumerate(zip(edges, edges[1:])):
                    self.cuts[level][t, node] = np.median(places[order[a:b], t, level]) if b > a else 0.0
                leaf = 2 * leaf + (places[:, t, level] > self.cuts[level][t, leaf])
        self.sizes = np.zeros((trees, 1 << depth), np.int64)

    def extended(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.most - np.einsum("ij,ij->i", vectors, vectors)
        return np.column_stack([vectors, np.sqrt(np.maximum(rest, 0.0))])

    def project(self, extended: np.ndarray) -> np.ndarray:
        """Places along the directions: (row, tree, level)."""
        flat = self.directions.reshape(self.trees * self.depth, self.directions.shape[2])
        return (extended @ flat.T).reshape(len(extended), self.trees, self.depth)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        places = self.project(self.extended(vectors))
        leaf, tree = np.zeros(places.shape[:2], np.int64), np.arange(self.trees)
        for level in range(self.depth):
            leaf = 2 * leaf + (places[:, :, level] > self.cuts[level][tree, leaf])
        return leaf

    def search(self, query: np.ndarray, budget: int, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until their rows are ``budget`` and those of one tree ``least``, or all leaves."""
        places = self.project(np.append(query, 0.0)[None])[0].tolist()
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        found, rows, of = [], 0, [0] * self.trees
        while queue and (rows < budget or max(of) < least):
            far, t, level, node = heapq.heappop(queue)
            if level == self.depth:
                n = int(self.sizes[t, node])
                if n:
                    found.append((t, node))
                    rows += n
                    of[t] += n
                continue
            gap = places[t][level] - self.cuts[level][t, node]
            near = int(gap > 0)
            heapq.heappush(queue, (far, t, level + 1, 2 * node + near))
            heapq.heappush(queue, (far + gap * gap, t, level + 1, 2 * node + 1 - near))
        return found


def _directions(rng: np.random.Generator, depth: int, length: int) -> np.ndarray:
    """Random unit vectors, at right angles as far as the space allows."""
    drawn = [np.linalg.qr(rng.normal(size=(length, length)))[0].T for _ in range(-(-depth // length))]
    return np.concatenate(drawn)[:depth] if drawn else np.zeros((0, length))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pair_scores(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed over coordinates in order, so that each is the same wherever it is computed."""
    total = np.zeros(len(q))
    for k in range(vectors.shape[1]):
        total += queries[q, k] * vectors[m, k]
    return total


def _top(group: np.ndarray, *keys: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k of each group by keys, the first key first; sorted by group."""
    order = np.lexsort((*keys[::-1], group))
    sizes = np.bincount(group[order]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[place < k]


def _close(rough: np.ndarray, k: int) -> np.ndarray:
    """Where a row's scores, right up to rounding, may be among its k largest."""
    if rough.shape[1] <= k:
        return np.isfinite(rough)
    cut = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
    return (rough >= (cut - SLACK * np.maximum(1.0, np.abs(cut)))[:, None]) & np.isfinite(rough)


# --- classes ----------------------------------------------------------------------------------


def _valid(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v) that take part, v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select("vec_id", v.alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.filter(F.size("v") == (usual[0] if usual else 0)).withColumn("key", F.unhex(F.sha2(F.col("v").cast("string"), 256)))


def classes(rows: DataFrame, k: int, is_query: Column) -> DataFrame:
    """(key, ids, v, asks) of distinct vectors: the smallest k + 1 ids, null last, and whether any of its rows is a query."""
    order = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.select("key", "vec_id").distinct().withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k + 1)
    ids = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("__n", "vec_id"))).alias("ids"))
    one = rows.groupBy("key").agg(F.first("v").alias("v"), F.max(F.coalesce(is_query, F.lit(False))).alias("asks"))
    return one.join(ids, "key").select("key", F.col("ids.vec_id").alias("ids"), "v", "asks")


_CLASS = "key binary, ids array<bigint>, v array<double>, asks boolean"
_NO_ID = np.iinfo(np.int64).max


def _first_ids(column: pa.Array) -> np.ndarray:
    """The smallest id of each class; null counts as larger than any."""
    ids = column.flatten().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    return ids[np.asarray(column.offsets)[:-1] - np.asarray(column.offsets)[0]]


def _reach(forest: Forest, query: np.ndarray, leaves: np.ndarray) -> list[int]:
    """How many rows the queue has seen when it first reaches each of the rows with these leaves (row, tree)."""
    seen, at = 0, {}
    for t, leaf in forest.search(query, np.iinfo(np.int64).max, 0):
        seen += int(forest.sizes[t, leaf])
        at[t, leaf] = seen
    return [min(at[t, int(leaf)] for t, leaf in enumerate(row)) for row in leaves]


def nearest_by_scan(table: DataFrame, queries: list[tuple[bytes, list[float]]], k: int) -> DataFrame:
    """(ask, key, score, ids, leaves) of the best k classes of other keys for each of some queries, given by key, against all rows of indexed()."""
    asked, keys = np.array([q for _, q in queries]), [key for key, _ in queries]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, own = _matrix(batch.column("v")), {key: i for i, key in enumerate(batch.column("key").to_pylist())}
            rough = asked @ vectors.T
            for a, key in enumerate(keys):
                if key in own:
                    rough[a, own[key]] = -np.inf
            q, m = np.nonzero(_close(rough, k))
            columns = [pa.array(q.astype(np.int32)), batch.column("key").take(pa.array(m)), pa.array(_pair_scores(asked, vectors, q, m))]
            new = pa.Table.from_arrays([*columns, *(batch.column(c).take(pa.array(m)) for c in ("ids", "leaves"))], names=["ask", "key", "score", "ids", "leaves"])
            best = (new if best is None else pa.concat_tables([best, new])).combine_chunks()
            first = _first_ids(best.column("ids").combine_chunks())
            best = best.take(pa.array(_top(best.column("ask").to_numpy(), -best.column("score").to_numpy(), first, k=k)))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    found = table.select("key", "ids", "v", "leaves").mapInArrow(scan, "ask int, key binary, score double, ids array<bigint>, leaves array<int>")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), F.get("ids", F.lit(0)).asc_nulls_last(), "key"))
    return found.withColumn("__n", rank).filter(F.col("__n") <= k).drop("__n")


# --- the index --------------------------------------------------------------------------------


def fit(table: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, trees: int = TREES) -> Forest:
    """The forest of a stashed table of classes(), without leaf sizes."""
    n, most = table.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    rows = [r[0] for r in sampled(table, F.col("key"), sample).select("v").collect()]
    depth = 0
    while (2 << depth) * leaf <= n and (2 << depth) * 16 <= len(rows):
        depth += 1
    return Forest(np.array(rows, np.float64), most, depth, trees)


def indexed(table: DataFrame, forest: Forest) -> DataFrame:
    """The classes with ``leaves``, one for each tree; sets the forest's leaf sizes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = forest.leaves(_matrix(batch.column("v"))).astype(np.int32)
                offsets = np.arange(0, found.size + 1, forest.trees, dtype=np.int32)
                yield batch.append_column("leaves", pa.ListArray.from_arrays(offsets, found.ravel()))

    out = stash(table.mapInArrow(place, f"{_CLASS}, leaves array<int>"))
    for t, leaf, n in out.select(F.posexplode("leaves")).groupBy("pos", "col").count().collect():  # trees x leaves
        forest.sizes[t, leaf] = n
    return out


def budget_for(table: DataFrame, forest: Forest, k: int, recall: float = RECALL, most: int = CALIBRATION) -> int:
    """The rows that a queue must see to reach ``recall`` of the exact neighbours of some of the queries."""
    asked = [(bytes(r[0]), r[1]) for r in sampled(table.filter("asks"), F.col("key"), most).select("key", "v").collect()]
    if not asked:
        return 0
    found = nearest_by_scan(table, asked, k).select("ask", "leaves").collect()
    seen = sorted(x for r in found for x in _reach(forest, np.array(asked[r.ask][1]), np.array([r.leaves])))
    return seen[min(len(seen) - 1, int(np.ceil(recall * len(seen))))] if seen else 0


# --- search -----------------------------------------------------------------------------------


def _blocks(forest: Forest, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each leaf: small leaves share one, large ones are cut."""
    first, pieces, at, filled = np.zeros_like(forest.sizes), np.ones_like(forest.sizes), 0, 0
    for t in range(forest.trees):
        for leaf, n in enumerate(forest.sizes[t]):
            if n > block:
                at, filled = at + (filled > 0), 0
                first[t, leaf], pieces[t, leaf] = at, -(-n // block)
                at += int(pieces[t, leaf])
                continue
            if filled + n > block:
                at, filled = at + 1, 0
            first[t, leaf] = at
            filled += int(n)
        at, filled = at + (filled > 0), 0
    return first, pieces


_ROW = "block bigint, part int, kind int, key binary, ids array<bigint>, v array<double>, leaves array<int>"
_FOUND = "ask binary, score double, ids array<bigint>, key binary"


def _visits(table: DataFrame, forest: Forest, budget: int, k: int, first: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """(block, key, v, leaves) of each query and block in which its queue popped leaves."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, blocks, leaves = [], [], []
            for i, query in enumerate(_matrix(batch.column("v")) if batch.num_rows else []):
                met: dict[int, list[int]] = {}
                for t, leaf in forest.search(query, budget, k + 1):
                    for b in range(int(first[t, leaf]), int(first[t, leaf] + pieces[t, leaf])):
                        met.setdefault(b, []).append(leaf)
                row += [i] * len(met)
                blocks += met
                leaves += met.values()
            own = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), own.column("key"), own.column("v"), pa.array(leaves, pa.list_(pa.int32()))],
                names=["block", "key", "v", "leaves"],
            )

    return table.filter("asks").select("key", "v").mapInArrow(visit, "block bigint, key binary, v array<double>, leaves array<int>")


def _score_blocks(k: int):
    """The kernel over partitions sorted by block, part and kind: members of a block are held, its queries stream past them."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, members = None, [], None
        for batch in batches:
            blocks, parts, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "kind"))
            changes = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *changes], [*changes, batch.num_rows]):
                if b <= a:
                    continue
                piece = batch.slice(a, b - a)
                if own != (blocks[a], parts[a]):
                    own, held, members = (blocks[a], parts[a]), [], None
                if kinds[a] == 0:
                    held.append(piece)
                    continue
                if members is None and held:
                    members, held = _Block(pa.Table.from_batches(held)), []
                for c in range(0, piece.num_rows if members else 0, CHUNK):
                    yield members.best(piece.slice(c, CHUNK), k)

    return score


class _Block:
    """Members of a block, by leaf."""

    def __init__(self, rows: pa.Table):
        leaf = rows.column("leaves").combine_chunks().flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.rows = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
        self.leaves, begin = np.unique(leaf[order], return_index=True)
        self.edges = np.append(begin, len(leaf))
        self.vectors, self.first = _matrix(self.rows.column("v")), _first_ids(self.rows.column("ids"))

    def best(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """(ask, score, ids, key) of the best k + 1 members of each query, among the leaves that it visits."""
        queries, visits = _matrix(asked.column("v")), asked.column("leaves")
        who = np.repeat(np.arange(len(asked)), np.diff(np.asarray(visits.offsets)))
        leaf = visits.flatten().to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at, a, b in zip(self.leaves, self.edges, self.edges[1:]):
            q = who[leaf == at]
            if len(q):
                rough = queries[q] @ self.vectors[a:b].T
                i, j = np.nonzero(_close(rough, k + 1))
                found.append((q[i], a + j, rough[i, j]))
        q, m, rough = (np.concatenate(x) for x in zip(*found))
        cut = np.full(len(asked), -np.inf)
        last = _top(q, -rough, k=k + 1)
        np.minimum.at(low := np.full(len(asked), np.inf), q[last], rough[last])
        full = np.bincount(q, minlength=len(asked)) > k + 1
        cut[full] = low[full] - SLACK * np.maximum(1.0, np.abs(low[full]))
        near = rough >= cut[q]
        q, m = q[near], m[near]
        exact = _pair_scores(queries, self.vectors, q, m)
        kept = _top(q, -exact, self.first[m], k=k + 1)
        mine, row = pa.array(q[kept]), pa.array(m[kept])
        return pa.RecordBatch.from_arrays(
            [asked.column("key").take(mine), pa.array(exact[kept]), self.rows.column("ids").take(row), self.rows.column("key").take(row)],
            names=["ask", "score", "ids", "key"],
        )


def search(
    table: DataFrame, forest: Forest, budget: int, k: int, block_bytes: int = BLOCK_BYTES, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(ask, score, ids, key): the best k + 1 classes that each query class found, itself among them."""
    spark = table.sparkSession
    first, pieces = _blocks(forest, max(1, block_bytes // (8 * forest.directions.shape[2])))
    visits = stash(_visits(table, forest, budget, k, first, pieces))
    copies = stash(visits.groupBy("block").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("copies")))
    places = spark.createDataFrame(
        [(t, leaf, int(first[t, leaf]), int(pieces[t, leaf])) for t in range(forest.trees) for leaf in range(1 << forest.depth)],
        "tree int, leaf int, first bigint, pieces int",
    )  # trees x leaves, bounded by the sample
    members = table.select("key", "ids", "v", F.posexplode("leaves").alias("tree", "leaf")).join(F.broadcast(places), ["tree", "leaf"])
    members = members.withColumn("block", F.col("first") + F.pmod(F.xxhash64("key"), F.col("pieces")))
    members = members.join(copies, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.lit(0).alias("kind"), "key", "ids", "v", F.array("leaf").alias("leaves"),
    )
    asked = visits.join(copies, "block").select(
        "block", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int").alias("part"), F.lit(1).alias("kind"), "key",
        F.lit(None).cast("array<bigint>").alias("ids"), "v", "leaves",
    )
    met = members.unionByName(asked).repartition(partitions(spark), "block", "part").sortWithinPartitions("block", "part", "kind")
    found = met.mapInArrow(_score_blocks(k), _FOUND)
    order = [F.col("score").desc(), F.get("ids", F.lit(0)).asc_nulls_last(), F.col("key")]
    best = found.withColumn("__n", F.dense_rank().over(Window.partitionBy("ask").orderBy(*order))).filter(F.col("__n") <= k + 1)
    return best.drop("__n").dropDuplicates(["ask", "key"])


def forest_search(vectors: DataFrame, k: int = 20, is_query: Column | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query; by default, rows whose vec_id 20 divides are queries."""
    rows = stash(_valid(small_batches(vectors)))
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query & F.col("vec_id").isNotNull()
    table = stash(classes(rows, k, is_query))
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if table.filter("asks").isEmpty():
        return vectors.sparkSession.createDataFrame([], empty)
    forest = fit(table)
    table = indexed(table, forest)
    found = search(table, forest, budget_for(table, forest, k, recall), k)
    found = found.select("ask", "score", "key", (F.col("ask") == F.col("key")).alias("own"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "key")
    best = found.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k + 1)
    lists = best.groupBy(F.col("ask").alias("key")).agg(F.array_sort(F.collect_list(F.struct("__n", "vec_id", "score", "own"))).alias("list"))
    asking = stash(rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("key", "v").alias("key")))
    lists = stash(lists.join(asking.groupBy("key").agg(F.count("*").alias("n")), "key"))
    both = look_up(asking, lists, "key", "n", asking.count())
    others = F.filter("list", lambda x: ~(x["own"] & x["vec_id"].eqNullSafe(F.col("query_id"))))
    ranked = both.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
