import math
import random

import numpy as np
import pytest

from caselens.llm import forest_search as fs

SCHEMA = "vec_id long, embedding array<float>, label int"


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, k=20):
    """Every query against every row; a row twice counts once."""
    kept = {(i, tuple(float(np.float32(x)) for x in v)) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    lengths = [len(v) for _, v in kept]
    kept = {x for x in kept if len(x[1]) == max(lengths, key=lengths.count)}
    out = set()
    for q in {i for i, _ in kept if i is not None and i % 20 == 0}:
        own = min(v for i, v in kept if i == q)
        found = sorted((-dot(own, v), i is None, i or 0) for i, v in kept if (i, v) != (q, own))[:k]
        out |= {(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(found, 1)}
    return out


def clustered(n, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    return centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, dims))


def awkward(n=300):
    rng = random.Random(4)
    vectors = clustered(n, 8).round(2).tolist()
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    rows += [(n + i, vectors[40], None) for i in range(n)]  # a third of all rows, and more than k copies
    rows += [(None, vectors[40], 1), (None, vectors[41], 1), (60, vectors[7], 1), (80, vectors[80], 1), (81, vectors[81], 2)]
    rows += [(3000, None, 1), (3020, [0.0] * 8, 1), (3040, [None] + [1.0] * 7, 1), (3060, [math.nan] * 8, 1), (3080, [math.inf] * 8, 1), (3100, [], 1), (3120, [1.0] * 7, 1)]
    rng.shuffle(rows)
    return rows


def result(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    rows = list(map(tuple, df.collect()))
    assert len(rows) == len(set(rows))
    return set(rows)


def test_awkward_rows_equal_brute_force_with_full_recall(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS key", "'x' AS ids", "3 AS asks", "4 AS leaves")
    assert result(fs.forest_search(df, recall=1.0)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_rows(spark, n):
    rows = [(20 * i, [1.0 + i, 2.0, float(i % 2)], 1) for i in range(n)]
    assert result(fs.forest_search(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def run(spark, x, **how):
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    table = fs.stash(fs.classes(fs._valid(spark.createDataFrame(rows, SCHEMA)), 20, fs.F.col("vec_id") % 20 == 0))
    forest = fs.fit(table, leaf=32)
    table = fs.indexed(table, forest)
    budget = fs.budget_for(table, forest, 20)
    return forest, table, budget, fs.search(table, forest, budget, 20, **how)


def test_blocks_and_copies_change_nothing(spark):
    x = clustered(3000)
    forest, table, budget, one = run(spark, x)
    assert forest.depth >= 5 and budget < 3000
    order = lambda df: sorted((bytes(r.ask), r.score, list(r.ids)) for r in df.collect())
    many = fs.search(table, forest, budget, 20, block_bytes=8 * 17 * 100, block_queries=7)
    assert order(many) == order(one)
    large = fs.search(table, forest, budget, 20, block_bytes=8 * 17 * 5)  # leaves are cut
    assert order(large) == order(one)


def test_recall_against_all_rows(spark):
    x = clustered(4000) * np.linspace(0.5, 2, 4000)[:, None]  # of different lengths: the largest product isn't the least distance
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    found = result(fs.forest_search(spark.createDataFrame(rows, SCHEMA)))
    x = x.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = {r[2]: r for r in found if r[0] == q}
        assert sorted(r[1] for r in own.values()) == list(range(1, 21))
        assert all(r[3] == dot(x[q], x[r[2]]) for r in own.values())
        assert sorted(own.values(), key=lambda r: r[1]) == sorted(own.values(), key=lambda r: (-r[3], r[2]))
        hit += len(set(own) & set(np.argsort(-s)[:20].tolist()))
    assert hit / (200 * 20) >= 0.93


def test_queue_reaches_leaves_by_distance():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(600, 6))
    forest = fs.Forest(sample, (sample**2).sum(axis=1).max(), 5, trees=3)
    leaves = forest.leaves(sample)
    for t in range(3):
        forest.sizes[t] = np.bincount(leaves[:, t], minlength=32)
        assert forest.sizes[t].max() - forest.sizes[t].min() <= 8  # medians
    query = rng.normal(size=6)
    order = forest.search(query, 10**9, 0)
    assert len(order) == len(set(order)) == (forest.sizes > 0).sum()
    places = forest.project(np.append(query, 0.0)[None])[0]

    def far(t, leaf):
        total = 0.0
        for level in range(5):
            node, side = leaf >> (5 - level), leaf >> (4 - level) & 1
            gap = places[t][level] - forest.cuts[level][t, node]
            total += gap * gap if (gap > 0) != side else 0.0
        return total

    assert [far(*x) for x in order] == sorted(far(*x) for x in order)
    seen = [sum(forest.sizes[x] for x in order[:k]) for k in range(len(order) + 1)]
    assert seen[len(forest.search(query, 100, 0))] >= 100 > seen[len(forest.search(query, 100, 0)) - 1]
