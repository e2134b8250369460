import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from caselens.llm.queries import ORACLES, QUERIES
from caselens.llm.vector_codes import nearest, vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 8
    part = lambda v, p: v[p * d : (p + 1) * d]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    best = lambda v, p: min((gap(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        groups = [{} for _ in range(8)]
        for _, v, _ in kept:
            for p in range(8):
                groups[p].setdefault(best(v, p)[1], []).append(part(v, p))
        books = [[[sum(c) // len(groups[p][k]) for c in zip(*groups[p][k])] if k in groups[p] else e for k, e in enumerate(books[p])] for p in range(8)]
    out = []
    for i, v, label in kept:
        found = [best(v, p) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(g for g, _ in found), label))
    total = {}
    for *_, e, label in out:
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=repr)


def awkward(n, dims=16, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 3) for _ in range(dims)], rng.choice([0, 1, None])) for i in range(n)]
    same = [0.25] * dims
    rows += [(n + i, same, 7) for i in range(n // 2)] + [(3, rows[5 % n][1], 1), (3, rows[6 % n][1], None), (None, rows[7 % n][1], 2), (None, None, None)]
    rows += [(1000, [None] + same[1:], 1), (1001, [math.nan] + same[1:], 1), (1002, [math.inf] + same[1:], 1), (1003, [-math.inf] + same[1:], 1), (1004, [], 1)]
    rng.shuffle(rows)
    return [r for r in rows if r[1] != []], rows


@pytest.mark.parametrize("n", [4, 90])
def test_equals_brute_force(spark, n):
    plain, rows = awkward(n)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "'x' AS code", "2 AS key")
    assert sorted(map(tuple, vector_codes(df).collect()), key=repr) == brute(plain)


def test_bounds_leave_the_nearest_entry(spark):
    rng = np.random.default_rng(5)
    saved = 0
    for trial in range(30):
        spread = int(rng.choice([3, 50, 4000]))
        entries, points = rng.integers(-spread, spread, (16, 8)), rng.integers(-spread, spread, (200, 8))
        if trial % 3 == 0:
            entries[5] = entries[3]
            points[:16] = entries
        exact = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        best, distance, computed = nearest(points, entries)
        assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        saved += 16 * 200 - computed
    assert saved > 30 * 16 * 200 // 2


def test_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = c.sql(ORACLES["op12_vector_codes"])
    got = QUERIES["op12_vector_codes"](spark, SF)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_lengths_and_sizes(spark):
    make = lambda rows: vector_codes(spark.createDataFrame(rows, SCHEMA))
    assert make([]).count() == 0 and make([(1, None, 1)]).count() == 0
    got = make([(1, [0.5] * 12, 1), (2, [1.0] * 12, 1), (3, [1.0] * 11, 1)]).collect()
    assert [(r.vec_id, r.code, r.error) for r in sorted(got)] == [(1, "00" * 8, 0), (2, "01" * 6 + "00" * 2, 0)]
    with pytest.raises(Exception, match="too large"):
        make([(1, [70000.0] * 8, 1)]).collect()
