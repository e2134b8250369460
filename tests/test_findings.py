"""Queries against their SQL on small tables made for what once went wrong."""

import random
from datetime import datetime, timedelta

import duckdb

from caselens.operators import graph, relational
from caselens.plans import catalog

START = datetime(2024, 1, 1)


def same(spark, folder, name, **tables):
    """Whether a query agrees with its SQL on these tables; its rows."""
    duck = duckdb.connect()
    for table, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    return got


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def test_gaps_count_fractions_of_seconds(spark, tmp_path):
    half = timedelta(hours=12)
    times = [START, START + half + timedelta(microseconds=400_000), START + 2 * half + timedelta(microseconds=400_000), None]
    rows = [(k, t, 7, f"e{k}", 1.0) for k, t in enumerate(times)]
    assert len(same(spark, tmp_path, "gap_sessions", events=(rows, EVENTS))) == 2


def test_served_components_hang_together_by_faces(spark, tmp_path):
    """Three voxels in a diagonal line are three components; three in a row are one."""
    at = lambda k, x, y, kind: (k, START + timedelta(hours=y), x, kind, 480.0 + k)
    rows = [at(0, 1, 1, "diagonal"), at(1, 2, 2, "diagonal"), at(2, 3, 3, "diagonal"), at(3, 1, 1, "row"), at(4, 2, 1, "row"), at(5, 3, 1, "row")]
    same(spark, tmp_path, "served_requests", events=(rows, EVENTS))


def test_pairs_by_any_key_are_cut_into_blocks_and_not_gathered(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.randrange(60), rng.choice("aaaab") if rng.random() < 0.9 else None, rng.choice("xyz")) for _ in range(n)]
    left, right = rows(150), rows(90)
    a, b = (spark.createDataFrame(r, "id int, p string, q string") for r in (left, right))
    want = {(x[0], y[0], k) for x in left for y in right for i, k in ((1, "p"), (2, "q")) if x[i] is not None and x[i] == y[i]}
    for block in (7, 2_000):
        got = relational.any_key_matches(a, b, ["p", "q"], "id", "id", block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    root = relational.any_key_matches(a, b, ["p", "q"], "id", "id")._jdf.queryExecution().optimizedPlan()
    assert root.nodeName() == "Union"  # no distinct over the pairs


def test_split_rows_are_brought_together_before_they_are_counted(spark):
    cases = [(k, f"c{k % 3}") for k in range(12)] + [(3, "c0"), (None, "c1")]
    rows = [(f, "val" if k % 3 == f else "train", k) for f in range(3) for k in range(12)]
    rows += [(0, "train", 0), (1, "val", 1), (2, "train", 99), (4, "train", 5), (0, "train", 3), (None, "val", 2)]
    rows.remove((2, "train", 4))
    found = relational.split_violations(
        spark.createDataFrame(rows, "fold int, subset string, id int"), spark.createDataFrame(cases, "id int, center string"), "id", "center",
    )
    assert "RepartitionByExpression [id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = {
        ("duplicate", 1, "1"), ("overlap", 0, "0"), ("overlap", 0, "3"), ("unknown", 2, "99"), ("empty", 4, "val"), ("empty", None, "val"),
        ("center leak", 0, "c0"), ("incomplete", 2, "4"), ("coverage", None, "1"), ("coverage", None, "2"), ("coverage", None, None),
        *(("incomplete", 4, str(k)) for k in range(12) if k != 5), *(("incomplete", f, None) for f in (0, 1, 2, 4)),
    }
    assert {tuple(r) for r in found.collect()} == want


def test_cycles_end_when_no_chain_gets_shorter(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "stash", lambda df: kept.append(df) or df.localCheckpoint())
    nodes = [(k, None if k % 10 == 1 else k - 1) for k in range(1, 200)] + [(300, 301), (301, 300), (302, 300), (303, 303), (304, 999)]
    found = sorted(r.id for r in graph.cyclic(spark.createDataFrame(nodes, "id int, parent int")).collect())
    assert found == [300, 301, 302, 303] and len(kept) <= 7
    assert all("BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() for df in kept)
    assert graph.cyclic(spark.createDataFrame([(1, None), (2, 1)], "id int, parent int")).count() == 0
