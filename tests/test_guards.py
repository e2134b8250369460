"""Guards, plans of folds and the schema of graphs on small tables."""

import pytest
from pyspark.sql import functions as F

from caselens.operators import graph, relational, reports, selection, splits

NODE = "id string, title string, event_at string, lenses array<string>, sources array<struct<label: string, path: string, commit: string, url: string>>, parent string"


def test_each_fault_of_a_graph(spark):
    good = ("a", "t", "2024-01-02T03:04:05Z", ["story"], [("l", "p", "0" * 40, None)], None)
    bad = {
        "node id": ("", "t", "2024-01-02", ["story"], [], None), "node title": ("b", "x" * 1001, "2024-01-02", ["story"], [], None),
        "node event_at": ("c", "t", "soon", ["story"], [], None), "node lenses": ("d", "t", "2024-01-02", ["story", None], [], None),
        "node sources": ("e", "t", "2024-01-02", ["story"], [("l", None, "0" * 41, None)], None),
        "no parent": ("f", "t", "2024-01-02", ["story"], [], "nobody"),
    }
    edges = spark.createDataFrame([("e1", "a", "b"), ("e1", "a", None)], "id string, source string, target string")
    nodes = spark.createDataFrame([good, *bad.values()], NODE)
    found = {tuple(r) for r in graph.schema_faults(nodes, edges).collect()}
    assert found == {(k, v[0]) for k, v in bad.items()} | {("edge target", "e1"), ("no target", "e1"), ("repeated edge", "e1")}
    assert {r.kind for r in graph.schema_faults(nodes, edges, 6, 1).collect()} >= {"too many nodes", "too many edges"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", None)], "id string, parent string")
    assert {tuple(r) for r in graph.schema_faults(loop, edges.limit(0)).collect()} == {("cycle", "a"), ("cycle", "b"), ("cycle", "c")}
    assert graph.schema_faults(nodes.limit(0), edges.limit(0)).count() == 0


def test_collections_and_reports(spark):
    cases = lambda *x: spark.createDataFrame([(i,) for i in x], "case int")
    found = relational.verify_collections(cases(1, 2, 3), {"a": cases(1, 2, 3), "b": cases(1, 1, 4), "c": cases(1, 2, 3, None)}, "case")
    assert {tuple(r) for r in found.collect()} == {
        ("b", "missing", "2"), ("b", "missing", "3"), ("b", "duplicate", "1"), ("b", "unexpected", "4"), ("c", "unexpected", None),
    }
    reports_, metas = spark.createDataFrame([(1, True), (2, True), (4, None)], "case int, ok boolean"), spark.createDataFrame([(1, True), (4, True)], "case int, ok boolean")
    status = relational.report_status(cases(1, 2, 3, 4), reports_, metas, "case", F.col("ok"), F.col("ok"))
    assert dict(map(tuple, status.collect())) == {1: "ok", 2: "undeclared", 3: "no report", 4: "bad report"}
    with pytest.raises(ValueError, match="2"):
        relational.declared_reports(status, "case")
    assert [r[0] for r in relational.declared_reports(status, "case", True).collect()] == [1]


def test_plans_in_full_and_by_sides(spark):
    cases = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None) for i in range(40)], "case int, center string")
    full = splits.leave_group_out(cases, "case", "center", 2)
    sizes = {(r.held, r.subset): r["count"] for r in full.groupBy("held", "subset").count().collect()}
    assert {(r.held, r.subset): r.n for r in splits.plan_sizes(cases, "center", 2).collect()} == sizes and len(sizes) == 6
    for held in "abc":
        for subset in ("train", "val"):
            want = {r.case for r in full.filter((F.col("held") == held) & (F.col("subset") == subset)).collect()}
            assert {r.case for r in splits.side(cases, "center", held, subset).collect()} == want
    assert splits.leave_group_out(cases.limit(0), "case", "center").count() == 0
    held = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (9, 2)], "case int, fold int")
    outside = relational.complement(cases.filter("case < 4").select("case"), held, "case", "fold")
    assert {tuple(r) for r in outside.collect()} == {(f, c) for c in range(4) for f in range(3)} - {(0, 1), (1, 2), (0, 2)}


def test_edges_of_a_grid(spark):
    for values, want in (([1, 3, 2], False), ([3, 1, 2], True), ([2, 3, 3], False), ([1, 3], True), ([3], False)):
        rows = spark.createDataFrame([(i / 10, float(v)) for i, v in enumerate(values)], "threshold double, v double")
        assert selection.best_on_edge(rows, "threshold", "v").first()[0] is want


def test_moments_of_groups_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 2.0), (None, 1, 4.0), ("a", None, None), ("a", 2, 5.0)], "k string, j int, v double")
    got = {(r.k, r.j): (r.n_valid, r["mean"], r.mid) for r in reports.describe(rows, ["k", "j"], "v", (0.5,), ("mid",)).collect()}
    assert got == {(None, 1): (2, 3.0, 3.0), ("a", None): (0, None, None), ("a", 2): (1, 5.0, 5.0)}
