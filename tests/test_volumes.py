"""Closed-form phantoms on sparse volumes."""

import math

import pytest
from pyspark.sql import functions as F

from caselens.operators import metrics, volumes as V


def cube(case, x, y, z, a, b=None, c=None):
    return [(case, i, j, k) for i in range(x, x + a) for j in range(y, y + (b or a)) for k in range(z, z + (c or a))]


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, "case string, x int, y int, z int")


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame(
        [("a", 20, 20, 20, 1.0, 1.0, 1.0), ("b", 30, 30, 30, 0.5, 0.5, 3.0)],
        "case string, nx int, ny int, nz int, vx double, vy double, vz double",
    )


def test_components_by_connectivity(table):
    corner = table([("a", 4, 4, 4), ("a", 5, 5, 5), ("b", 0, 0, 0), ("b", 1, 1, 0), ("b", 9, 9, 9)])
    for connectivity, want in ((26, {"a": 1, "b": 2}), (18, {"a": 2, "b": 2}), (6, {"a": 2, "b": 3})):
        rows = V.label(corner, connectivity).groupBy("case").agg(F.count_distinct("comp").alias("n")).collect()
        assert {r.case: r.n for r in rows} == want


def test_components_of_a_winding_shape(table):
    snake = [("a", x, y, 0) for y in range(0, 12, 2) for x in range(8)] + [("a", 7 if y % 4 == 1 else 0, y, 0) for y in range(1, 11, 2)]
    marked = V.label(table(snake + [("a", 3, 1, 5)]), 6)
    assert sorted(r.n_voxels for r in V.component_sizes(marked).collect()) == [1, len(snake)]
    assert marked.count() == len(snake) + 1
    assert V.drop_small(marked, 2).count() == len(snake) and V.drop_small(marked, 0).count() == len(snake) + 1


def test_merge_and_split(table):
    two, one = cube("a", 2, 2, 2, 3) + cube("a", 6, 2, 2, 3), cube("a", 2, 2, 2, 7, 3, 3)
    cases = table([("a", 0, 0, 0)])
    for gt, pred in ((two, one), (one, two)):
        t, p = V.label(table(gt)), V.label(table(pred))
        counts = metrics.detection(V.lenient(t, p, cases)).first()
        assert counts.lesion_f1 == 1.0 and counts.abs_count_diff == 1
        assert math.isclose(V.recognition(cases, t, p).first().rq, 2 / 3)


def test_low_overlap_does_not_match(table):
    gt, pred = cube("a", 0, 0, 0, 10, 10, 1), cube("a", 7, 0, 0, 10, 10, 1)
    cases = table([("a", 0, 0, 0)])
    t, p = V.label(table(gt)), V.label(table(pred))
    pair = V.overlaps(t, p).first()
    assert pair.shared == 30 and math.isclose(pair.iou, 30 / 170)
    assert V.recognition(cases, t, p).first().rq == 0
    t2, p2 = V.label(table(gt + cube("a", 0, 0, 20, 5))), V.label(table(pred + cube("a", 0, 0, 20, 5)))
    assert V.recognition(cases, t2, p2).first().rq == 0.5
    empty = V.label(table([("zz", 0, 0, 0)])).filter("case = 'a'")
    assert V.recognition(cases, empty, empty).first().rq == 1.0


def test_surface_and_distances(table, sizes):
    a = cube("a", 2, 2, 2, 4)
    assert V.surface(table(a)).count() == 64 - 8
    same = V.boundary_metrics(table(a), table(a), sizes).first()
    assert (same.hd95, same.assd, same.masd, same.surface_dice) == (0, 0, 0, 1)
    far = V.nearest_distance(
        table([("a", 0, 0, 0), ("b", 0, 0, 0)]), table([("a", 3, 4, 0), ("a", 30, 0, 0), ("b", 0, 0, 2), ("b", 13, 0, 0)]), sizes,
    )
    assert {r.case: r.distance for r in far.collect()} == {"a": 5.0, "b": 6.0}
    assert V.nearest_distance(table([("a", 0, 0, 0)]), table([("b", 0, 0, 2)]), sizes).first().distance is None
    shifted = V.boundary_metrics(table(cube("b", 0, 0, 0, 1)), table(cube("b", 0, 0, 9, 1)), sizes).first()
    assert shifted.hd95 == 27.0 and shifted.surface_dice == 0.0


def test_distances_equal_brute_force(table, sizes):
    import random

    rng = random.Random(0)
    p, t = ([("a", *(rng.randrange(60) for _ in range(3))) for _ in range(40)] for _ in range(2))
    want = {x[1:]: min(math.dist(x[1:], y[1:]) for y in t) for x in p}
    got = {(r.x, r.y, r.z): r.distance for r in V.nearest_distance(table(p), table(t), sizes, start=1.0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_classes(table):
    marked = V.label(table(cube("a", 0, 0, 0, 5) + cube("a", 10, 0, 0, 2)))
    classed = V.size_classes(marked, (10, 1000))
    assert {(r["class"], r["count"]) for r in classed.groupBy("class").count().collect()} == {(1, 8), (2, 125)}
    split = V.boundary_classes(classed)
    assert {(r["class"], r["count"]) for r in split.groupBy("class").count().collect()} == {(1, 8), (3, 125 - 27), (4, 27)}


def test_holes_rings_and_largest(table):
    shell = [v for v in cube("a", 0, 0, 0, 5) if v[1:] != (2, 2, 2)]
    assert V.fill_holes(table(shell)).count() == 125
    assert V.largest_component(table(shell + [("a", 9, 9, 9)])).count() == 124
    one, tissue = table([("a", 5, 5, 5)]), table(cube("a", 0, 0, 0, 6))
    assert V.ring(one, tissue, 1).count() == 7 and V.dilate(one, 1, 6).count() == 7


def test_orientations_round_trip(table, sizes):
    from itertools import permutations, product

    rows = table([("a", 1, 2, 3), ("a", 0, 19, 5)])
    grid = sizes.withColumn("ny", F.lit(30)).withColumn("nz", F.lit(40))
    for axes in permutations(range(3)):
        for flips in list(product((False, True), repeat=3))[::3]:
            turned = V.reorient(rows, grid, axes, flips)
            assert V.reorient_back(turned, grid, axes, flips).exceptAll(rows).count() == 0
    ref = table(cube("a", 0, 0, 0, 2, 3, 4))
    best = V.best_permutation(table([(c, z, x, y) for c, x, y, z in cube("a", 0, 0, 0, 2, 3, 4)]), ref).first()
    assert best.mismatch == 0 and best.ok and best.axes == "120"


def test_resampling(spark, table):
    grid = spark.createDataFrame(
        [("a", 4, 4, 4, [2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0])],
        "case string, nx int, ny int, nz int, m array<double>",
    )
    assert sorted((r.x, r.y, r.z) for r in V.resample_nearest(table(cube("a", 2, 2, 2, 2)), grid).collect()) == [(1, 1, 1)]


def test_overlay_and_labels(spark, table):
    rows = V.overlay(table(cube("a", 0, 0, 0, 2)), table(cube("a", 1, 0, 0, 2))).groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in rows} == {"TP": 4, "FP": 4, "FN": 4}
    labels = spark.createDataFrame([(2, False), (60, False), (99, False), (3, True)], "label int, lesion boolean")
    assert [r["class"] for r in V.remap(labels).collect()] == [1, 32, 0, 33]
    assert [r["class"] for r in V.remap(labels, "grouped").collect()] == [3, 4, 0, 5]


def test_soft_maps(spark):
    soft = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("a", 0.01)], "case string, p double")
    row = V.soft_features(soft, "case", "p", (0.35, 0.6), F.lit(0.5)).first()
    assert math.isclose(row.mass, 1.41) and row.fg_voxels == 2 and row.ambiguous == 0.5 and row["ml_at_0.35"] == 1.0 and row["ml_at_0.6"] == 0.5
    flat = spark.range(8000).select(metrics.flat_pr_auc(F.lit(64), F.lit(8000)).alias("v")).first().v
    assert math.isclose(flat, 0.504)
    scaled = V.clip_normalise(soft, ["case"], "p", 0.0, 1.0).agg(F.min("p"), F.max("p")).first()
    assert tuple(scaled) == (0.0, 1.0)
