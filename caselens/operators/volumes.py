"""Operators on sparse volumes: tables of foreground voxels (case, x, y, z), everything as joins and aggregates.

A grid table has one row a case: nx, ny, nz and voxel sizes vx, vy, vz in mm.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import affine
from ..functions.scalars import range_bin, ratio, same_grid, voxel_ml
from ..storage import stash
from .distances import squared_distances
from .graph import components
from .metrics import detection, overlap, volume_difference, with_tn
from .relational import manifest_status, require_empty
from .reports import joined_groups, quantiles

XYZ = ["x", "y", "z"]

# Tissue labels in order of their index, and their grouping into five classes.
TISSUE_LABELS = (
    0, 2, 3, 4, 5, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 24, 26, 28, 41, 42, 43, 44, 46, 47, 49, 50, 51, 52, 53, 54, 58, 60,
)
TISSUE_GROUPS = {
    1: (4, 5, 14, 15, 24, 43, 44), 2: (3, 10, 11, 12, 13, 17, 18, 26, 42, 49, 50, 51, 52, 53, 54, 58), 3: (2, 41),
    4: (7, 8, 16, 28, 46, 47, 60),
}


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Neighbours: 6 by faces, 18 by edges too, 26 by corners too."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= most]


def _moved(voxels: DataFrame, steps: list[tuple[int, int, int]], keep: list[str]) -> DataFrame:
    """Each voxel once for each step, at the place the step leads to."""
    table = F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip(XYZ, s))) for s in steps))
    far = voxels.select("case", *XYZ, *keep, F.explode(table).alias("s"))
    return far.select("case", *keep, *((F.col(a) + F.col(f"s.d{a}")).alias(a) for a in XYZ))


def label(voxels: DataFrame, connectivity: int = 26) -> DataFrame:
    """voxels with ``comp``: the connected component, named by its least run (by case, z, y and x).

    Runs along x are found with a window; only runs are joined to runs of
    neighbouring lines, and their graph's components are found by rounds of joins.
    Coordinates from 0 to 2^14 - 1, and up to 2^21 cases at once; anything else is an error.
    """
    named = _named(_runs(voxels))
    roots = _linked(named, connectivity)
    labelled = named.join(roots, "run", "left").withColumn("comp", F.coalesce("root", "run"))
    return labelled.select("case", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "comp")


def _runs(voxels: DataFrame) -> DataFrame:
    """(case, y, z, x0, x1): maximal runs of voxels along x."""
    line = Window.partitionBy("case", "y", "z").orderBy("x")
    begin = F.when(F.col("x") - F.lag("x").over(line) == 1, None).otherwise(F.col("x"))
    return stash(
        voxels.select("case", *XYZ).distinct().withColumn(
            "x0", F.last(begin, ignorenulls=True).over(line),
        ).groupBy("case", "y", "z", "x0").agg(F.max("x").alias("x1"))
    )


def _named(runs: DataFrame) -> DataFrame:
    """runs with ``run``, a number made of the case and the place of the first voxel."""
    numbers = runs.select("case").distinct().withColumn("no", F.row_number().over(Window.orderBy("case")) - 1)  # over cases
    packed = (
        F.col("no").cast("bigint") * (1 << 42)
    ) + F.col("z").cast("bigint") * (1 << 28) + F.col("y").cast("bigint") * (1 << 14) + F.col("x0")
    fits = (F.least("x0", "y", "z") >= 0) & (F.greatest("x1", "y", "z") < 1 << 14) & (F.col("no") < 1 << 21)
    packed = F.when(fits, packed).otherwise(
        F.raise_error(F.concat(F.lit("label: too large a place or too many cases, at case "), F.col("case").cast("string"))).cast("bigint")
    )
    return stash(runs.join(numbers, "case").withColumn("run", packed))


def _linked(named: DataFrame, connectivity: int) -> DataFrame:
    """(run, root) of runs that touch others."""
    steps = sorted({(o[1], o[2]) for o in offsets(connectivity) if (o[1], o[2]) > (0, 0)})
    reach = {s: 1 if any((dx, *s) in offsets(connectivity) for dx in (-1, 1)) else 0 for s in steps}
    table = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(r).alias("r")) for (dy, dz), r in reach.items()))
    far = named.select("case", F.explode(table).alias("s"), "y", "z", "x0", "x1", "run").select(
        "case", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("z") + F.col("s.dz")).alias("z"), F.col("x0").alias("a0"),
        F.col("x1").alias("a1"), F.col("s.r").alias("r"), F.col("run").alias("a"),
    )
    touch = far.join(
        named.select("case", "y", "z", "x0", "x1", F.col("run").alias("b")), ["case", "y", "z"],
    ).filter("a0 <= x1 + r AND x0 <= a1 + r")
    return components(touch.select("a", "b")).toDF("run", "root")


def label_both(truth: DataFrame, predicted: DataFrame, connectivity: int = 26) -> tuple[DataFrame, DataFrame]:
    """label() of two masks in one run."""
    of = lambda df, side: df.select(F.struct(F.lit(side).alias("side"), "case").alias("case"), *XYZ)
    both = stash(label(of(truth, 0).unionByName(of(predicted, 1)), connectivity))
    one = lambda side: both.filter(F.col("case.side") == side).select(F.col("case.case").alias("case"), *XYZ, "comp")
    return one(0), one(1)


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("case", "comp").agg(F.count("*").alias("n_voxels"))


def drop_small(labelled: DataFrame, least: Column | int) -> DataFrame:
    """Voxels of components of at least ``least`` voxels; everything for 0 and below."""
    least = F.lit(least) if isinstance(least, int) else least
    return labelled.join(component_sizes(labelled).filter(F.col("n_voxels") >= least).select("case", "comp"), ["case", "comp"], "left_semi")


def size_classes(labelled: DataFrame, cuts: tuple[int, ...] = (100, 1000)) -> DataFrame:
    """labelled with ``class``: 1 for components below the first cut, 2 below the second, and so on."""
    k = F.lit(len(cuts) + 1)
    for i, cut in reversed(list(enumerate(cuts, 1))):
        k = F.when(F.col("n_voxels") < cut, i).otherwise(k)
    return labelled.join(component_sizes(labelled), ["case", "comp"]).withColumn("class", k).drop("n_voxels")


def surface(voxels: DataFrame, connectivity: int = 6) -> DataFrame:
    """Voxels with a neighbour outside the mask; the outside of the grid counts as outside."""
    steps = offsets(connectivity)
    hits = _moved(voxels, steps, []).groupBy("case", *XYZ).agg(F.count("*").alias("__k"))
    return voxels.select("case", *XYZ).join(hits, ["case", *XYZ], "left").filter(F.coalesce("__k", F.lit(0)) < len(steps)).drop("__k")


def erode(voxels: DataFrame, rounds: int = 1, connectivity: int = 26) -> DataFrame:
    out = voxels.select("case", *XYZ)
    for _ in range(rounds):
        out = stash(out.join(surface(out, connectivity), ["case", *XYZ], "left_anti"))
    return out


def dilate(voxels: DataFrame, rounds: int = 1, connectivity: int = 26) -> DataFrame:
    out = voxels.select("case", *XYZ)
    for _ in range(rounds):
        out = stash(out.unionByName(_moved(out, offsets(connectivity), [])).distinct())
    return out


def boundary_classes(classed: DataFrame, rounds: int = 1) -> DataFrame:
    """Boundary voxels of class s get 2s - 1, interior ones 2s; a component that erodes to nothing is all boundary."""
    inner = erode(classed, rounds).withColumn("__in", F.lit(1))
    return classed.join(inner, ["case", *XYZ], "left").withColumn(
        "class", 2 * F.col("class") - F.when(F.col("__in") == 1, 0).otherwise(1),
    ).drop("__in")


def remap(labels: DataFrame, scheme: str = "all") -> DataFrame:
    """Tissue labels to indexes (unknown ones to 0); ``all`` or ``grouped``. ``lesion`` voxels take the index after the last."""
    if scheme == "all":
        table = {v: k for k, v in enumerate(TISSUE_LABELS)}
        lesion = len(TISSUE_LABELS)
    else:
        table = {v: k for k, vs in TISSUE_GROUPS.items() for v in vs}
        lesion = 1 + max(TISSUE_GROUPS)
    index = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[F.col("label").cast("int")]
    return labels.withColumn("class", F.when(F.col("lesion"), lesion).otherwise(F.coalesce(index, F.lit(0))))


def fill_holes(voxels: DataFrame) -> DataFrame:
    """The mask with all background that the border of its box does not reach (by faces).

    Only gaps between the runs of a line can be holes. A gap is open if it touches, on one of the four lines beside it, no
    voxel's line at all or what lies before the first or after the last run there; a hole is a component of gaps none of which
    is open. So the rows are bounded by the runs, not by the box.
    """
    runs = _runs(voxels)
    line = Window.partitionBy("case", "y", "z").orderBy("x0")
    gaps = runs.withColumns({"x0": F.col("x1") + 1, "x1": F.lead("x0").over(line) - 1}).filter("x1 IS NOT NULL")
    gaps = _named(gaps)
    ends = runs.groupBy("case", "y", "z").agg(F.min("x0").alias("first"), F.max("x1").alias("last"))
    beside = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for _, dy, dz in offsets(6) if (dy, dz) != (0, 0)))
    near = gaps.select("case", "y", "z", "x0", "x1", "run", F.explode(beside).alias("s")).select(
        "case", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("z") + F.col("s.dz")).alias("z"), "x0", "x1", "run",
    )
    reached = near.join(ends, ["case", "y", "z"], "left").filter("first IS NULL OR x0 < first OR x1 > last").select("run").distinct()
    roots = stash(gaps.select("case", "y", "z", "x0", "x1", "run").join(_linked(gaps, 6), "run", "left").withColumn("root", F.coalesce("root", "run")))
    outer = roots.join(reached, "run", "left_semi").select("root").distinct()
    holes = roots.join(outer, "root", "left_anti").select("case", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z")
    return voxels.select("case", *XYZ).unionByName(holes)


def largest_component(voxels: DataFrame, connectivity: int = 26) -> DataFrame:
    """The largest component of each case; of ties, the one with the least voxel."""
    marked = stash(label(voxels, connectivity))
    best = component_sizes(marked).withColumn(
        "__n", F.row_number().over(Window.partitionBy("case").orderBy(F.col("n_voxels").desc(), "comp")),
    ).filter("__n = 1").select("case", "comp")
    return marked.join(best, ["case", "comp"], "left_semi").select("case", *XYZ)


def ring(lesion: DataFrame, tissue: DataFrame, rounds: int = 3) -> DataFrame:
    """Tissue around a lesion, without the lesion."""
    return dilate(lesion, rounds).join(lesion, ["case", *XYZ], "left_anti").join(tissue, ["case", *XYZ], "left_semi")


# --- matching of components -------------------------------------------------------------------


def overlaps(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case, gt, pred, shared, iou) of components that share voxels."""
    pairs = truth.select("case", *XYZ, F.col("comp").alias("gt")).join(
        predicted.select("case", *XYZ, F.col("comp").alias("pred")), ["case", *XYZ],
    ).groupBy("case", "gt", "pred").agg(F.count("*").alias("shared"))
    a = component_sizes(truth).select("case", F.col("comp").alias("gt"), F.col("n_voxels").alias("n_gt"))
    b = component_sizes(predicted).select("case", F.col("comp").alias("pred"), F.col("n_voxels").alias("n_pred"))
    return pairs.join(a, ["case", "gt"]).join(b, ["case", "pred"]).withColumn(
        "iou", ratio("shared", F.col("n_gt") + F.col("n_pred") - F.col("shared")),
    )


def lenient(truth: DataFrame, predicted: DataFrame, cases: DataFrame, least: int = 1) -> DataFrame:
    """Counts for detection(): any overlap of at least ``least`` voxels counts, many to many."""
    if least < 1:
        raise ValueError("least must be 1 or more")
    hits = overlaps(truth, predicted).filter(F.col("shared") >= least).groupBy("case").agg(
        F.count_distinct("gt").alias("detected_gt"), F.count_distinct("pred").alias("tp_pred"),
    )
    count = lambda t, n: component_sizes(t).groupBy("case").agg(F.count("*").alias(n))
    return cases.select("case").distinct().join(count(truth, "gt_count"), "case", "left").join(
        count(predicted, "pred_count"), "case", "left",
    ).join(hits, "case", "left").fillna(0)


def overlap_maxima(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case, side, comp, n_voxels, shared): for each component of either side, its largest overlap with one of the other; 0 for none."""
    met = overlaps(truth, predicted)
    out = None
    for side, own, name in (("gt", truth, "gt"), ("pred", predicted, "pred")):
        best = met.groupBy("case", F.col(name).alias("comp")).agg(F.max("shared").alias("shared"))
        one = component_sizes(own).join(best, ["case", "comp"], "left").select(
            "case", F.lit(side).alias("side"), "comp", "n_voxels", F.coalesce("shared", F.lit(0)).alias("shared"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def binned_recall(truth: DataFrame, predicted: DataFrame, cases: DataFrame, bins) -> DataFrame:
    """(case, size_bin, n_gt, n_detected, recall) of true components by size; every case has every bin."""
    sizes = overlap_maxima(truth, predicted).filter("side = 'gt'")
    counts = sizes.groupBy("case", range_bin("n_voxels", bins).alias("size_bin")).agg(
        F.count("*").alias("n_gt"), F.count_if(F.col("shared") > 0).alias("n_detected"),
    )
    every = cases.select("case").distinct().select("case", F.explode(F.array(*(F.lit(b[0]) for b in bins))).alias("size_bin"))
    full = every.join(counts, ["case", "size_bin"], "left").fillna(0, ["n_gt", "n_detected"])
    return full.select("case", "size_bin", "n_gt", "n_detected", ratio("n_detected", "n_gt").alias("recall"))


def match_one_to_one(pairs: DataFrame, least: float = 0.25) -> DataFrame:
    """Greedy pairs by falling IoU (ties: gt, pred), each component once: rounds of mutually best pairs."""
    left = stash(pairs.filter(F.col("iou") >= least).select("case", "gt", "pred", "iou"))
    found = left.limit(0)
    order = [F.col("iou").desc(), F.col("gt"), F.col("pred")]
    while not left.isEmpty():
        best = stash(
            left.withColumn("a", F.row_number().over(Window.partitionBy("case", "gt").orderBy(*order))).withColumn(
                "b", F.row_number().over(Window.partitionBy("case", "pred").orderBy(*order)),
            ).filter("a = 1 AND b = 1").select("case", "gt", "pred", "iou")
        )
        found = found.unionByName(best)
        left = stash(
            left.join(best.select("case", "gt"), ["case", "gt"], "left_anti").join(
                best.select("case", "pred"), ["case", "pred"], "left_anti",
            )
        )
    return found


def recognition(cases: DataFrame, truth: DataFrame, predicted: DataFrame, least: float = 0.25) -> DataFrame:
    """(case, tp, fp, fn, rq): TP / (TP + FP / 2 + FN / 2); 1 where both sides are empty."""
    tp = match_one_to_one(overlaps(truth, predicted), least).groupBy("case").agg(F.count("*").alias("tp"))
    count = lambda t, n: component_sizes(t).groupBy("case").agg(F.count("*").alias(n))
    rows = cases.select("case").distinct().join(count(truth, "n_gt"), "case", "left").join(
        count(predicted, "n_pred"), "case", "left",
    ).join(tp, "case", "left").fillna(0)
    rows = rows.select("case", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
    return rows.withColumn("rq", ratio("tp", F.col("tp") + (F.col("fp") + F.col("fn")) / 2.0, 1.0))


def collapsed_dice(dice: Column, tp: Column, n_gt: Column, n_pred: Column) -> Column:
    """0 where both sides have components but none match."""
    return F.when((tp == 0) & (n_gt > 0) & (n_pred > 0), 0.0).otherwise(dice)


# --- distances --------------------------------------------------------------------------------


def nearest_distance(points: DataFrame, targets: DataFrame, sizes: DataFrame, start: float | None = None) -> DataFrame:
    """points with ``distance`` in mm to the nearest target of their case (voxel sizes vx, vy, vz from sizes). Cases without targets get NULL.

    By passes over the lines of each axis, see distances.py; ``start``, the first side of a former search by cubes, has no effect.
    """
    near = squared_distances(points, targets, sizes, ["case"]).withColumn("distance", F.sqrt("h")).drop("h")
    lost = points.select("case", *XYZ).join(targets.select("case").distinct(), "case", "left_anti")
    return near.unionByName(lost.withColumn("distance", F.lit(None).cast("double")))


def boundary_metrics(truth: DataFrame, predicted: DataFrame, sizes: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """hd95, assd, masd and surface dice of each case that has both masks."""
    a, b = stash(surface(truth)), stash(surface(predicted))
    both = lambda first, second: first.withColumn("side", F.lit("gt")).unionByName(second.withColumn("side", F.lit("pred")))
    d = squared_distances(both(a, b), both(b, a), sizes, ["case", "side"]).withColumn("distance", F.sqrt("h"))
    d = stash(d.select("case", "side", "distance"))
    side = d.groupBy("case", "side").agg(F.avg("distance").alias("m")).groupBy("case").agg(F.avg("m").alias("masd"))
    return d.groupBy("case").agg(
        F.percentile("distance", 0.95).alias("hd95"), F.avg("distance").alias("assd"),
        F.avg((F.col("distance") <= tolerance).cast("double")).alias("surface_dice"),
    ).join(side, "case").select("case", "hd95", "assd", "masd", "surface_dice")


# --- grids and intensities --------------------------------------------------------------------


def reorient(voxels: DataFrame, grid: DataFrame, axes: tuple[int, int, int], flips: tuple[bool, bool, bool]) -> DataFrame:
    """New axis k runs along old axis axes[k], turned round where flips[k]. reorient_back() undoes it."""
    joined = voxels.join(grid.select("case", "nx", "ny", "nz"), "case")
    new = []
    for k, a in enumerate(XYZ):
        old = XYZ[axes[k]]
        new.append((F.col(f"n{old}") - 1 - F.col(old) if flips[k] else F.col(old)).alias(a))
    return joined.select("case", *new)


def reorient_back(voxels: DataFrame, grid: DataFrame, axes: tuple[int, int, int], flips: tuple[bool, bool, bool]) -> DataFrame:
    """grid: the original one."""
    joined = voxels.join(grid.select("case", "nx", "ny", "nz"), "case")
    new = []
    for a in range(3):
        k = axes.index(a)
        new.append((F.col(f"n{XYZ[a]}") - 1 - F.col(XYZ[k]) if flips[k] else F.col(XYZ[k])).alias(XYZ[a]))
    return joined.select("case", *new)


def best_permutation(masks: DataFrame, reference: DataFrame, most: float = 1e-3) -> DataFrame:
    """(case, axes, mismatch, ok): the order of axes under which masks differ least from the reference; ``ok`` if small and not tied."""
    size = reference.groupBy("case").agg(F.count("*").alias("n_ref"))
    perms = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    table = F.array(*(F.struct(F.lit("".join(map(str, p))).alias("axes"), *(F.col(XYZ[p[k]]).alias(a) for k, a in enumerate(XYZ))) for p in perms))
    turned = masks.select("case", F.explode(table).alias("t")).select("case", "t.axes", *(F.col(f"t.{a}").alias(a) for a in XYZ))
    hits = turned.join(
        reference.select("case", *XYZ).withColumn("hit", F.lit(1)), ["case", *XYZ], "left",
    ).groupBy("case", "axes").agg(F.count("*").alias("n"), F.count("hit").alias("both"))
    scored = hits.join(size, "case").withColumn(
        "mismatch", ratio(F.col("n") + F.col("n_ref") - 2 * F.col("both"), F.col("n") + F.col("n_ref")),
    )
    order = Window.partitionBy("case").orderBy("mismatch", "axes")
    ranked = scored.withColumns({"__n": F.row_number().over(order), "next": F.lead("mismatch").over(order)}).filter("__n = 1")
    return ranked.select(
        "case", "axes", "mismatch",
        ((F.col("mismatch") <= most) & (F.col("next").isNull() | (F.col("next") > F.col("mismatch")))).alias("ok"),
    )


def resolve_permutation(best: DataFrame) -> DataFrame:
    """best: of best_permutation(). (case, axes, source): a case's own order where it is ok, else the one that most ok cases have (ties: the first)."""
    votes = best.filter("ok").groupBy("axes").agg(F.count("*").alias("k"))
    most = votes.orderBy(F.col("k").desc(), "axes").limit(1).select(F.col("axes").alias("__most"))
    every = best.join(F.broadcast(most), how="left")  # one row
    source = F.when(F.col("ok"), "own").when(F.col("__most").isNotNull(), "consensus").otherwise("none")
    return every.select("case", F.when(F.col("ok"), F.col("axes")).otherwise(F.col("__most")).alias("axes"), source.alias("source"))


def _reached(rows: DataFrame, grid: DataFrame, radius: float, keep: list[str]) -> DataFrame:
    """Each voxel of the source with every target cell (tx, ty, tz) whose place (sx, sy, sz) in the source may lie within ``radius`` along each axis.

    A voxel's cells come from the map back: around its place in the target, as far as a box of the source reaches there. So
    there are as many rows as voxels, times the ratio of the grids' steps, and none for empty space.
    """
    back = stash(grid.select("case", "nx", "ny", "nz", "m", affine.inverse(F.col("m")).alias("__i")))  # else each use repeats the inverse
    placed = rows.join(back, "case")
    centre = affine.apply(F.col("__i"), [F.col(a) for a in XYZ])
    for k, a in enumerate(XYZ):
        reach = sum((F.abs(F.get("__i", F.lit(4 * k + j))) for j in range(3)), F.lit(0.0)) * radius + 1e-6
        low, high = F.greatest(F.ceil(centre[k] - reach), F.lit(0)), F.least(F.floor(centre[k] + reach), F.col(f"n{a}") - 1)
        placed = placed.withColumn(f"__{a}", F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))
    placed = placed.filter(F.col("__i").isNotNull() | F.raise_error(F.lit("a matrix without an inverse")).cast("boolean"))
    for a in XYZ:
        placed = placed.withColumn(f"t{a}", F.explode(f"__{a}"))
    at = affine.apply(F.col("m"), [F.col(f"t{a}") for a in XYZ])
    return placed.select("case", *XYZ, *keep, *(f"t{a}" for a in XYZ), *(at[k].alias(f"s{a}") for k, a in enumerate(XYZ)))


def resample_linear(soft: DataFrame, grid: DataFrame) -> DataFrame:
    """soft: case, x, y, z, p (0 where there is no row). The map on another grid (as of resample_nearest()) by trilinear interpolation; cells of 0 are left out."""
    near = _reached(soft.select("case", *XYZ, "p"), grid, 1.0, ["p"])
    weight = F.lit(1.0)
    for a in XYZ:
        rest = F.col(f"s{a}") - F.floor(f"s{a}")
        weight = weight * F.when(F.col(a) == F.floor(f"s{a}"), 1 - rest).when(F.col(a) == F.floor(f"s{a}") + 1, rest).otherwise(0.0)
    found = near.withColumn("w", weight).filter("w > 0").groupBy("case", *(f"t{a}" for a in XYZ)).agg(F.sum(F.col("w") * F.col("p")).alias("p"))
    return found.filter("p <> 0").select("case", *(F.col(f"t{a}").alias(a) for a in XYZ), "p")


def require_grid(grid: DataFrame, reference: DataFrame, strict: bool = True) -> DataFrame:
    """(case, status) of shapes: on_grid or resampled. Strict: any case that is not on its reference's grid is an error."""
    shape = lambda df, name: df.select("case", F.array("nx", "ny", "nz").alias(name))
    both = shape(grid, "a").join(shape(reference, "b"), "case", "left")
    out = both.select(
        "case", F.when(F.col("b").isNull(), "refused").when(F.col("a") == F.col("b"), "on_grid").otherwise("resampled").alias("status"),
    )
    if strict:
        require_empty(out.filter("status <> 'on_grid'"), "off the reference's grid")
    return out


def resample_nearest(voxels: DataFrame, grid: DataFrame) -> DataFrame:
    """The mask on another grid. grid: case, nx, ny, nz of the target, and m, a flat 3 x 4 matrix from its indexes to the source's."""
    near = _reached(voxels.select("case", *XYZ), grid, 0.5, [])
    same = reduce(lambda a, b: a & b, (F.rint(f"s{a}") == F.col(a) for a in XYZ))
    return near.filter(same).select("case", *(F.col(f"t{a}").alias(a) for a in XYZ)).distinct()


def resample_onto(rows: DataFrame, own: DataFrame, reference: DataFrame) -> DataFrame:
    """A mask, or a soft map if there is a column p, on its reference's grid: 0 beyond its own.

    own and reference: grids with affine, as the readers give them. Cases on their reference's grid already pass through; a
    case without a grid or a matrix of either kind is an error.
    """
    side = lambda df, to: df.select("case", F.array("nx", "ny", "nz").alias(f"{to}_n"), F.col("affine").alias(f"{to}_m"))
    both = rows.select("case").distinct().join(side(own, "own"), "case", "left").join(side(reference, "ref"), "case", "left")
    require_empty(both.filter("own_m IS NULL OR ref_m IS NULL").select("case"), "no matrix")
    here = same_grid("own_n", "ref_n", "own_m", "ref_m")
    shape = [F.get("ref_n", F.lit(k)).alias(f"n{a}") for k, a in enumerate(XYZ)]
    back = stash(both.withColumn("back", affine.inverse(F.col("own_m"))))
    grid = stash(back.select("case", *shape, affine.compose(F.col("back"), F.col("ref_m")).alias("m"), here.alias("here")))
    keep = [*XYZ, "p"] if "p" in rows.columns else XYZ
    moved = (resample_linear if "p" in keep else resample_nearest)(rows, grid.filter(~F.col("here")))
    return rows.join(grid.filter("here").select("case"), "case", "left_semi").select("case", *keep).unionByName(moved.select("case", *keep))


def intensity_statistics(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, p01, p50, p99, max, mean, deviation and the share that is not 0; p50 and p99 of what is above 0. Percentiles are exact."""
    v = F.col(value)
    plain = values.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg((v != 0).cast("double")).alias("nonzero_frac"),
    )
    every = quantiles(values, keys, value, (0.01, 0.5, 0.99), ("p01", "p50", "p99"))
    brain = quantiles(values.filter(v > 0), keys, value, (0.5, 0.99), ("brain_p50", "brain_p99"))
    both = joined_groups(joined_groups(plain, every, keys), brain, keys)
    return both.select(*keys, "min", "p01", "p50", "p99", "max", "mean", "std", "nonzero_frac", "brain_p50", "brain_p99")


def clip_normalise(values: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values from the low to the high percentile of their group, as 0 to 1."""
    edges = quantiles(values, keys, value, (low, high), ("__lo", "__hi"))
    scaled = F.coalesce(ratio(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    return joined_groups(values, edges, keys).withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("__lo", "__hi")


def overlay(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every foreground voxel as TP, FP or FN."""
    return truth.select("case", *XYZ, F.lit(1).alias("g")).join(predicted.select("case", *XYZ, F.lit(1).alias("p")), ["case", *XYZ], "full").select(
        "case", *XYZ, F.when(F.col("g").isNull(), "FP").when(F.col("p").isNull(), "FN").otherwise("TP").alias("class"),
    )


def soft_features(soft: DataFrame, case: str, p: str, thresholds: tuple[float, ...], voxel_ml: Column) -> DataFrame:
    """Mass, maximum, foreground (p > 0.05) statistics, the ambiguous share, and a volume for each threshold."""
    fg = F.when(F.col(p) > 0.05, F.col(p))
    volumes = [(F.count_if(F.col(p) >= t) * voxel_ml).alias(f"ml_at_{t:g}") for t in thresholds]
    return soft.groupBy(case).agg(
        F.sum(p).alias("mass"), F.max(p).alias("max"), F.avg(fg).alias("fg_mean"), F.stddev_pop(fg).alias("fg_std"),
        F.count(fg).alias("fg_voxels"),
        F.avg(F.when(F.col(p) > 0.05, ((F.col(p) > 0.25) & (F.col(p) < 0.75)).cast("double"))).alias("ambiguous"), *volumes,
    )


def case_record(
    truth: DataFrame, predicted: DataFrame, sizes: DataFrame, connectivity: int = 26, bins=None, least: int = 1,
) -> DataFrame:
    """One record a case: voxel overlap, volumes, boundary distances, components and, with bins, recall by size (as a map).

    least: voxels that components must share to count as detected (for the counts, not the bins). sizes: case, nx, ny, nz, vx, vy, vz of every case; cases without any voxel have a record, too.
    """
    count = lambda k: F.count_if(F.col("class") == k).alias(k.lower())
    counts = overlay(truth, predicted).groupBy("case").agg(count("TP"), count("FP"), count("FN"))
    grid = sizes.select("case", (F.col("nx") * F.col("ny") * F.col("nz")).alias("cells"), voxel_ml("vx", "vy", "vz").alias("ml"))
    base = with_tn(grid.join(counts, "case", "left").fillna(0, ["tp", "fp", "fn"]), "cells")
    gt_ml, pred_ml = (F.col("tp") + F.col("fn")) * F.col("ml"), (F.col("tp") + F.col("fp")) * F.col("ml")
    base = base.select(
        "case", "tp", "fp", "fn", "tn", *overlap(), gt_ml.alias("gt_ml"), pred_ml.alias("pred_ml"), *volume_difference(pred_ml, gt_ml),
    )
    a, b = label_both(truth, predicted, connectivity)
    lesions = detection(lenient(a, b, sizes, least))
    out = base.join(boundary_metrics(truth, predicted, sizes), "case", "left").join(lesions, "case")
    if bins:
        each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("size_bin", F.struct("n_gt", "n_detected", "recall")))))
        out = out.join(binned_recall(a, b, sizes, bins).groupBy("case").agg(each.alias("size_bins")), "case")
    return out


def manifest_records(
    manifest: DataFrame, truth: DataFrame, predicted: DataFrame, own: DataFrame, reference: DataFrame, connectivity: int = 26, bins=None,
    least: int = 1,
) -> DataFrame:
    """One row for each case of a manifest: its own columns, ``lacks`` and the case_record() of complete cases, NULLs for others.

    reference and own: grids (with voxel sizes and affine) of truths and predictions; a case that one of them does not have
    lacks its truth or its prediction. Predictions are brought onto the reference grid first. Cases of no manifest are left out.
    """
    marked = stash(manifest_status(manifest, {"truth": reference, "prediction": own}, ["case"]))
    ready = marked.filter("lacks = ''").select("case").distinct()
    of = lambda df: df.join(ready, "case", "left_semi")
    moved = stash(resample_onto(of(predicted), own, reference).select("case", *XYZ))
    return marked.join(case_record(of(truth), moved, of(reference), connectivity, bins, least), "case", "left")
