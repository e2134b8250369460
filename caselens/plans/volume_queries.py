"""Queries over volumes: voxels of two masks are made of the events' users, hours and days."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import blobs, metrics, ranking, reports
from ..operators import volumes as V
from ..sources import readers, sinks, volume_source
from ..storage import shared_dir
from ..streaming import jobs
from .catalog import _METRICS, ORACLES, query

_PLACE = "event_type AS c, user_id % 20 AS x, hour(ts) AS y, dayofyear(ts) % 10 AS z"
_MASKS = f"""gt AS (SELECT DISTINCT {_PLACE} FROM events WHERE value < 60), pr AS (SELECT DISTINCT {_PLACE} FROM events WHERE value >= 30 AND value < 90), tissue AS (SELECT DISTINCT {_PLACE} FROM events)"""
_STEPS6 = "n6 AS (SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx,dy,dz))"
_STEPS26 = "n26 AS (SELECT a.d AS dx, b.d AS dy, e.d AS dz FROM (VALUES (-1),(0),(1)) a(d), (VALUES (-1),(0),(1)) b(d), (VALUES (-1),(0),(1)) e(d) WHERE NOT (a.d = 0 AND b.d = 0 AND e.d = 0))"


def _components(mask: str) -> str:
    """CTEs that give ``{mask}_c`` (c, x, y, z, comp) by faces: the least voxel that is reachable."""
    return f"""{mask}_e AS (SELECT a.c, a.x, a.y, a.z, (a.z * 100 + a.y) * 100 + a.x AS id, (b.z * 100 + b.y) * 100 + b.x AS other FROM {mask} a JOIN {mask} b ON a.c = b.c AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1),
{mask}_r(c, id, seen) AS (SELECT c, id, other FROM {mask}_e UNION SELECT r.c, r.id, e.other FROM {mask}_r r JOIN {mask}_e e ON r.c = e.c AND r.seen = e.id),
{mask}_c AS (SELECT m.c, m.x, m.y, m.z, min(seen) AS comp FROM {mask} m JOIN {mask}_r r ON m.c = r.c AND r.id = (m.z * 100 + m.y) * 100 + m.x GROUP BY ALL)"""


def _voxels(table, condition="true"):
    """Distinct places of the events; condition: SQL or a column."""
    rows = table("events").filter(condition)
    return rows.select(
        F.col("event_type").alias("case"), (F.col("user_id") % 20).cast("int").alias("x"), F.hour("ts").alias("y"),
        (F.dayofyear("ts") % 10).cast("int").alias("z"),
    ).distinct()


def _gt(table):
    return _voxels(table, "value < 60")


def _pr(table):
    return _voxels(table, "value >= 30 AND value < 90")


def _sizes(table):
    return table("events").select(F.col("event_type").alias("case")).distinct().select(
        "case", F.lit(20).alias("nx"), F.lit(24).alias("ny"), F.lit(10).alias("nz"), F.lit(1.0).alias("vx"), F.lit(1.5).alias("vy"),
        F.lit(2.0).alias("vz"),
    )


@query(f"""WITH {_MASKS}, o AS (SELECT coalesce(gt.c, pr.c) AS c, gt.c IS NOT NULL AS t, pr.c IS NOT NULL AS p FROM gt FULL JOIN pr ON gt.c = pr.c AND gt.x = pr.x AND gt.y = pr.y AND gt.z = pr.z),
k AS (SELECT c, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM o GROUP BY 1), f AS (SELECT *, 4800 - tp - fp - fn AS tn FROM k), m AS (SELECT *, {_METRICS} FROM f)
SELECT c AS case_id, tp, fp, fn, tn, round(dice, 6) AS dice, round(iou, 6) AS iou, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(npv, 6) AS npv FROM m""")
def voxel_overlap(table):
    count = lambda k: F.count_if(F.col("class") == k).alias(k.lower())
    counts = V.overlay(_gt(table), _pr(table)).groupBy(F.col("case").alias("case_id")).agg(count("TP"), count("FP"), count("FN"))
    full = metrics.with_tn(counts.withColumn("cells", F.lit(4800)), "cells")
    return full.select("case_id", "tp", "fp", "fn", "tn", *metrics.overlap())


@query(f"""WITH {_MASKS}, {_STEPS6}, k AS (SELECT gt.c, gt.x, gt.y, gt.z, count(o.c) AS n FROM gt CROSS JOIN n6 LEFT JOIN gt o ON o.c = gt.c AND o.x = gt.x + dx AND o.y = gt.y + dy AND o.z = gt.z + dz GROUP BY ALL)
SELECT c AS case_id, x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM k WHERE n < 6""")
def voxel_surface(table):
    return V.surface(_gt(table)).select(F.col("case").alias("case_id"), "x", "y", "z")


@query(f"""WITH {_MASKS}, {_STEPS26}, d AS (SELECT DISTINCT c, x + dx AS x, y + dy AS y, z + dz AS z FROM gt, n26)
SELECT tissue.c AS case_id, count(*) AS n_ring FROM tissue JOIN d ON d.c = tissue.c AND d.x = tissue.x AND d.y = tissue.y AND d.z = tissue.z WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.c = tissue.c AND gt.x = tissue.x AND gt.y = tissue.y AND gt.z = tissue.z) GROUP BY 1""")
def voxel_ring(table):
    return V.ring(_gt(table), _voxels(table), 1).groupBy(F.col("case").alias("case_id")).agg(F.count("*").alias("n_ring"))


@query(f"""WITH RECURSIVE {_MASKS}, {_components("gt")}, s AS (SELECT c, comp, count(*) AS n FROM gt_c GROUP BY ALL)
SELECT c AS case_id, count(*) AS n_components, max(n) AS largest, sum(n) FILTER (WHERE n >= 3)::BIGINT AS kept_voxels FROM s GROUP BY 1""")
def voxel_components(table):
    sizes = V.component_sizes(V.label(_gt(table), 6))
    return sizes.groupBy(F.col("case").alias("case_id")).agg(
        F.count("*").alias("n_components"), F.max("n_voxels").alias("largest"),
        F.sum(F.when(F.col("n_voxels") >= 3, F.col("n_voxels"))).alias("kept_voxels"),
    )


@query(f"""WITH RECURSIVE {_MASKS}, {_components("gt")}, {_components("pr")}, h AS (SELECT g.c, g.comp AS a, p.comp AS b FROM gt_c g JOIN pr_c p ON g.c = p.c AND g.x = p.x AND g.y = p.y AND g.z = p.z GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT c, count(DISTINCT a) AS detected_gt, count(DISTINCT b) AS tp_pred FROM h GROUP BY 1), g AS (SELECT c, count(DISTINCT comp) AS gt_count FROM gt_c GROUP BY 1), p AS (SELECT c, count(DISTINCT comp) AS pred_count FROM pr_c GROUP BY 1),
j AS (SELECT g.c, gt_count, coalesce(pred_count, 0) AS pred_count, coalesce(detected_gt, 0) AS detected_gt, coalesce(tp_pred, 0) AS tp_pred FROM g LEFT JOIN p USING (c) LEFT JOIN k USING (c)),
r AS (SELECT *, CAST(tp_pred AS DOUBLE) / nullif(pred_count, 0) AS pc, CAST(detected_gt AS DOUBLE) / nullif(gt_count, 0) AS rc FROM j)
SELECT c AS case_id, gt_count, pred_count, detected_gt, tp_pred, round(pc, 6) AS lesion_precision, round(rc, 6) AS lesion_recall, round(CASE WHEN coalesce(pc, 0) + coalesce(rc, 0) = 0 THEN 0 ELSE 2 * pc * rc / (pc + rc) END, 6) AS lesion_f1 FROM r""")
def voxel_lenient_detection(table):
    truth, predicted = V.label_both(_gt(table), _pr(table), 6)
    counts = metrics.detection(V.lenient(truth, predicted, _gt(table).select("case"), 2))
    return counts.select(
        F.col("case").alias("case_id"), "gt_count", "pred_count", "detected_gt", "tp_pred", "lesion_precision", "lesion_recall", "lesion_f1",
    )


@query(
    f"""WITH RECURSIVE {_MASKS}, {_components("gt")}, s AS (SELECT c, comp, count(*) AS n FROM gt_c GROUP BY ALL) SELECT c AS case_id, CAST(CASE WHEN n < 3 THEN 1 WHEN n < 10 THEN 2 ELSE 3 END AS BIGINT) AS size_class, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2"""
)
def voxel_size_classes(table):
    return V.size_classes(V.label(_gt(table), 6), (3, 10)).groupBy(
        F.col("case").alias("case_id"), F.col("class").alias("size_class"),
    ).agg(F.count("*").alias("n"))


@query(f"""WITH {_MASKS}, {_STEPS6}, gs AS (SELECT gt.c, gt.x, gt.y, gt.z FROM gt CROSS JOIN n6 LEFT JOIN gt o ON o.c = gt.c AND o.x = gt.x + dx AND o.y = gt.y + dy AND o.z = gt.z + dz GROUP BY ALL HAVING count(o.c) < 6),
ps AS (SELECT pr.c, pr.x, pr.y, pr.z FROM pr CROSS JOIN n6 LEFT JOIN pr o ON o.c = pr.c AND o.x = pr.x + dx AND o.y = pr.y + dy AND o.z = pr.z + dz GROUP BY ALL HAVING count(o.c) < 6),
q AS (SELECT a.c, 'a' AS side, a.x, a.y, a.z, sqrt(min(((a.x - b.x) * 1.0) ** 2 + ((a.y - b.y) * 1.5) ** 2 + ((a.z - b.z) * 2.0) ** 2)) AS d FROM gs a JOIN ps b ON a.c = b.c GROUP BY ALL UNION ALL SELECT a.c, 'b', a.x, a.y, a.z, sqrt(min(((a.x - b.x) * 1.0) ** 2 + ((a.y - b.y) * 1.5) ** 2 + ((a.z - b.z) * 2.0) ** 2)) FROM ps a JOIN gs b ON a.c = b.c GROUP BY ALL),
m AS (SELECT c, avg(m) AS masd FROM (SELECT c, side, avg(d) AS m FROM q GROUP BY ALL) GROUP BY 1)
SELECT c AS case_id, round(quantile_cont(d, 0.95), 6) AS hd95, round(avg(d), 6) AS assd, round(max(masd), 6) AS masd, round(avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0.0 END), 6) AS surface_dice FROM q JOIN m USING (c) GROUP BY 1""")
def voxel_boundary_metrics(table):
    return V.boundary_metrics(_gt(table), _pr(table), _sizes(table)).withColumnRenamed("case", "case_id")


@query(f"""WITH {_MASKS} SELECT c AS case_id, 9 - z AS x, x AS y, 23 - y AS z FROM gt""")
def voxel_reorient(table):
    return V.reorient(_gt(table), _sizes(table), (2, 0, 1), (True, False, True)).withColumnRenamed("case", "case_id")


@query(
    f"""WITH {_MASKS}, s AS (SELECT c, z, count(*) AS n FROM gt GROUP BY ALL), m AS (SELECT c, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz FROM gt GROUP BY 1) SELECT c AS case_id, CAST(z AS BIGINT) AS z, n, mx, my, mz FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, z) AS k FROM s) JOIN m USING (c) WHERE k = 1"""
)
def voxel_best_slice(table):
    centers = ranking.centers(_gt(table), "case").toDF("case", "mx", "my", "mz")
    return ranking.best_slice(_gt(table), "case", "z").join(centers, "case").select(
        F.col("case").alias("case_id"), "z", "n", "mx", "my", "mz",
    )


@query(
    f"""WITH {_MASKS}, {_STEPS26}, k AS (SELECT t.c, t.x, t.y, t.z, count(o.c) AS n FROM tissue t CROSS JOIN n26 LEFT JOIN tissue o ON o.c = t.c AND o.x = t.x + dx AND o.y = t.y + dy AND o.z = t.z + dz GROUP BY ALL) SELECT c AS case_id, CAST(CASE WHEN n = 26 THEN 2 ELSE 1 END AS BIGINT) AS class, count(*) AS n FROM k GROUP BY 1, 2"""
)
def voxel_boundary_classes(table):
    return V.boundary_classes(
        _voxels(table).withColumn("class", F.lit(1))
    ).groupBy(F.col("case").alias("case_id"), "class").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_MASKS}, g AS (SELECT DISTINCT c FROM gt), t AS (SELECT g.c, i AS x, j AS y, k AS z FROM g, range(0, 10) a(i), range(0, 12) b(j), range(0, 5) e(k)) SELECT t.c AS case_id, t.x, t.y, t.z FROM t JOIN gt ON gt.c = t.c AND gt.x = 2 * t.x + 1 AND gt.y = 2 * t.y AND gt.z = 2 * t.z"""
)
def voxel_resample(table):
    m = F.array(*(F.lit(float(v)) for v in (2, 0, 0, 1, 0, 2, 0, 0, 0, 0, 2, 0)))
    grid = _gt(table).select("case").distinct().select(
        "case", F.lit(10).alias("nx"), F.lit(12).alias("ny"), F.lit(5).alias("nz"), m.alias("m"),
    )
    return V.resample_nearest(_gt(table), grid).withColumnRenamed("case", "case_id")


@query(
    """WITH s AS (SELECT event_type, value / 600.0 AS p FROM events) SELECT event_type, round(sum(p), 6) AS mass, round(max(p), 6) AS max, round(avg(p) FILTER (WHERE p > 0.05), 6) AS fg_mean, round(stddev_pop(p) FILTER (WHERE p > 0.05), 6) AS fg_std, count(*) FILTER (WHERE p > 0.05) AS fg_voxels, round(avg(CASE WHEN p > 0.25 AND p < 0.75 THEN 1.0 ELSE 0.0 END) FILTER (WHERE p > 0.05), 6) AS ambiguous, round(CAST(count(*) FILTER (WHERE p >= 0.35) * 0.5 AS DOUBLE), 6) AS ml_35, round(CAST(count(*) FILTER (WHERE p >= 0.5) * 0.5 AS DOUBLE), 6) AS ml_50 FROM s GROUP BY 1"""
)
def soft_map_features(table):
    rows = table("events").select("event_type", (F.col("value") / 600.0).alias("p"))
    return V.soft_features(
        rows, "event_type", "p", (0.35, 0.5), F.lit(0.5),
    ).withColumnsRenamed({"ml_at_0.35": "ml_35", "ml_at_0.5": "ml_50"})


@query(
    """SELECT event_type, round(min(value), 6) AS min, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero_frac, round(quantile_cont(value, 0.5) FILTER (WHERE value > 0), 6) AS brain_p50, round(quantile_cont(value, 0.99) FILTER (WHERE value > 0), 6) AS brain_p99 FROM events GROUP BY 1"""
)
def intensity_statistics(table):
    return V.intensity_statistics(table("events"), ["event_type"], "value")


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT event_id, round(greatest(0.0, least(1.0, (value - lo) / (hi - lo))), 6) AS value FROM events JOIN q USING (event_type)"""
)
def clip_normalise(table):
    return V.clip_normalise(table("events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "value")


@query("""WITH c AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS i, avg(value) FILTER (WHERE event_type = 'view') AS a, stddev_pop(value) AS s FROM events GROUP BY 1), d AS (SELECT round((i - a) / nullif(s, 0), 9) AS cnr FROM c)
SELECT count(cnr) AS n, round(avg(abs(cnr)), 6) AS mean_abs, round(quantile_cont(abs(cnr), 0.5), 6) AS median_abs, round(avg(CASE WHEN cnr IS NULL THEN NULL WHEN abs(cnr) < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS invisible, round(avg(CASE WHEN cnr IS NULL THEN NULL WHEN cnr > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS bright, round(avg(CASE WHEN cnr IS NULL THEN NULL WHEN cnr < -0.5 THEN 1.0 ELSE 0.0 END), 6) AS dark FROM d""")
def contrast_statistics(table):
    side = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    rows = table("events").groupBy("user_id").agg(
        side("click").alias("inside"), side("view").alias("around"), F.stddev_pop("value").alias("spread"),
    )
    return reports.contrast(rows, "inside", "around", "spread")


# --- blobs -------------------------------------------------------------------------------------

_SUMMIT = f"""s AS (SELECT {_PLACE}, max(value) / 600 AS p FROM events GROUP BY ALL HAVING max(value) / 600 >= 0.1),
n AS (SELECT a.c, a.p, a.x, a.y, a.z, (a.z * 100 + a.y) * 100 + a.x AS id, (b.z * 100 + b.y) * 100 + b.x AS other, b.p AS q FROM s a JOIN s b ON a.c = b.c AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
r(c, id, p, seen, q) AS (SELECT c, id, p, id, p FROM n WHERE id = other UNION SELECT r.c, r.id, r.p, n.other, n.q FROM r JOIN n ON n.c = r.c AND n.id = r.seen WHERE n.q > r.p - 0.05)"""


def _soft(table, least):
    place = [
        F.col("event_type").alias("case"), (F.col("user_id") % 20).cast("int").alias("x"), F.hour("ts").alias("y"),
        (F.dayofyear("ts") % 10).cast("int").alias("z"),
    ]
    return table("events").groupBy(*place).agg((F.max("value") / 600).alias("p")).filter(F.col("p") >= least)


@query(f"""WITH RECURSIVE {_SUMMIT}, h AS (SELECT c, id, p FROM r GROUP BY ALL HAVING max(q) <= p) SELECT c AS case_id, CAST(id % 100 AS BIGINT) AS x, CAST(id // 100 % 100 AS BIGINT) AS y, CAST(id // 10000 AS BIGINT) AS z, round(p, 6) AS p FROM h""")
def voxel_summits(table):
    """Places from which no higher one can be reached without going down by 0.05 at least."""
    return blobs.h_maxima(_soft(table, 0.1), 0.05).select(F.col("case").alias("case_id"), "x", "y", "z", "p")


@query(None)
def voxel_blob_split(table):
    """Components of a soft map's mask before and after lines between their summits are cut out."""
    soft = _soft(table, 0.1)
    whole, parts = blobs.soft_components(soft), V.label(blobs.split_blobs(soft, 0.05, 3))
    count = lambda df, n, k: df.groupBy("case").agg(F.count("*").alias(n), F.count_distinct("comp").alias(k))
    both = count(whole, "n_voxels", "n_blobs").join(count(parts, "n_kept", "n_parts"), "case")
    return both.withColumnRenamed("case", "case_id")


# --- matching, records, forms -------------------------------------------------------------------


def _parts(*masks: str) -> str:
    return ", ".join([_MASKS, *map(_components, masks)])


_PAIRS = """gn AS (SELECT c, comp AS a, count(*) AS n_gt FROM gt_c GROUP BY ALL), pn AS (SELECT c, comp AS b, count(*) AS n_pred FROM pr_c GROUP BY ALL),
met AS (SELECT g.c, g.comp AS a, p.comp AS b, count(*) AS shared FROM gt_c g JOIN pr_c p ON g.c = p.c AND g.x = p.x AND g.y = p.y AND g.z = p.z GROUP BY ALL),
pairs AS (SELECT c, a, b, shared, CAST(shared AS DOUBLE) / (n_gt + n_pred - shared) AS iou FROM met JOIN gn USING (c, a) JOIN pn USING (c, b))"""


@query(f"""WITH RECURSIVE {_parts("gt", "pr")}, {_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY iou DESC, a, b) AS k FROM pairs WHERE iou >= 0.25),
r(c, k, used_a, used_b, tp) AS (SELECT DISTINCT c, 0::BIGINT, []::BIGINT[], []::BIGINT[], 0::BIGINT FROM tissue UNION ALL SELECT r.c, o.k, CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN used_a ELSE list_append(used_a, o.a) END, CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN used_b ELSE list_append(used_b, o.b) END, tp + CASE WHEN list_contains(used_a, o.a) OR list_contains(used_b, o.b) THEN 0 ELSE 1 END FROM r JOIN o ON o.c = r.c AND o.k = r.k + 1),
f AS (SELECT c, max(tp) AS tp FROM r GROUP BY 1), q AS (SELECT f.c, tp, coalesce(n_p, 0) - tp AS fp, coalesce(n_g, 0) - tp AS fn, coalesce(n_g, 0) AS n_g, coalesce(n_p, 0) AS n_p FROM f LEFT JOIN (SELECT c, count(*) AS n_g FROM gn GROUP BY 1) USING (c) LEFT JOIN (SELECT c, count(*) AS n_p FROM pn GROUP BY 1) USING (c)),
d AS (SELECT c, 2.0 * coalesce(s, 0) / (g + p) AS dice FROM (SELECT c, count(*) AS g FROM gt GROUP BY 1) JOIN (SELECT c, count(*) AS p FROM pr GROUP BY 1) USING (c) LEFT JOIN (SELECT c, sum(shared) AS s FROM met GROUP BY 1) USING (c))
SELECT c AS case_id, tp, fp, fn, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + (fp + fn) / 2.0) END, 6) AS rq, round(CASE WHEN tp = 0 AND n_g > 0 AND n_p > 0 THEN 0.0 ELSE dice END, 6) AS dice FROM q LEFT JOIN d USING (c)""")
def voxel_recognition(table):
    """Components paired one to one by falling overlap; Dice falls to 0 where none is."""
    truth, predicted = V.label_both(_gt(table), _pr(table), 6)
    found = V.recognition(_voxels(table), truth, predicted)
    count = lambda k: F.count_if(F.col("class") == k)
    voxels = V.overlay(_gt(table), _pr(table)).groupBy("case").agg(
        (2.0 * count("TP") / (2 * count("TP") + count("FP") + count("FN"))).alias("d")
    )
    n_gt, n_pred = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    return found.join(voxels, "case", "left").select(
        F.col("case").alias("case_id"), "tp", "fp", "fn", "rq", V.collapsed_dice(F.col("d"), F.col("tp"), n_gt, n_pred).alias("dice"),
    )


@query(
    f"""WITH RECURSIVE {_parts("gt", "pr")}, {_PAIRS} SELECT c AS case_id, 'gt' AS side, n_gt AS n_voxels, coalesce(max(shared), 0) AS shared, CAST(a % 100 AS BIGINT) AS x FROM gn LEFT JOIN met USING (c, a) GROUP BY c, a, n_gt UNION ALL SELECT c, 'pred', n_pred, coalesce(max(shared), 0), CAST(b % 100 AS BIGINT) FROM pn LEFT JOIN met USING (c, b) GROUP BY c, b, n_pred"""
)
def voxel_overlap_maxima(table):
    best = V.overlap_maxima(*V.label_both(_gt(table), _pr(table), 6))
    return best.select(F.col("case").alias("case_id"), "side", "n_voxels", "shared", F.pmod("comp", F.lit(1 << 14)).alias("x"))


_BINS = (("one", 0, 2), ("few", 2, 5), ("some", 5, 20), ("many", 20, None))


@query(f"""WITH RECURSIVE {_parts("gt", "pr")}, {_PAIRS}, s AS (SELECT c, a, n_gt, max(shared) AS shared FROM gn LEFT JOIN met USING (c, a) GROUP BY ALL), k AS (SELECT c, CASE WHEN n_gt < 2 THEN 'one' WHEN n_gt < 5 THEN 'few' WHEN n_gt < 20 THEN 'some' ELSE 'many' END AS size_bin, count(*) AS n, count(shared) AS d FROM s GROUP BY 1, 2)
SELECT c AS case_id, size_bin, coalesce(n, 0) AS n_gt, coalesce(d, 0) AS n_detected, round(CAST(d AS DOUBLE) / n, 6) AS recall FROM (SELECT DISTINCT c FROM tissue) CROSS JOIN (SELECT unnest(['one', 'few', 'some', 'many']) AS size_bin) LEFT JOIN k USING (c, size_bin)""")
def voxel_binned_recall(table):
    truth, predicted = V.label_both(_gt(table), _pr(table), 6)
    return V.binned_recall(truth, predicted, _voxels(table), _BINS).withColumnRenamed("case", "case_id")


_TURNED = " UNION ALL ".join(f"SELECT c, '{''.join(map(str, p))}' AS axes, {', '.join(f'{"xyz"[p[k]]} AS {a}' for k, a in enumerate('xyz'))} FROM masks" for p in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)))


@query(f"""WITH {_MASKS}, masks AS (SELECT c, z AS x, x AS y, y AS z FROM gt), ref AS (SELECT * FROM gt WHERE c <> 'click' UNION ALL SELECT * FROM pr WHERE c = 'click'), t AS ({_TURNED}),
h AS (SELECT t.c, axes, count(*) AS n, count(r.c) AS hits FROM t LEFT JOIN ref r ON r.c = t.c AND r.x = t.x AND r.y = t.y AND r.z = t.z GROUP BY ALL), m AS (SELECT c, axes, CAST(n + k - 2 * hits AS DOUBLE) / (n + k) AS mismatch FROM h JOIN (SELECT c, count(*) AS k FROM ref GROUP BY 1) USING (c)),
q AS (SELECT *, row_number() OVER w AS i, lead(mismatch) OVER w AS next FROM m WINDOW w AS (PARTITION BY c ORDER BY mismatch, axes)), b AS (SELECT c, axes, mismatch, mismatch <= 0.001 AND (next IS NULL OR next > mismatch) AS ok FROM q WHERE i = 1), v AS (SELECT axes AS most FROM b WHERE ok GROUP BY axes ORDER BY count(*) DESC, axes LIMIT 1)
SELECT c AS case_id, CASE WHEN ok THEN axes ELSE most END AS axes, CASE WHEN ok THEN 'own' WHEN most IS NOT NULL THEN 'consensus' ELSE 'none' END AS source FROM b LEFT JOIN v ON true""")
def voxel_axis_permutation(table):
    """Masks with turned axes against their references; one case has a reference that fits no order, so the others decide."""
    masks = _gt(table).select("case", F.col("z").alias("x"), F.col("x").alias("y"), F.col("y").alias("z"))
    reference = _gt(table).filter("case <> 'click'").unionByName(_pr(table).filter("case = 'click'"))
    return V.resolve_permutation(V.best_permutation(masks, reference)).withColumnRenamed("case", "case_id")


@query(f"""WITH RECURSIVE {_MASKS}, box AS (SELECT c, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(z) - 1 AS z0, max(z) + 1 AS z1 FROM tissue GROUP BY 1),
cells AS (SELECT c, x, y, z FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM box), (SELECT c AS c2, unnest(range(y0, y1 + 1)) AS y FROM box), (SELECT c AS c3, unnest(range(z0, z1 + 1)) AS z FROM box) WHERE c = c2 AND c = c3), free AS (SELECT * FROM cells ANTI JOIN tissue USING (c, x, y, z)),
out(c, x, y, z) AS (SELECT c, x0, y0, z0 FROM box UNION SELECT f.c, f.x, f.y, f.z FROM out o JOIN free f ON f.c = o.c AND abs(f.x - o.x) + abs(f.y - o.y) + abs(f.z - o.z) = 1), holes AS (SELECT * FROM free ANTI JOIN out USING (c, x, y, z))
SELECT c AS case_id, count(*) AS n_voxels, CAST(sum(hole) AS BIGINT) AS n_holes FROM (SELECT c, 0 AS hole FROM tissue UNION ALL SELECT c, 1 FROM holes) GROUP BY 1""")
def voxel_filled_holes(table):
    tissue = _voxels(table)
    full = V.fill_holes(tissue)
    holes = full.join(tissue, ["case", "x", "y", "z"], "left_anti").groupBy("case").agg(F.count("*").alias("n_holes"))
    return full.groupBy("case").agg(
        F.count("*").alias("n_voxels")
    ).join(holes, "case", "left").fillna(0).withColumnRenamed("case", "case_id")


@query(
    f"""WITH RECURSIVE {_parts("gt")}, n AS (SELECT c, comp, count(*) AS k FROM gt_c GROUP BY ALL), b AS (SELECT c, comp FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k DESC, comp) AS i FROM n) WHERE i = 1) SELECT g.c AS case_id, x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM gt_c g JOIN b USING (c, comp)"""
)
def voxel_largest_component(table):
    return V.largest_component(_gt(table), 6).withColumnRenamed("case", "case_id")


_ALL = " ".join(f"WHEN {v} THEN {k}" for k, v in enumerate(V.TISSUE_LABELS))
_GROUPED = " ".join(f"WHEN {v} THEN {k}" for k, vs in V.TISSUE_GROUPS.items() for v in vs)


@query(
    f"""WITH l AS (SELECT event_id, user_id % 64 AS label, value > 450 AS lesion FROM events) SELECT event_id, CAST(CASE WHEN lesion THEN {len(V.TISSUE_LABELS)} ELSE coalesce(CASE label {_ALL} END, 0) END AS BIGINT) AS every, CAST(CASE WHEN lesion THEN {1 + max(V.TISSUE_GROUPS)} ELSE coalesce(CASE label {_GROUPED} END, 0) END AS BIGINT) AS grouped FROM l"""
)
def tissue_remap(table):
    rows = table("events").select("event_id", (F.col("user_id") % 64).alias("label"), (F.col("value") > 450).alias("lesion"))
    return V.remap(
        V.remap(rows).withColumnRenamed("class", "every"), "grouped",
    ).select("event_id", "every", F.col("class").alias("grouped"))


@query(f"""WITH s AS (SELECT {_PLACE}, max(value) / 600 AS p FROM events GROUP BY ALL), t AS (SELECT c, tx, ty, tz, tx * 1.37::DOUBLE + 0.21::DOUBLE AS sx, ty * 0.83::DOUBLE AS sy, tz * 0.43::DOUBLE AS sz FROM (SELECT DISTINCT c FROM s), range(0, 12) a(tx), range(0, 24) b(ty), range(0, 18) e(tz)),
n AS (SELECT *, floor(sx) + i AS x, floor(sy) + j AS y, floor(sz) + k AS z, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN k = 1 THEN sz - floor(sz) ELSE 1 - (sz - floor(sz)) END) AS w FROM t, range(0, 2) f(i), range(0, 2) g(j), range(0, 2) h(k))
SELECT c AS case_id, tx AS x, ty AS y, tz AS z, round(sum(w * p), 6) AS p FROM n JOIN s USING (c, x, y, z) WHERE w > 0 GROUP BY ALL HAVING sum(w * p) <> 0""")
def voxel_linear(table):
    """Soft maps on a grid of other steps, by trilinear interpolation."""
    place = [
        F.col("event_type").alias("case"), (F.col("user_id") % 20).cast("int").alias("x"), F.hour("ts").alias("y"),
        (F.dayofyear("ts") % 10).cast("int").alias("z"),
    ]
    soft = table("events").groupBy(*place).agg((F.max("value") / 600).alias("p"))
    m = F.array(*(F.lit(float(v)) for v in (1.37, 0, 0, 0.21, 0, 0.83, 0, 0, 0, 0, 0.43, 0)))
    grid = soft.select("case").distinct().select("case", F.lit(12).alias("nx"), F.lit(24).alias("ny"), F.lit(18).alias("nz"), m.alias("m"))
    return V.resample_linear(soft, grid).withColumnRenamed("case", "case_id")


_OWN = (0.913, 0.0, 0.307, -2.017, 0.109, 1.523, 0.0, 3.041, -0.411, 0.0, 1.811, 1.013)
_REF = (0.811, -0.503, 0.0, 1.0137, 0.409, 1.103, 0.211, -1.0211, 0.0, 0.107, 1.307, 2.0173)


def _between_sql() -> str:
    """The place in the own grid of each cell of the reference's, by a matrix from an inverse that is computed here."""
    full = lambda m: np.vstack([np.reshape(m, (3, 4)), [0, 0, 0, 1]])
    m = np.linalg.inv(full(_OWN)) @ full(_REF)
    at = ", ".join(f"{m[i, 0]:.17g}::DOUBLE * tx + {m[i, 1]:.17g}::DOUBLE * ty + {m[i, 2]:.17g}::DOUBLE * tz + {m[i, 3]:.17g}::DOUBLE AS s{a}" for i, a in enumerate("xyz"))
    return f"""t AS (SELECT c, tx, ty, tz, {at} FROM (SELECT DISTINCT c FROM s), range(0, 22) a(tx), range(0, 26) b(ty), range(0, 14) e(tz))"""


@query(f"""WITH s AS (SELECT {_PLACE}, max(value) / 600 AS p FROM events GROUP BY ALL), {_between_sql()},
n AS (SELECT *, floor(sx) + i AS x, floor(sy) + j AS y, floor(sz) + k AS z, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN k = 1 THEN sz - floor(sz) ELSE 1 - (sz - floor(sz)) END) AS w FROM t, range(0, 2) f(i), range(0, 2) g(j), range(0, 2) h(k)),
l AS (SELECT c, tx, ty, tz, sum(w * p) AS p FROM n JOIN s USING (c, x, y, z) WHERE w > 0 GROUP BY ALL), m AS (SELECT t.c, tx, ty, tz FROM t JOIN s ON s.c = t.c AND s.x = round_even(sx, 0) AND s.y = round_even(sy, 0) AND s.z = round_even(sz, 0))
SELECT coalesce(l.c, m.c) AS case_id, coalesce(l.tx, m.tx) AS x, coalesce(l.ty, m.ty) AS y, coalesce(l.tz, m.tz) AS z, round(l.p, 6) AS p, m.c IS NOT NULL AS nearest FROM l FULL JOIN m ON l.c = m.c AND l.tx = m.tx AND l.ty = m.ty AND l.tz = m.tz""")
def voxel_onto_reference(table):
    """Soft maps and masks on a turned reference grid, from the two grids' matrices."""
    soft = _soft(table, 0)
    grid = lambda n, m: soft.select("case").distinct().select(
        "case", *(F.lit(v).alias(f"n{a}") for v, a in zip(n, "xyz")), F.array(*map(F.lit, m)).alias("affine"),
    )
    own, reference = grid((20, 24, 10), _OWN), grid((22, 26, 14), _REF)
    mask = V.resample_onto(soft.drop("p"), own, reference).withColumn("nearest", F.lit(True))
    both = V.resample_onto(soft, own, reference).join(mask, ["case", "x", "y", "z"], "full").fillna(False, "nearest")
    return both.withColumnRenamed("case", "case_id")


_RECORD = (
    "tp", "fp", "fn", "tn", "dice", "iou", "sensitivity", "specificity", "precision", "npv", "hd95", "assd", "masd", "surface_dice",
    "gt_count", "pred_count", "detected_gt", "tp_pred", "lesion_precision", "lesion_recall", "lesion_f1",
)


def _record_sql() -> str:
    lenient = ORACLES["voxel_lenient_detection"].replace("HAVING count(*) >= 2", "HAVING count(*) >= 1")
    volumes = "round((tp + fn) * 0.003::DOUBLE, 6) AS gt_ml, round((tp + fp) * 0.003::DOUBLE, 6) AS pred_ml, round(abs(fp - fn) * 0.003::DOUBLE, 6) AS abs_diff"
    return f"SELECT case_id, {', '.join(_RECORD)}, {volumes} FROM ({ORACLES['voxel_overlap']}) JOIN ({ORACLES['voxel_boundary_metrics']}) USING (case_id) JOIN ({lenient}) USING (case_id)"


@query(_record_sql())
def voxel_case_record(table):
    """Everything that is measured of a case, as one row."""
    record = V.case_record(_gt(table), _pr(table), _sizes(table), 6)
    return record.select(F.col("case").alias("case_id"), *_RECORD, "gt_ml", "pred_ml", "abs_diff")


_SPARSE = f"gt AS (SELECT DISTINCT {_PLACE} FROM events WHERE value >= 60), pr AS (SELECT DISTINCT {_PLACE} FROM events WHERE value >= 50 AND value < 150), tissue AS (SELECT DISTINCT {_PLACE} FROM events)"


def _manifest_sql() -> str:
    """The parts of the record on sparser masks, with corners as neighbours."""
    faces, corners = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1)", "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1)"
    part = lambda name: f"({ORACLES[name].replace(_MASKS, _SPARSE).replace(faces, corners)})"
    record = f"SELECT case_id, tp, fp, fn, dice, hd95, surface_dice, gt_count, pred_count, detected_gt, tp_pred, lesion_f1, size_bin, n_gt, n_detected, recall FROM {part('voxel_overlap')} JOIN {part('voxel_boundary_metrics')} USING (case_id) JOIN {part('voxel_lenient_detection')} USING (case_id) JOIN {part('voxel_binned_recall')} USING (case_id) WHERE case_id <> 'click'"
    return f"SELECT case_id, 'site ' || length(case_id) AS site, CASE WHEN case_id = 'click' THEN 'prediction' ELSE '' END AS lacks, r.* EXCLUDE (case_id) FROM (SELECT DISTINCT event_type AS case_id FROM events) LEFT JOIN ({record}) r USING (case_id)"


@query(_manifest_sql())
def manifest_case_records(table):
    """Cases of a manifest with recall by size; predictions lie on grids turned round along x, and one is missing."""
    gt, predicted = _voxels(table, "value >= 60"), _voxels(table, "value >= 50 AND value < 150").withColumn("x", 19 - F.col("x"))
    matrix = lambda x, at: F.array(*map(F.lit, (x, 0.0, 0.0, at, 0.0, 1.5, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0)))
    reference, own = _sizes(table).withColumn("affine", matrix(1.0, 0.0)), _sizes(table).withColumn("affine", matrix(-1.0, 19.0))
    manifest = _sizes(table).select("case", F.concat(F.lit("site "), F.length("case")).alias("site"))
    found = V.manifest_records(manifest, gt, predicted.filter("case <> 'click'"), own.filter("case <> 'click'"), reference, bins=_BINS, least=2)
    rows = found.select("*", F.explode_outer("size_bins").alias("size_bin", "b"))
    return rows.select(
        F.col("case").alias("case_id"), "site", "lacks", "tp", "fp", "fn", "dice", "hd95", "surface_dice", "gt_count", "pred_count", "detected_gt",
        "tp_pred", "lesion_f1", "size_bin", "b.n_gt", "b.n_detected", "b.recall",
    )


_POINTS = (0.5, 0.65)


def _points_sql() -> str:
    one = """SELECT {t} AS threshold, {k} AS least, p.c AS case_id, count(*) FILTER (WHERE kept) AS n_voxels, count(*) FILTER (WHERE kept AND hit) AS tp FROM (SELECT m.c, coalesce(n >= {k}, false) AS kept, EXISTS (SELECT 1 FROM gt WHERE gt.c = m.c AND gt.x = m.x AND gt.y = m.y AND gt.z = m.z) AS hit FROM {m}_c m JOIN (SELECT c, comp, count(*) AS n FROM {m}_c GROUP BY ALL) s ON s.c = m.c AND s.comp = m.comp) p GROUP BY ALL"""
    masks = ", ".join(f"m{i} AS (SELECT DISTINCT {_PLACE} FROM events WHERE value >= {t * 600})" for i, t in enumerate(_POINTS))
    parts = " UNION ALL ".join(one.format(t=t, k=k, m=f"m{i}") for i, t in enumerate(_POINTS) for k in (1, 3))
    return f"WITH RECURSIVE {_MASKS}, {masks}, {', '.join(_components(f'm{i}') for i in range(len(_POINTS)))} SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(least AS BIGINT) AS least, case_id, n_voxels, tp FROM ({parts})"


@query(_points_sql())
def operating_points(table):
    """Every case at several thresholds and least sizes of a component."""
    out, gt = None, _gt(table).withColumn("hit", F.lit(1))
    for t in _POINTS:
        mask = V.label(_voxels(table, F.col("value") >= t * 600), 6)
        for k in (1, 3):
            kept = V.drop_small(mask, k).withColumn("kept", F.lit(1)).select("case", "x", "y", "z", "kept")
            rows = mask.join(kept, ["case", "x", "y", "z"], "left").join(gt, ["case", "x", "y", "z"], "left")
            one = rows.groupBy(F.lit(t).alias("threshold"), F.lit(k).alias("least"), F.col("case").alias("case_id")).agg(
                F.count("kept").alias("n_voxels"), F.count_if(F.col("kept").isNotNull() & F.col("hit").isNotNull()).alias("tp"),
            )
            out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {_MASKS} SELECT c AS case_id, CASE WHEN c = 'click' THEN NULL ELSE count(*) END AS n_voxels, CASE WHEN c = 'click' THEN NULL ELSE CAST(sum(x + 100 * y + 10000 * z) AS BIGINT) END AS places, c = 'click' AS failed FROM gt GROUP BY 1"""
)
def volume_round_trip(table):
    """Masks as files and back; one file is cut short, becomes a row with its error, and the others go on."""
    files = sinks.encoded(_gt(table), _sizes(table))
    broken = F.when(F.col("case") == "click", F.substring("content", 1, 400)).otherwise(F.col("content"))
    rows = readers.decoded(files.select("case", F.lit("").alias("path"), broken.alias("content")), strict=False)
    place = F.col("x") + 100 * F.col("y") + 10000 * F.col("z")
    return rows.groupBy(F.col("case").alias("case_id")).agg(
        F.nullif(F.count("p"), F.lit(0)).alias("n_voxels"), F.sum(place).alias("places"), F.max(F.col("error").isNotNull()).alias("failed"),
    )


@query(
    f"""WITH {_MASKS} SELECT c AS case_id, count(*) AS n_voxels, CAST(sum(x + 100 * y + 10000 * z) AS BIGINT) AS places, 20::BIGINT AS nx, 24::BIGINT AS ny, 10::BIGINT AS nz, 1.5::DOUBLE AS vy, -4.0::DOUBLE AS shift FROM gt GROUP BY 1"""
)
def volume_source_round_trip(table):
    """Masks written and read as a data source: grids from headers alone, voxels by slabs of planes."""
    matrix = F.array(*map(F.lit, (1.0, 0.0, 0.0, -4.0, 0.0, 1.5, 0.0, 5.0, 0.0, 0.0, 2.0, 6.0)))
    rows = _gt(table)
    folder = f"{shared_dir(rows.sparkSession)}/{uuid.uuid4().hex}"
    volume_source.write(sinks.encoded(rows, _sizes(table).withColumn("affine", matrix)), folder)
    read = volume_source.voxels(rows.sparkSession, folder, slab_bytes=1000, strict="true")
    voxels = read.groupBy("case").agg(F.count("*").alias("n_voxels"), F.sum(F.col("x") + 100 * F.col("y") + 10000 * F.col("z")).alias("places"))
    grid = volume_source.grids(rows.sparkSession, folder).select("case", "nx", "ny", "nz", "vy", F.get("affine", F.lit(3)).alias("shift"))
    return voxels.join(grid, "case").withColumnRenamed("case", "case_id")


@query(f"""WITH RECURSIVE {_MASKS}, s AS (SELECT {_PLACE}, max(value) / 600 AS p FROM events GROUP BY ALL), m AS (SELECT c, x, y, z FROM s WHERE p >= 0.7), {_components("m")}, n AS (SELECT c, comp, count(*) AS k FROM m_c GROUP BY ALL), kept AS (SELECT m_c.* FROM m_c JOIN n USING (c, comp) WHERE k >= 3)
SELECT c AS case_id, count(*) FILTER (WHERE kept) AS n_served, round(avg(p) FILTER (WHERE kept), 6) AS mean_served, CASE WHEN count(*) FILTER (WHERE kept) = 0 THEN round(avg(p), 6) END AS flat FROM (SELECT s.*, k.c IS NOT NULL AS kept FROM s LEFT JOIN kept k ON k.c = s.c AND k.x = s.x AND k.y = s.y AND k.z = s.z) GROUP BY 1""")
def served_requests(table):
    """Requests after post-processing: the voxels of components (by faces) that are large enough at the threshold, or a flat map."""
    place = [
        F.col("event_type").alias("request"), (F.col("user_id") % 20).cast("int").alias("x"), F.hour("ts").alias("y"),
        (F.dayofyear("ts") % 10).cast("int").alias("z"),
    ]
    out = jobs.serve(table("events").groupBy(*place).agg((F.max("value") / 600).alias("p")), "request", "p", 0.7, 3, 6)
    served = F.when(F.col("x").isNotNull(), F.col("p"))
    return out.groupBy(F.col("request").alias("case_id")).agg(
        F.count(served).alias("n_served"), F.avg(served).alias("mean_served"), F.max(F.when(F.col("x").isNull(), F.col("p"))).alias("flat"),
    )
