"""Overlap, volume and curve metrics, as aggregates over rows of (truth, prediction) or over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def confusion(df: DataFrame, keys: list[str], truth: Column, prediction: Column) -> DataFrame:
    """Counts tp, fp, fn, tn by keys, in one aggregation."""
    count = lambda c, name: F.count_if(c).cast("bigint").alias(name)
    return df.groupBy(*keys).agg(
        count(truth & prediction, "tp"), count(~truth & prediction, "fp"), count(truth & ~prediction, "fn"),
        count(~truth & ~prediction, "tn"),
    )


def with_tn(counts: DataFrame, total: str) -> DataFrame:
    """For sparse voxel tables, which hold no background: tn from the size of the grid."""
    return counts.withColumn("tn", F.col(total) - F.col("tp") - F.col("fp") - F.col("fn"))


def overlap(tp="tp", fp="fp", fn="fn", tn="tn") -> list[Column]:
    """dice and iou (1 where both sides are empty, 0 where one is), and four ratios that are NULL where undefined."""
    tp, fp, fn, tn = F.col(tp), F.col(fp), F.col(fn), F.col(tn)
    both, one = (tp + fp == 0) & (tp + fn == 0), (tp + fp == 0) | (tp + fn == 0)
    pair = lambda value, name: F.when(both, 1.0).when(one, 0.0).otherwise(value).alias(name)
    return [
        pair(ratio(2 * tp, 2 * tp + fp + fn), "dice"),
        pair(ratio(tp, tp + fp + fn), "iou"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tn, tn + fn).alias("npv"),
    ]


def volume_difference(predicted: Column, true: Column) -> list[Column]:
    """Absolute, signed, and relative difference (NULL for an empty truth)."""
    return [
        F.abs(predicted - true).alias("abs_diff"), (predicted - true).alias("signed_diff"),
        F.when(true > 0, F.abs(predicted - true) / true).alias("relative_diff"),
    ]


def detection(counts: DataFrame, vacuous: bool = False) -> DataFrame:
    """Adds lesion precision, recall and F1 to gt_count, pred_count, detected_gt, tp_pred.

    A ratio over nothing is NULL; with vacuous, it is 1 where the other side is empty too, else 0 (recall: 1).
    """
    empty_p = F.when(F.col("gt_count") > 0, 0.0).otherwise(1.0) if vacuous else F.lit(None).cast("double")
    p = F.when(F.col("pred_count") == 0, empty_p).otherwise(ratio("tp_pred", "pred_count"))
    r = F.when(F.col("gt_count") == 0, F.lit(1.0 if vacuous else None).cast("double")).otherwise(ratio("detected_gt", "gt_count"))
    both = (F.col("gt_count") == 0) & (F.col("pred_count") == 0)
    score = F.when(both, 1.0).when(F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0)) == 0, 0.0).otherwise(
        2 * F.coalesce(p, F.lit(0.0)) * F.coalesce(r, F.lit(0.0)) / (F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0)))
    )
    return counts.withColumns(
        {
            "lesion_precision": p, "lesion_recall": r, "lesion_f1": score, "abs_count_diff": F.abs(F.col("pred_count") - F.col("gt_count")),
            "signed_count_diff": F.col("pred_count") - F.col("gt_count"),
        }
    )


def pr_auc(df: DataFrame, keys: list[str], score: str, truth: Column) -> DataFrame:
    """Area under the precision-recall curve by keys: trapezoids over distinct scores, from (recall 0, precision 1).

    Without any positive: 1 for a constant score, else 0. Scores are grouped
    first, so windows run over distinct scores and not over rows.
    """
    points = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    falling = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    upto = falling.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    curve = points.withColumns(
        {"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto), "np": F.sum("pos").over(every), "levels": F.count("*").over(every)}
    )
    curve = curve.withColumns({"precision": F.col("tp").cast("double") / (F.col("tp") + F.col("fp")), "recall": ratio("tp", "np")})
    before = lambda c, first: F.coalesce(F.lag(c).over(falling), F.lit(first))
    curve = curve.withColumn("area", (F.col("recall") - before("recall", 0.0)) * (F.col("precision") + before("precision", 1.0)) / 2)
    return curve.groupBy(*keys).agg(F.sum("area").alias("area"), F.max("np").alias("np"), F.max("levels").alias("levels")).select(
        *keys, F.when(F.col("np") == 0, F.when(F.col("levels") == 1, 1.0).otherwise(0.0)).otherwise(F.col("area")).alias("pr_auc"),
    )


def flat_pr_auc(positives: Column, total: Column) -> Column:
    """The area for a constant score map: (1 + prevalence) / 2, and 1 without positives."""
    return F.when(positives == 0, 1.0).otherwise((1 + positives.cast("double") / total) / 2)


def sweep(df: DataFrame, keys: list[str], score: str, truth: Column, steps: int) -> DataFrame:
    """Confusion counts at all thresholds k / (steps + 1), k = 1..steps, at once.

    One aggregation by bucket of the score; then counts at or above a threshold
    are reverse running sums. No row is multiplied by the number of thresholds.
    """
    level = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * (steps + 1) + 1e-9).cast("int")
    buckets = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.least(level, F.lit(steps)).alias("level")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"),
    )
    groups = buckets.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.crossJoin(
        F.broadcast(df.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("level")))
    )  # groups x thresholds, not rows
    full = grid.join(buckets, [*keys, "level"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(*keys).orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    counts = full.withColumns(
        {
            "tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "all_pos": F.sum("pos").over(every),
            "all_neg": F.sum("neg").over(every),
        }
    )
    return counts.filter("level > 0").select(
        *keys, (F.col("level") / float(steps + 1)).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("all_neg") - F.col("fp")).alias("tn"),
    )


def sweep_at(df: DataFrame, keys: list[str], score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """The same at any list of thresholds: a row falls between two of them, and counts at or above each are reverse running sums."""
    cuts = sorted(set(map(float, thresholds)))
    level = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= F.col(score)))
    buckets = df.filter(F.col(score).isNotNull()).groupBy(*keys, level.alias("level")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"),
    )
    grid = df.sparkSession.createDataFrame([(k, t) for k, t in enumerate(cuts, 1)] + [(0, None)], "level int, threshold double")
    full = buckets.select(*keys).distinct().crossJoin(F.broadcast(grid)).join(
        buckets, [*keys, "level"], "left",
    ).fillna(0, ["pos", "neg"])  # groups x thresholds, not rows
    every = Window.partitionBy(*keys)
    above = every.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counts = full.withColumns(
        {
            "tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "all_pos": F.sum("pos").over(every),
            "all_neg": F.sum("neg").over(every),
        }
    )
    return counts.filter("level > 0").select(
        *keys, "threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"),
    )
