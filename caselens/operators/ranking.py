"""Ranks, z-scores, arg-extrema with stated ties, samples and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash
from .relational import first_by_priority

best_row = first_by_priority


def average_rank(keys: list[str], value: Column) -> Column:
    """Rank from 1, ties sharing their mean rank. ``value`` sorts ascending."""
    own = Window.partitionBy(*keys)
    return F.rank().over(own.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def rank_aggregate(long: DataFrame, subject: str, config: str, largest_first: list[str]) -> DataFrame:
    """long: subject, config, metric, value. Mean rank of each configuration: over subjects within a metric, then over metrics."""
    key = F.when(F.col("metric").isin(largest_first), -F.col("value")).otherwise(F.col("value"))
    ranked = long.filter(F.col("value").isNotNull()).withColumn("key", key)
    ranked = ranked.withColumn("rank", average_rank([subject, "metric"], F.col("key")))
    each = ranked.groupBy(config, "metric").agg(F.avg("rank").alias("rank"))
    return each.groupBy(config).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n_metrics")).orderBy("mean_rank", config)


def rank_of_means(long: DataFrame, config: str, largest_first: list[str]) -> DataFrame:
    """Mean over metrics of the rank of each configuration's mean."""
    means = long.groupBy(config, "metric").agg(F.avg("value").alias("value"))
    key = F.when(F.col("metric").isin(largest_first), -F.col("value")).otherwise(F.col("value"))
    ranked = means.withColumn("key", key).withColumn("rank", average_rank(["metric"], F.col("key")))
    return ranked.groupBy(config).agg(F.avg("rank").alias("mean_rank")).orderBy("mean_rank", config)


def scalarise(long: DataFrame, subject: str, config: str, largest_first: list[str]) -> DataFrame:
    """(subject, config, score): sum over metrics of z-scores within the subject; constant metrics count 0."""
    own = Window.partitionBy(subject, "metric")
    spread = F.stddev_pop("value").over(own)
    z = F.when(spread < 1e-12, 0.0).otherwise((F.col("value") - F.avg("value").over(own)) / F.nullif(spread, F.lit(0.0)))
    signed = F.when(F.col("metric").isin(largest_first), z).otherwise(-z)
    return long.withColumn("z", signed).groupBy(subject, config).agg(F.sum("z").alias("score"))


def constrained_best(df: DataFrame, allowed: Column, order: list[Column]) -> DataFrame:
    """The first allowed row; of all rows, if none is allowed. Tasks keep their first row only."""
    tagged = df.withColumn("relaxed", ~F.coalesce(allowed, F.lit(False)))
    return tagged.orderBy("relaxed", *order).limit(1)


def nearest(df: DataFrame, keys: list[str], value: str, wanted: Column, tie: str) -> DataFrame:
    """The row with the value nearest to the wanted one; of ties, the least."""
    return first_by_priority(df, keys, [F.round(F.abs(F.col(value) - wanted), 12), F.col(tie)])


def numbered(df: DataFrame, order: list[Column], name: str = "__i") -> DataFrame:
    """df with the number of each row, from 0, in an order without ties.

    Rows are dealt by ranges of the order; ranges are numbered apart, and counts
    of the ranges before, one row each, are added. No task sorts the table.
    """
    parts = stash(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over ranges
    ahead = F.broadcast(counts.select("__part", before.alias("__ahead")))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn(name, own).join(ahead, "__part").withColumn(name, F.col(name) + F.col("__ahead")).drop("__part", "__ahead")


def representative(df: DataFrame, metric: str, case: str, worst: int = 3, middle: int = 2, best: int = 2) -> DataFrame:
    """The worst, middle and best cases, each case once, with its role."""
    n = df.count()
    half = n // 2 - middle // 2
    ranked = numbered(df, [F.col(metric).asc_nulls_last(), F.col(case)])
    i = F.col("__i")
    role = F.when(i < worst, "worst").when((i >= half) & (i < half + middle), "middle").when(i >= n - best, "best")
    return ranked.withColumn("role", role).filter("role IS NOT NULL").drop("__i")


def quantile_nearest(df: DataFrame, value: str, case: str, at=(0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """For each quantile, the row whose average rank over n is nearest; of ties, the first case.

    Average ranks come from the counts of distinct values, and only the rows of
    the two values on either side of a quantile are looked at.
    """
    rows = df.filter(F.col(value).isNotNull())
    counts = stash(rows.groupBy(value).agg(F.count("*").alias("__k"), F.min(case).alias("__first")))
    n = counts.agg(F.sum("__k")).first()[0] or 0
    ranges = numbered(counts, [F.col(value)], "__i").withColumn("__part", F.floor(F.col("__i") / 4096))
    sums = ranges.groupBy("__part").agg(F.sum("__k").alias("__s"))
    before = F.coalesce(
        F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0),
    )  # over blocks of values
    inside = F.coalesce(F.sum("__k").over(Window.partitionBy("__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranges.withColumn("__in", inside).join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part")
    pct = ranked.withColumn("pct", (F.col("__before") + F.col("__in") + (F.col("__k") + 1) / 2.0) / n)
    best = None
    for q in at:
        one = pct.orderBy(F.abs(F.col("pct") - q), "__first").limit(1).withColumn("quantile", F.lit(float(q)))
        best = one if best is None else best.unionByName(one)
    picked = best.select("quantile", F.col(value), F.col("__first").alias(case), "pct")
    return picked if set(df.columns) <= {value, case} else picked.join(df, [value, case])


def every_kth(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return numbered(df, order).filter(F.pmod("__i", F.lit(k)) == 0).drop("__i")


def best_so_far(df: DataFrame, keys: list[str], step: str, metric: str) -> DataFrame:
    """The step of each key whose metric no step exceeds; of equal ones the earliest; NaN and NULL never count."""
    usable = df.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    return first_by_priority(usable, keys, [F.col(metric).desc(), F.col(step)])


def hash_order(seed: int | str, key: str) -> Column:
    """A random order without a random generator, the same on every run and cluster."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def stratified_sample(df: DataFrame, strata: list[str], key: str, k: int, seed: int | str = 0) -> DataFrame:
    return df.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, key), key)),
    ).filter(F.col("__n") <= k).drop("__n")


def round_robin(df: DataFrame, strata: list[str], key: str, folds: int, seed: int | str = 0) -> DataFrame:
    """Folds dealt in turn within each stratum, from an offset of the stratum's own."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, key), key)) - 1
    offset = F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), *(F.col(s).cast("string") for s in strata))), F.lit(folds))
    return df.withColumn("fold", F.pmod(place + offset, F.lit(folds)).cast("int"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def best_slice(voxels: DataFrame, case: str, axis: str) -> DataFrame:
    """The slice of each case with the most voxels; of ties, the first."""
    return first_by_priority(voxels.groupBy(case, axis).agg(F.count("*").alias("n")), [case], [F.col("n").desc(), F.col(axis)])


def centers(voxels: DataFrame, case: str) -> DataFrame:
    return voxels.groupBy(case).agg(*(F.avg(a).alias(a) for a in ("x", "y", "z")))


def chain(df: DataFrame, keys: list[str], order: list[Column], node: str) -> DataFrame:
    """(source, target) of nodes that follow each other."""
    return df.withColumn(
        "target", F.lead(node).over(Window.partitionBy(*keys).orderBy(*order)),
    ).filter("target IS NOT NULL").select(*keys, F.col(node).alias("source"), "target")
