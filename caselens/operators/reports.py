"""Summaries, strata, pooled bins, profiles, rollups and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, ratio
from ..storage import stash


def to_long(df: DataFrame, ids: list[str], metrics: Sequence[str]) -> DataFrame:
    """Rows (ids, metric, value), values finite or NULL."""
    doubles = df.select(*ids, *(finite(m).alias(m) for m in metrics))
    return doubles.unpivot(ids, list(metrics), "metric", "value")


def six(value: str) -> list[Column]:
    """n_valid, mean, median (exact), population deviation, min and max, for groups whose distinct values fit a task; see quantiles()."""
    v = F.col(value)
    return [
        F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    ]


def describe(df: DataFrame, keys: list[str], value: str, at: Sequence[float] = (), names: Sequence[str] = ()) -> DataFrame:
    """(keys, n_valid, mean, std, std_samp, min, max, names) of each group: moments, and exact quantiles, interpolated between ranks.

    Distinct values are counted, dealt over ranges of (group, value), written once and numbered by running sums within a
    range and over ranges, so no task holds a group and the input is read once. NULL values count for nothing; groups
    without any others are there, and may have NULLs in their keys.
    """
    g = [f"__k{i}" for i in range(len(keys))]
    group = [F.col(k).alias(name) for k, name in zip(keys, g)]
    counts = df.groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(value).alias("__k"))
    parts = stash(counts.repartitionByRange(*g, "__v").withColumn("__part", F.spark_partition_id()))
    every = Window.partitionBy(*g)
    sums = parts.groupBy(*g, "__part").agg(F.sum("__k").alias("__s"), F.sum(F.col("__k") * F.col("__v")).alias("__t"))
    before = F.coalesce(F.sum("__s").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("__s").over(every)
    sums = sums.select(*g, "__part", before.alias("__before"), n.alias("__n"), ratio(F.sum("__t").over(every), n).alias("__mean"))
    inside = F.sum("__k").over(Window.partitionBy(*g, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumnsRenamed({c: f"{c}_of" for c in (*g, "__part")})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in ("__part", *g)))
    ranked = parts.withColumn("__upto", inside).join(ends, same).withColumn("__upto", F.col("__upto") + F.col("__before"))
    picked = []
    for i, q in enumerate(at):
        rank = F.lit(float(q)) * (F.col("__n") - 1)
        for side, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picked.append(F.max(F.when((F.col("__upto") - F.col("__k") <= r) & (r < F.col("__upto")), F.col("__v"))).alias(f"__{side}{i}"))
    away = F.sum(F.col("__k") * (F.col("__v") - F.col("__mean")) ** 2)
    found = ranked.groupBy(*g).agg(
        F.coalesce(F.max("__n"), F.lit(0)).alias("__n"), F.max("__mean").alias("__mean"), away.alias("__away"), F.min("__v").alias("__min"),
        F.max("__v").alias("__max"), *picked,
    )
    rest = lambda q: F.lit(float(q)) * (F.col("__n") - 1) - F.floor(F.lit(float(q)) * (F.col("__n") - 1))
    return found.select(
        *(F.col(name).alias(k) for k, name in zip(keys, g)), F.col("__n").alias("n_valid"), F.col("__mean").alias("mean"),
        F.sqrt(ratio("__away", "__n")).alias("std"),
        F.sqrt(ratio("__away", F.col("__n") - 1)).alias("std_samp"), F.col("__min").alias("min"), F.col("__max").alias("max"),
        *(
            (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * rest(q)).alias(name)
            for i, (q, name) in enumerate(zip(at, names))
        ),
    )


def quantiles(df: DataFrame, keys: list[str], value: str, at: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys, names): exact quantiles of each group that has values, see describe()."""
    found = describe(df, keys, value, at, names)
    return (found.filter("n_valid > 0") if keys else found).select(*keys, *names)


def joined_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two tables of groups on keys that may be NULL."""
    if not keys:
        return left.crossJoin(right)  # one row each
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(other, same, "left").drop(*(f"__{k}" for k in keys))


def summarise(df: DataFrame, ids: list[str], metrics: Sequence[str]) -> DataFrame:
    """One row for each (ids, metric)."""
    found = describe(to_long(df, ids, metrics), [*ids, "metric"], "value", (0.5,), ("median",))
    return found.select(*ids, "metric", "n_valid", "mean", "median", "std", "min", "max")


def means(df: DataFrame, ids: list[str], metrics: Sequence[str]) -> DataFrame:
    """n_valid and mean of each (ids, metric), where no more is asked for."""
    return to_long(df, ids, metrics).groupBy(*ids, "metric").agg(F.count("value").alias("n_valid"), F.avg("value").alias("mean"))


def strata(df: DataFrame, dims: list[str], aggregates: list[Column]) -> DataFrame:
    """All single dimensions and the total in one pass; ``dim`` and ``stratum`` name the group (total: 'all')."""
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(*aggregates, *(F.grouping(d).alias(f"__{d}") for d in dims))
    dim, stratum = F.lit("all"), F.lit("all")
    for d in dims:
        dim = F.when(F.col(f"__{d}") == 0, d).otherwise(dim)
        stratum = F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")).otherwise(stratum)
    names = [c for c in grouped.columns if c not in dims and not c.startswith("__")]
    return grouped.select(dim.alias("dim"), stratum.alias("stratum"), *names)


def pooled_bins(df: DataFrame, label: Column, detected: Column, bins: Sequence[tuple]) -> DataFrame:
    """Recall of each size bin from pooled counts; empty bins are rows too."""
    spark = df.sparkSession
    names = spark.createDataFrame([(k, b[0]) for k, b in enumerate(bins)], "bin_order int, size_bin string")
    counts = df.groupBy(label.alias("size_bin")).agg(F.count("*").alias("n_gt"), F.count_if(detected).alias("n_detected"))
    full = F.broadcast(names).join(counts, "size_bin", "left").fillna(0, ["n_gt", "n_detected"])
    return full.select("bin_order", "size_bin", "n_gt", "n_detected", ratio("n_detected", "n_gt").alias("recall"))


def profile(df: DataFrame, keys: list[str], value: str, at=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """count, min, exact percentiles, max, mean and sample deviation."""
    names = [f"p{round(q * 100):02d}" for q in at]
    found = describe(df.withColumn(value, finite(value)), keys, value, at, names)
    return found.select(*keys, F.col("n_valid").alias("n"), "min", *names, "max", "mean", F.col("std_samp").alias("std"))


def rollup(df: DataFrame, keys: list[str], value: str, empty: Column, flag: Column, least: int = 1) -> DataFrame:
    """n, median, p95, empties and the share of a flag for each group of at least ``least`` rows; largest first."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.avg(flag.cast("double")).alias("share"))
    out = joined_groups(out, quantiles(df, keys, value, (0.5, 0.95), ("median", "p95")), keys)
    out = out.select(*keys, "n", "median", "p95", "n_empty", "share")
    return out.filter(F.col("n") >= least).orderBy(F.col("n").desc(), *keys)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts, largest first, ties by value; the first ``top`` of them, if given."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value")
    return out if top is None else out.limit(top)


def flags(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of counts."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def pooled_and_macro(df: DataFrame, group: str, value: str) -> DataFrame:
    """The mean over rows, the mean of group means, and the number of each."""
    inner = df.groupBy(group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return inner.agg(
        ratio(F.sum("s"), F.sum("n")).alias("pooled"), F.avg("m").alias("macro"), F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"),
    )


def distribution(df: DataFrame, group: str, value: Column, groups: int) -> DataFrame:
    """How evenly a total is spread over groups: target, min, max, range and coefficient of variation."""
    loads = df.groupBy(group).agg(F.sum(value).cast("double").alias("load"))
    return loads.agg(
        (F.sum("load") / groups).alias("target"), F.min("load").alias("min"), F.max("load").alias("max"),
        (F.max("load") - F.min("load")).alias("range"), ratio(F.stddev_pop("load"), F.avg("load")).alias("cv"),
    )


def leaderboard(summary: DataFrame, method: str, metrics: Sequence[str], by: str, largest_first: bool = True) -> DataFrame:
    """A row for each method with the mean of each metric; methods without the leading metric last."""
    wide = summary.groupBy(method).pivot("metric", list(metrics)).agg(F.max("mean"))
    lead = F.col(by)
    return wide.orderBy(lead.desc_nulls_last() if largest_first else lead.asc_nulls_last(), method)


def label_set(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct rounded values of each group, joined by commas in numeric order."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.round(value).cast("int"))), ",").alias("labels"))


def contrast(df: DataFrame, inside: str, around: str, spread: str) -> DataFrame:
    """Contrast-to-noise statistics over cases: mean and median of the absolute value, and shares by sign."""
    cnr = df.withColumn("cnr", ratio(F.col(inside) - F.col(around), spread))
    shares = cnr.agg(
        F.avg((F.abs("cnr") < 0.5).cast("double")).alias("invisible"), F.avg((F.col("cnr") > 0.5).cast("double")).alias("bright"),
        F.avg((F.col("cnr") < -0.5).cast("double")).alias("dark"),
    )
    size = describe(cnr.select(F.abs("cnr").alias("size")), [], "size", (0.5,), ("median_abs",))
    both = size.crossJoin(shares)  # one row each
    return both.select(F.col("n_valid").alias("n"), F.col("mean").alias("mean_abs"), "median_abs", "invisible", "bright", "dark")


def worst_first(df: DataFrame, metric: str, case: str) -> DataFrame:
    return df.orderBy(F.col(metric).asc_nulls_last(), case)


def markdown_table(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Lines of a Markdown table, for reports of a few rows."""
    cells = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), F.lit(" |")).alias("line"))
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *(r.line for r in cells.toLocalIterator())]


def config_extras(df: DataFrame, config: str, flat: str, predicted_empty: Column, truth_empty: Column, constants: list[str]) -> DataFrame:
    """For each configuration: rows, mean of the flattened score, empty predictions and truths, and columns that are constant within it."""
    return df.groupBy(config).agg(
        F.count("*").alias("n"), F.avg(flat).alias("mean_flat"), F.count_if(predicted_empty).alias("n_pred_empty"),
        F.count_if(truth_empty).alias("n_gt_empty"), *(F.min(c).alias(c) for c in constants),
    )


def volume_summary(df: DataFrame, keys: list[str], volume: str) -> DataFrame:
    """n_known, n_missing, sum, mean, median and sum of log1p."""
    v = finite(volume)
    plain = df.groupBy(*keys).agg(
        F.count(v).alias("n_known"), F.count_if(v.isNull()).alias("n_missing"), F.sum(v).alias("sum"), F.avg(v).alias("mean"),
        F.sum(F.log1p(v)).alias("sum_log1p"),
    )
    both = joined_groups(plain, quantiles(df.withColumn("__v", v), keys, "__v", (0.5,), ("median",)), keys)
    return both.select(*keys, "n_known", "n_missing", "sum", "mean", "median", "sum_log1p")


def group_report(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """n of each group, and n, mean, median, min and max of each metric; the largest groups first, ties by name."""
    each = [
        f(finite(m)).alias(f"{m}_{name}") for m in metrics
        for name, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))
    ]
    middle = quantiles(to_long(df, [group], metrics), [group, "metric"], "value", (0.5,), ("median",))
    middle = middle.groupBy(group).agg(*(F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"{m}_median") for m in metrics))
    both = joined_groups(df.groupBy(group).agg(F.count("*").alias("n"), *each), middle, [group])
    names = [f"{m}_{name}" for m in metrics for name in ("n", "mean", "median", "min", "max")]
    return both.select(group, "n", *names).orderBy(F.col("n").desc(), group)


def dense_matrix(results: DataFrame, rows: DataFrame, columns: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Every row with every column (both small dimensions), NULL where results have nothing; reference rows come with it."""
    full = rows.crossJoin(F.broadcast(columns)).join(results, [*rows.columns, *columns.columns], "left")  # of two dimensions
    return full if reference is None else reference.unionByName(full, allowMissingColumns=True)


def sweep_summary(cases: DataFrame, threshold: str = "threshold") -> DataFrame:
    """A row for each threshold of case rows with voxel and lesion counts: means over cases, pooled ratios, sums.

    cases: threshold, dice, iou, sensitivity, precision, tp, fp, fn, tn, gt_count, pred_count, detected_gt, tp_pred, pred_ml, gt_ml.
    """
    means = [F.avg(finite(m)).alias(f"mean_{m}") for m in ("dice", "iou", "sensitivity", "precision")]
    sums = [F.sum(c).cast("bigint").alias(f"sum_{c}") for c in ("tp", "fp", "fn", "tn", "gt_count", "pred_count", "detected_gt", "tp_pred")]
    volumes = [
        F.avg(F.abs(F.col("pred_ml") - F.col("gt_ml"))).alias("mean_abs_ml"),
        F.avg(F.abs(F.col("pred_count") - F.col("gt_count"))).alias("mean_abs_count"),
    ]
    plain = cases.groupBy(threshold).agg(F.count("*").alias("n_cases"), *means, *sums, *volumes)
    out = joined_groups(plain, quantiles(cases.withColumn("__d", finite("dice")), [threshold], "__d", (0.5,), ("median_dice",)), [threshold])
    p, r = ratio("sum_tp_pred", "sum_pred_count"), ratio("sum_detected_gt", "sum_gt_count")
    out = out.withColumns(
        {
            "pooled_dice": ratio(2 * F.col("sum_tp"), 2 * F.col("sum_tp") + F.col("sum_fp") + F.col("sum_fn")), "lesion_precision": p,
            "lesion_recall": r,
        }
    )
    f1 = ratio(2 * F.col("lesion_precision") * F.col("lesion_recall"), F.col("lesion_precision") + F.col("lesion_recall"), 0.0)
    out = out.withColumns(
        {
            "lesion_f1": f1, "fp_lesions": F.col("sum_pred_count") - F.col("sum_tp_pred"),
            "fn_lesions": F.col("sum_gt_count") - F.col("sum_detected_gt"),
        }
    )
    return out.withColumn("harmonic", ratio(2 * F.col("mean_dice") * F.col("lesion_f1"), F.col("mean_dice") + F.col("lesion_f1"), 0.0))


def status_counts(df: DataFrame, status: str, case: str, examples: int = 20) -> DataFrame:
    """Rows of each status, and its first cases by name, as a report's examples."""
    first = F.row_number().over(Window.partitionBy(status).orderBy(case)) <= examples
    named = df.withColumn("__e", F.when(first, F.col(case)))
    return named.groupBy(status).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("__e")), ",").alias("examples"))


def clean_arms(df: DataFrame, case: str, arm: str, value: str, used: Column, held: Column, a: str, b: str) -> DataFrame:
    """(case, a, b, delta) of two arms, over cases that no arm was trained with: ``used`` folds must be the held-out one."""
    flagged = df.withColumn("__dirty", ~used.eqNullSafe(held))
    side = lambda name: F.avg(F.when((F.col(arm) == name) & ~F.col("__dirty"), F.col(value)))
    both = flagged.groupBy(case).agg(side(a).alias("a"), side(b).alias("b"), F.count_if("__dirty").alias("n_contaminated"))
    return both.select(case, "a", "b", (F.col("b") - F.col("a")).alias("delta"), "n_contaminated")


def provenance_document(df: DataFrame, keys: list[str], case: str, checks: dict[str, Column], name: str) -> DataFrame:
    """A JSON text for each group: the results of its checks, and its cases in order."""
    out = df.groupBy(*keys).agg(*(c.alias(f"__{k}") for k, c in checks.items()), F.array_sort(F.collect_list(case)).alias("__cases"))
    body = F.struct(*(F.col(f"__{k}").alias(k) for k in checks), F.col("__cases").alias(name))
    return out.select(*keys, F.to_json(body).alias("document"))
