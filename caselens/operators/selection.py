"""Paired statistics, resampling gates, nested and leave-one-out selection, policies, decision rules."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, ratio
from .relational import first_by_priority


def paired_statistics(pairs: DataFrame, keys: list[str], case: str) -> DataFrame:
    """pairs: keys, case, a, b. Mean difference b - a with spread, t, better / worse / equal counts and the most influential case."""
    d = pairs.withColumn("d", F.col("b") - F.col("a"))
    top = first_by_priority(d, keys, [F.abs("d").desc(), F.col(case)]).select(
        *keys, F.col(case).alias("most_influential"), F.col("d").alias("__top"),
    )
    out = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.sum("d").alias("__sum"),
        F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"),
        F.count_if(F.col("d") == 0).alias("unchanged"),
    )
    out = out.join(top, keys) if keys else out.crossJoin(top)  # one row each
    se = F.col("sd") / F.sqrt(F.col("n"))
    return out.select(
        *keys, "n", "mean_diff", "sd", se.alias("se"),
        F.when(se == 0, 0.0).otherwise(F.col("mean_diff") / F.nullif(se, F.lit(0.0))).alias("t"), "better", "worse", "unchanged",
        "most_influential", ratio(F.col("__sum") - F.col("__top"), F.col("n") - 1).alias("mean_without"),
    )


def complementarity(df: DataFrame, case: str, model: str, value: str) -> DataFrame:
    """For unordered pairs of models over their common cases: share first > second, mean |difference|, correlation, n."""
    a = df.select(case, F.col(model).alias("first"), F.col(value).alias("x"))
    b = df.select(case, F.col(model).alias("second"), F.col(value).alias("y"))
    joined = a.join(b, case).filter("first < second")
    stats = joined.groupBy("first", "second").agg(
        F.avg((F.col("x") > F.col("y")).cast("double")).alias("p_first_better"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"), F.corr("x", "y").alias("__r"), F.stddev_pop("x").alias("__sx"),
        F.stddev_pop("y").alias("__sy"), F.count("*").alias("n"),
    )
    good = (F.col("n") >= 2) & (F.col("__sx") > 0) & (F.col("__sy") > 0)
    return stats.select("first", "second", "p_first_better", "mean_abs_diff", F.when(good, F.col("__r")).alias("r"), "n")


def oracle(df: DataFrame, case: str, model: str, value: str) -> DataFrame:
    """Mean of the best model of each case, the best single model's mean, and the gap."""
    best = df.groupBy(case).agg(F.max(value).alias("m")).agg(F.avg("m").alias("oracle"))
    single = df.groupBy(model).agg(F.avg(value).alias("m")).orderBy(F.col("m").desc(), model).limit(1).select(
        F.col(model).alias("best_single"), F.col("m").alias("best_mean"),
    )
    return best.crossJoin(single).withColumn("headroom", F.col("oracle") - F.col("best_mean"))  # one row each


def policy(scores: DataFrame, chosen: DataFrame, case: str, config: str, value: str, default: str) -> DataFrame:
    """A policy's mean against a fixed configuration's, and the share of the oracle's headroom that it takes."""
    own = scores.join(chosen.select(case, config), [case, config]).agg(F.avg(value).alias("policy"))
    fixed = scores.filter(F.col(config) == default).agg(F.avg(value).alias("fixed"))
    top = scores.groupBy(case).agg(F.max(value).alias("m")).agg(F.avg("m").alias("oracle"))
    return own.crossJoin(fixed).crossJoin(top).withColumn(
        "headroom_taken", ratio(F.col("policy") - F.col("fixed"), F.col("oracle") - F.col("fixed")),
    )  # one row each


def leave_one_out(cells: DataFrame, case: str, cell: str, value: str) -> DataFrame:
    """For each case, the cell with the best mean over all other cases (ties: first cell), and its value there.

    Means over others come from sums over all; nothing is repeated for each case.
    """
    own = Window.partitionBy(cell)
    others = ratio(F.sum(value).over(own) - F.col(value), F.count(value).over(own) - 1)
    ranked = cells.withColumn("mean_of_others", others)
    return first_by_priority(ranked, [case], [F.col("mean_of_others").desc_nulls_last(), F.col(cell)])


def nested(df: DataFrame, fold: str, config: str, value: str) -> DataFrame:
    """For each fold, the configuration with the best mean outside it, and that one's mean inside."""
    by_fold = df.groupBy(fold, config).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    every = Window.partitionBy(config)
    table = by_fold.withColumns(
        {"outside": ratio(F.sum("s").over(every) - F.col("s"), F.sum("n").over(every) - F.col("n")), "inside": ratio("s", "n")}
    )
    return first_by_priority(table, [fold], [F.col("outside").desc_nulls_last(), F.col(config)]).select(fold, config, "outside", "inside")


def _poisson(most: int = 8) -> tuple[float, ...]:
    """Probabilities that a Poisson number of mean 1 is at most k, for k below ``most``."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(1, most + 1):
        total += term
        out.append(total)
        term /= k
    return tuple(out)


POISSON = _poisson()


def poisson_draws(cases: DataFrame, case: str, n_boot: int, seed: int) -> DataFrame:
    """cases, with boot and weight: how often each is drawn in each resample, from hashes; zero weights are left out.

    Poisson resampling needs no index table and no join; cases can be split over any number of tasks.
    """
    boots = cases.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    digest = F.md5(F.concat_ws(":", F.col(case).cast("string"), F.col("boot").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint") / float(1 << 40)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    return boots.withColumn("weight", weight).filter("weight > 0")


def bootstrap(pairs: DataFrame, case: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """pairs: case, a, b. Effect mean(b) - mean(a), its bootstrap error and 95% interval."""
    drawn = poisson_draws(pairs.select(case, (F.col("b") - F.col("a")).alias("d")), case, n_boot, seed)
    means = drawn.groupBy("boot").agg(ratio(F.sum(F.col("d") * F.col("weight")), F.sum("weight")).alias("m"))
    spread = means.agg(
        F.stddev_samp("m").alias("se"), F.percentile("m", 0.025).alias("ci_lo"), F.percentile("m", 0.975).alias("ci_hi"),
        F.count("*").alias("n_boot"),
    )
    effect = pairs.agg((F.avg("b") - F.avg("a")).alias("effect"), F.count("*").alias("n_cases"))
    return effect.crossJoin(spread)  # one row each


class Score(NamedTuple):
    """A score of many cases: the columns whose weighted sums it needs, and what it makes of their totals and means."""

    columns: tuple[str, ...]
    of: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def mean_score(value: str) -> Score:
    return Score((value,), lambda total, mean: mean(value))


def harmonic_mean(first: str, second: str) -> Score:
    """Of two means over cases."""
    return Score((first, second), lambda total, mean: _harmonic(mean(first), mean(second)))


def pooled_f1(tp_pred: str, pred: str, detected: str, gt: str) -> Score:
    """F1 of precision and recall from counts pooled over cases; without predictions, precision is 1 if there is nothing to find."""

    def of(total, mean):
        precision = F.when(total(pred) > 0, total(tp_pred) / F.nullif(total(pred), F.lit(0.0))).when(total(gt) > 0, 0.0).otherwise(1.0)
        recall = F.when(total(gt) > 0, total(detected) / F.nullif(total(gt), F.lit(0.0))).otherwise(1.0)
        return _harmonic(precision, recall)

    return Score((tp_pred, pred, detected, gt), of)


def bootstrap_scores(cases: DataFrame, case: str, score: Score, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """cases: case, and each of the score's columns as a_ and b_ (two sides). Effect score(b) - score(a), its error and 95% interval.

    One pass sums the vectors of all columns by resample; ratios come after. Missing values and NaN count for nothing.
    """
    names = [f"{side}_{c}" for side in "ab" for c in dict.fromkeys(score.columns)]
    rows = cases.select(case, *(finite(c).alias(c) for c in names)).withColumn("weight", F.lit(1))

    def scored(drawn: DataFrame, keys: list[str]) -> DataFrame:
        w = F.col("weight")
        sums = drawn.groupBy(*keys).agg(
            F.count("*").alias("__n"), *(F.coalesce(F.sum(F.col(c) * w), F.lit(0.0)).alias(f"__s_{c}") for c in names),
            *(F.sum(F.when(F.col(c).isNotNull(), w)).alias(f"__w_{c}") for c in names),
        )
        side = lambda s: score.of(
            lambda c: F.col(f"__s_{s}_{c}"), lambda c: ratio(f"__s_{s}_{c}", f"__w_{s}_{c}"),
        )
        return sums.select(*keys, "__n", (side("b") - side("a")).alias("m"))

    means = scored(poisson_draws(rows.drop("weight"), case, n_boot, seed), ["boot"])
    spread = means.agg(
        F.stddev_samp("m").alias("se"), F.percentile("m", 0.025).alias("ci_lo"), F.percentile("m", 0.975).alias("ci_hi"), F.count("m").alias("n_boot"),
    )
    effect = scored(rows, []).select(F.col("m").alias("effect"), F.col("__n").alias("n_cases"))
    return effect.crossJoin(spread)  # one row each


def gate(boot: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Whether the effect exceeds a multiple of its error, with the reason in words."""
    bar = F.when(F.col("se") > 0, multiplier * F.col("se")).otherwise(0.0)
    passed = F.col("effect") > bar
    words = F.format_string("effect %+.5f %s %.5f", F.col("effect"), F.when(passed, "exceeds").otherwise("does not exceed"), bar)
    return boot.withColumns({"deviates": passed, "z": ratio("effect", "se"), "reason": words})


def decide(arms: DataFrame, name: str, rules: list[tuple[str, Column]], cost: str) -> DataFrame:
    """ADOPT or REJECT for each arm with all failed rules, and the cheapest adopted arm marked."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules)))
    judged = arms.withColumns({"reasons": F.array_join(failed, "; "), "decision": F.when(F.size(failed) == 0, "ADOPT").otherwise("REJECT")})
    first = F.row_number().over(Window.partitionBy("decision").orderBy(cost, name)) == 1
    return judged.withColumn("chosen", first & (F.col("decision") == "ADOPT"))


def promotion(rq_gain: Column, avd_change: Column, dice_change: Column) -> Column:
    """Promoted if RQ gains 0.020 or volume error falls by 0.30, and Dice does not fall by more than 0.005."""
    return ((rq_gain >= 0.020) | (avd_change <= -0.30)) & (dice_change >= -0.005)


def on_edge(df: DataFrame, threshold: str, chosen: Column) -> DataFrame:
    """Whether the chosen threshold lies on the edge of the grid (of more than one)."""
    return df.agg(F.min(threshold).alias("lo"), F.max(threshold).alias("hi")).select(
        ((F.col("lo") < F.col("hi")) & ((F.abs(chosen - F.col("lo")) <= 1e-9) | (F.abs(chosen - F.col("hi")) <= 1e-9))).alias("on_edge")
    )


def best_on_edge(df: DataFrame, threshold: str, value: str) -> DataFrame:
    """on_edge() for the threshold of the largest value, of ties the smallest one, in one aggregate."""
    rank = F.struct(F.col(value), -F.col(threshold))
    ends = df.agg(F.min(threshold).alias("lo"), F.max(threshold).alias("hi"), F.max_by(threshold, rank).alias("best"))
    near = lambda c: F.abs(F.col("best") - F.col(c)) <= 1e-9
    return ends.select(((F.col("lo") < F.col("hi")) & (near("lo") | near("hi"))).alias("on_edge"))


def reproduces(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose value differs between two summaries, or that only one has."""
    right = b.select(*on, F.col(value).alias("__b"))
    return a.select(*on, value).join(right, on, "full").filter(
        F.col(value).isNull() | F.col("__b").isNull() | (F.abs(F.col(value) - F.col("__b")) > tolerance)
    )


def size_rule(df: DataFrame, size: str, cut: float, below: int, above: int) -> DataFrame:
    """A policy by predicted size."""
    return df.withColumn("config", F.when(F.col(size) < cut, below).otherwise(above))


def fit_log_volume(train: DataFrame, features: list[str], volume: str):
    """A gradient-boosted regressor on log1p(volume); transform() gives ``predicted_volume``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [
        SQLTransformer(statement=f"SELECT *, log1p({volume}) AS __y FROM __THIS__"),
        VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"),
        GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="__p", maxIter=20, maxDepth=3, seed=1),
        SQLTransformer(statement="SELECT *, expm1(__p) AS predicted_volume FROM __THIS__"),
    ]
    return Pipeline(stages=stages).fit(train)


def nested_predictions(df: DataFrame, fold: str, fit, outputs: list[str]) -> DataFrame:
    """df's rows with what a model fitted on all other folds says: fit(train) gives a model. Folds are few."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = [fit(df.filter(F.col(fold) != k)).transform(df.filter(F.col(fold) == k)).select(*df.columns, *outputs) for k in folds]
    return reduce(DataFrame.unionByName, parts)


def fit_configuration(train: DataFrame, features: list[str], config: str):
    """A forest that names the configuration for a case; transform() gives ``predicted_config``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=config, outputCol="__y", handleInvalid="keep").fit(train)
    stages = [
        index, VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="__x", labelCol="__y", predictionCol="__p", numTrees=30, maxDepth=5, seed=1),
        IndexToString(inputCol="__p", outputCol="predicted_config", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(train)


def best_below_and_above(df: DataFrame, fold: str, size: str, cut: float, config: str, value: str) -> DataFrame:
    """(fold, below, above): for each fold, the best configuration of small and of large cases outside it; of ties, the first."""
    both = None
    for side, part in (("below", F.col(size) < cut), ("above", F.col(size) >= cut)):
        best = nested(df.filter(part), fold, config, value).select(fold, F.col(config).alias(side))
        both = best if both is None else both.join(best, fold, "full")
    return both
