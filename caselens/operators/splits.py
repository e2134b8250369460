"""Fold assignment of indivisible groups, balanced over several counts, and split plans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that the search holds; each is one row of counts.
MOST_GROUPS = 20_000
#: Folds of a plan that is written out in full: every case is a row in each of them.
MOST_FOLDS = 10_000


def group_profiles(cases: DataFrame, group: str, strata: dict[str, Sequence[str]], volume: str | None = None) -> DataFrame:
    """A row of counts for each group: cases, each value of each stratum, and volume terms."""
    columns = [F.count("*").cast("double").alias("case_count")]
    columns += [F.count_if(F.col(s) == v).cast("double").alias(f"{s}={v}") for s, values in strata.items() for v in values]
    if volume:
        columns += [
            F.count(volume).cast("double").alias("volume_known"), F.coalesce(F.sum(volume), F.lit(0.0)).alias("volume_sum"),
            F.coalesce(F.sum(F.log1p(volume)), F.lit(0.0)).alias("volume_log1p"),
        ]
    return cases.groupBy(group).agg(*columns)


def imbalance(loads: np.ndarray, weights: np.ndarray) -> float:
    """Weighted mean squared deviation of fold loads (folds, features) from their mean, each relative to it."""
    target = loads.mean(axis=0)
    used = target > 1e-12
    return float((weights[used] * (((loads[:, used] - target[used]) / np.maximum(target[used], 1.0)) ** 2).mean(axis=0)).sum())


def _attempt(profiles: np.ndarray, weights: np.ndarray, folds: int, seed: int) -> tuple[float, np.ndarray]:
    """Greedy from the largest group down, then moves and swaps while they help."""
    rng = np.random.default_rng(seed)
    order = np.argsort(-profiles[:, 0] * rng.uniform(0.9, 1.1, len(profiles)), kind="stable")
    target = profiles.sum(axis=0) / folds
    scale = np.where(target > 1e-12, weights / np.maximum(target, 1.0) ** 2, 0.0)
    cost = lambda loads: (((loads - target) ** 2) * scale).sum(axis=-1)
    loads, at = np.zeros((folds, profiles.shape[1])), np.zeros(len(profiles), int)
    for g in order:
        gain = cost(loads + profiles[g]) - cost(loads)
        at[g] = int(np.argmin(gain))
        loads[at[g]] += profiles[g]
    for _ in range(20):
        better = False
        for g in order:
            a = at[g]
            gain = cost(loads + profiles[g]) - cost(loads) + cost(loads[a] - profiles[g]) - cost(loads[a])
            gain[a] = 0
            b = int(np.argmin(gain))
            if gain[b] < -1e-12:
                loads[a] -= profiles[g]
                loads[b] += profiles[g]
                at[g], better = b, True
                continue
            d = profiles - profiles[g]  # swap g with any group of another fold
            swap = cost(loads[a] + d) - cost(loads[a]) + cost(loads[at] - d) - cost(loads[at])
            swap[at == a] = 0
            h = int(np.argmin(swap))
            if swap[h] < -1e-12:
                loads[a] += d[h]
                loads[at[h]] -= d[h]
                at[g], at[h], better = at[h], a, True
        if not better:
            break
    return imbalance(loads, weights), at


def assign_folds(
    profiles: DataFrame, group: str, folds: int = 5, weights: dict[str, float] | None = None, restarts: int = 64, seed: int = 42,
) -> DataFrame:
    """(group, fold): whole groups dealt so that all counts are even; restarts of the search run as Spark tasks.

    Deterministic: ties between restarts go to the smaller seed, and fold 0 holds the first group.
    """
    spark = profiles.sparkSession
    rows = profiles.orderBy(group).limit(MOST_GROUPS + 1).toPandas()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    names = [c for c in rows.columns if c != group]
    table = rows[names].to_numpy(float)
    own = np.array([(weights or {}).get(n.split("=")[0], 1.0) for n in names])

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(s, *_attempt(table, own, folds, int(s))) for s in batch["id"]]
            yield pd.DataFrame({"seed": [s for s, _, _ in found], "cost": [round(c, 12) for _, c, _ in found], "at": [a.tolist() for _, _, a in found]})

    tries = spark.range(seed, seed + restarts, 1, min(restarts, 32)).mapInPandas(attempt, "seed bigint, cost double, at array<bigint>")
    best = tries.orderBy("cost", "seed").first()
    first: dict[int, int] = {}
    numbers = [first.setdefault(k, len(first)) for k in (best["at"] if best else [])]
    return spark.createDataFrame(
        [(g, n) for g, n in zip(rows[group].tolist(), numbers)], f"{group} {dict(profiles.dtypes)[group]}, fold int",
    )


def _every(folds: DataFrame, fold: str) -> DataFrame:
    """One row: the sorted list of all folds, or an error if a plan of so many rows for each case can't be meant."""
    every = folds.agg(F.array_sort(F.collect_set(fold)).alias("__every"))
    return every.select(
        F.when(F.size("__every") > MOST_FOLDS, F.raise_error(F.lit(f"more than {MOST_FOLDS} folds: read them by side()")).cast(every.schema[0].dataType))
        .otherwise(F.col("__every")).alias("__every")
    )


def splits(cases: DataFrame, assignment: DataFrame, case: str, group: str) -> DataFrame:
    """(fold, subset, case): every fold validates on its own groups and trains on all others."""
    placed = cases.select(case, group).join(assignment.withColumnRenamed("fold", "own"), group)
    rows = placed.crossJoin(F.broadcast(_every(assignment, "fold")))  # one row
    rows = rows.select("own", case, F.explode("__every").alias("fold"))
    return rows.select("fold", F.when(F.col("own") == F.col("fold"), "val").otherwise("train").alias("subset"), case)


def held_groups(cases: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(held, n): the groups of at least ``least`` cases, each of which is a fold of its own."""
    return cases.groupBy(F.col(group).alias("held")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def leave_group_out(cases: DataFrame, case: str, group: str, least: int = 1) -> DataFrame:
    """(held, subset, case) in full: one fold for each group of at least ``least`` cases, which validates on it."""
    rows = cases.select(case, group).crossJoin(F.broadcast(_every(held_groups(cases, group, least), "held")))  # one row
    rows = rows.select(group, case, F.explode("__every").alias("held"))
    return rows.select("held", F.when(F.col(group) == F.col("held"), "val").otherwise("train").alias("subset"), case)


def side(cases: DataFrame, group: str, held, subset: str) -> DataFrame:
    """The rows of one fold's side, straight from the cases: a filter, for plans with too many folds to write out."""
    if subset not in ("train", "val"):
        raise ValueError(f"unknown subset: {subset}")
    own = F.col(group).eqNullSafe(F.lit(held))
    return cases.filter(own if subset == "val" else ~own)


def plan_sizes(cases: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(held, subset, n) of leave_group_out(), from the groups' own counts: no row of the plan is made. Sides without cases are left out."""
    total = cases.agg(F.count("*").alias("__all"))  # one row
    both = held_groups(cases, group, least).filter("held IS NOT NULL").crossJoin(F.broadcast(total))
    sides = F.array(
        F.struct(F.lit("val").alias("subset"), F.col("n")), F.struct(F.lit("train").alias("subset"), (F.col("__all") - F.col("n")).alias("n")),
    )
    return both.select("held", F.explode(sides).alias("__s")).select("held", "__s.*").filter("n > 0")


def fold_summary(assigned: DataFrame, fold: str, measures: dict[str, Column]) -> DataFrame:
    """Loads of each fold and their deviation from the mean over folds."""
    loads = assigned.groupBy(fold).agg(*(m.cast("double").alias(n) for n, m in measures.items()))
    means = loads.agg(*(F.avg(n).alias(f"__{n}") for n in measures))
    return loads.crossJoin(means).select(
        fold, *measures, *((F.col(n) - F.col(f"__{n}")).alias(f"{n}_deviation") for n in measures),
    )  # one row of means


def objective(loads: DataFrame, fold: str, weights: dict[str, float]) -> DataFrame:
    """imbalance() as aggregates over (fold, feature): one row, ``objective``."""
    long = loads.unpivot([fold], list(weights), "feature", "load")
    target = long.groupBy("feature").agg(F.avg("load").alias("target")).filter("target > 1e-12")
    square = ((F.col("load") - F.col("target")) / F.greatest("target", F.lit(1.0))) ** 2
    weight = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("feature")]
    each = long.join(F.broadcast(target), "feature").groupBy("feature").agg(F.avg(square).alias("mse"))
    return each.agg(F.sum(weight * F.col("mse")).alias("objective"))
