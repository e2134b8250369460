"""Weighted averages of members' probabilities, decisions, blends and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .relational import first_by_priority


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """Members with positive weight; negative, missing or all-zero weights are errors."""
    if not weights or any(w < 0 or w != w for w in weights.values()) or not any(weights.values()):
        raise ValueError(f"bad weights: {weights}")
    return {k: float(w) for k, w in weights.items() if w > 0}


def parse_weights(items: list[str]) -> dict[str, float]:
    """NAME=WEIGHT, each name once."""
    out: dict[str, float] = {}
    for item in items:
        name, _, value = item.partition("=")
        if not name or not value or name in out:
            raise ValueError(f"bad or repeated item: {item}")
        out[name] = float(value)
    return check_weights(out)


def weighted_average(df: DataFrame, keys: list[str], member: str, value: str, weights: dict[str, float]) -> DataFrame:
    """sum(w p) / sum(w) over the members that are there."""
    used = check_weights(weights)
    w = F.create_map(*(x for k, v in used.items() for x in (F.lit(k), F.lit(v))))[F.col(member).cast("string")]
    rows = df.withColumn("__w", w).filter("__w IS NOT NULL")
    return rows.groupBy(*keys).agg(ratio(F.sum(F.col(value) * F.col("__w")), F.sum("__w")).alias(value), F.count("*").alias("n_members"))


def decide_class(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """The class with the largest value; of ties, the smallest class."""
    return first_by_priority(df, keys, [F.col(value).desc(), F.col(label)])


def blend(left: DataFrame, right: DataFrame, on: list[str], value: str, weight: Column | float) -> DataFrame:
    """w a + (1 - w) b where both have a value, else the one that has."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    joined = left.select(*on, F.col(value).alias("__a")).join(right.select(*on, F.col(value).alias("__b")), on, "full")
    return joined.select(*on, F.coalesce(w * F.col("__a") + (1 - w) * F.col("__b"), "__a", "__b").alias(value))


def blends(rows: DataFrame, a: Column, b: Column, weights: list[float]) -> DataFrame:
    """rows once for each weight w, with p = w a + (1 - w) b, or the one of both that is there."""
    w = F.explode(F.array(*map(F.lit, weights)))
    mixed = rows.withColumns({"__a": a, "__b": b}).withColumn("w", w)
    return mixed.withColumn("p", F.coalesce(F.col("w") * F.col("__a") + (1 - F.col("w")) * F.col("__b"), "__a", "__b")).drop("__a", "__b")


def candidate_scores(scores: DataFrame, candidates: DataFrame, case: str, member: str, value: str) -> DataFrame:
    """candidates: candidate, member. Mean of the members of each candidate by case; cases that lack a member are out."""
    sizes = candidates.groupBy("candidate").agg(F.count("*").alias("__k"))
    joined = scores.join(F.broadcast(candidates.join(sizes, "candidate")), member)
    return joined.groupBy("candidate", case).agg(
        F.avg(value).alias(value), F.count("*").alias("__n"), F.max("__k").alias("__k"),
    ).filter("__n = __k").drop("__n", "__k")


def best_cells(grid: DataFrame, family: str, score: str, ties: list[str]) -> DataFrame:
    return first_by_priority(grid, [family], [F.col(score).desc_nulls_last(), *map(F.col, ties)])


def agreement(df: DataFrame, stored: str, deployed: str) -> DataFrame:
    """Mean and least of a metric's pairs, and the mean relative change in percent."""
    change = F.abs(F.col(stored) - F.col(deployed))
    return df.agg(
        F.count("*").alias("n"), F.avg(change).alias("mean_abs"), F.max(change).alias("max_abs"),
        F.avg(100 * ratio(F.col(deployed) - F.col(stored), stored)).alias("mean_change_percent"),
    )
