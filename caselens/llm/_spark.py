"""What the operators share on the Spark side: batches, samples, hot keys, partitions by key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import release, shared_dir, stash

__all__ = [
    "arrow", "by_bucket", "by_key", "components", "look_up", "most_frequent", "partitions", "release", "runs", "sampled", "shared_dir",
    "small_batches", "stash", "text_or_empty", "unused",
]

#: A key counts as hot from this share of all rows on; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 2000


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session sends texts to Python in batches of 1,000 rows and not 10,000, unless it is set otherwise.

    Documents are long: a default batch takes some 30 MB on each side.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name, "10000") == "10000":
        conf.set(name, "1000")
    return df


def sampled(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows, the same on every run, chosen by the key's hash: a filter, so no task gathers candidates."""
    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * (most / n))).limit(2 * most)


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it (case does not count in Spark)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def arrow(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def by_key(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Bring rows of a key together, sorted, for a kernel that walks whole partitions."""
    return df.repartition(n or partitions(df.sparkSession), key).sortWithinPartitions(key)


def by_bucket(df: DataFrame, n: int | None = None) -> DataFrame:
    """The same for small whole numbers in ``bucket``, which are dealt out in turn and so evenly."""
    return df.repartitionById(n or partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def runs(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole keys from batches that are sorted by key; a table ends with a key, when it has enough rows."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < at_least:
            continue
        table = pa.Table.from_batches(held)
        last = table.column(key)[n - 1]
        same = pc.equal(table.column(key), last)
        cut = pc.index(same, True).as_py()
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n -= cut
    if held:
        yield pa.Table.from_batches(held)


def look_up(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of many rows to one row of values for each key, safe for keys with a large share of all rows.

    values has the number of rows of each key in ``size``. Keys with HOT_SHARE of the total
    are at most 1 / HOT_SHARE in number: they are broadcast. No other key is large.
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(values.filter(F.col(size) > limit))
    cold = values.filter(F.col(size) <= limit)
    return rows.join(hot, key, "left_semi").join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, "left"))


def most_frequent(table: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most`` of them; rows of about equal counts are in or out together.

    The cut comes from a histogram of the counts' logarithms (some 2,000 rows
    whatever the table's size), so no task sorts or holds candidates.
    """
    level = F.floor(F.log2(n) * 32).cast("int")
    total, cut = 0, None
    for at, rows in sorted(((r[0], r[1]) for r in table.filter(F.col(n) > 0).groupBy(level).count().collect()), reverse=True):
        total += rows
        if total > most:
            break
        cut = at
    return table.limit(0) if cut is None else table.filter(level >= cut)
