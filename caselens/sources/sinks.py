"""Sinks: CSV with fixed columns, strict JSON, staged tables that are verified before they take a name."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite, short_threshold
from ..operators.relational import certificate
from .readers import encode_nifti


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL, so that JSON and CSV hold numbers only."""
    return df.withColumns({n: finite(n) for n, t in df.dtypes if t in ("double", "float")})


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """The named columns only, sorted; an existing result is replaced when the new one is whole."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_sweep(df: DataFrame, path: str, columns: Sequence[str], threshold: str = "threshold") -> None:
    """Sweep rows in order, thresholds without trailing zeros."""
    df.select(*columns).orderBy(threshold).withColumn(threshold, short_threshold(threshold)).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Strict JSON lines with explicit nulls."""
    out = finite_columns(df)
    (out.orderBy(*order) if order else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def document(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """One JSON document that lists a small table's rows in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order))))
    return finite_columns(df).agg(F.to_json(F.struct(rows.alias(name)), {"ignoreNullFields": "false"}).alias("document"))


def write_new(df: DataFrame, path: str) -> None:
    """Fails if the path exists."""
    df.write.mode("errorifexists").parquet(path)


def _store(spark: SparkSession, *paths: str):
    """(file system, Hadoop paths)."""
    places = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return places[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *places


def write_outside(df: DataFrame, path: str, scanned: str) -> None:
    """write_new(), refused within the tree that was scanned."""
    store, inner, outer = _store(df.sparkSession, path, scanned)
    inner, outer = str(store.makeQualified(inner)), str(store.makeQualified(outer)).rstrip("/")
    if inner == outer or inner.startswith(f"{outer}/"):
        raise ValueError(f"{path} lies within {scanned}")
    write_new(df, path)


def promote(df: DataFrame, path: str, violations: Callable[[DataFrame], DataFrame]) -> None:
    """Write beside the path, verify what was written, and only then give it the name.

    A lock keeps a second writer out. The old table is moved aside, and comes
    back if the new one can't take its name; it is deleted last. The renamed
    table must have the rows that were verified.
    """
    spark, staged = df.sparkSession, f"{path}.staged"
    store, old, new, aside, lock = _store(spark, path, staged, f"{path}.old", f"{path}.lock")
    if not store.createNewFile(lock):
        raise RuntimeError(f"{path} is being written, or a writer left {path}.lock behind")
    try:
        df.write.mode("overwrite").parquet(staged)
        written = spark.read.parquet(staged)
        if faults := violations(written).limit(5).collect():
            store.delete(new, True)
            raise ValueError(f"not promoted: {faults}")
        wanted = _content(written)
        if not store.exists(old) and store.exists(aside):
            store.rename(aside, old)  # a writer ended between its two renames
        store.delete(aside, True)
        had = store.exists(old)
        if had and not store.rename(old, aside):
            raise OSError(f"{path}: not moved aside")
        if not store.rename(new, old) or _content(spark.read.parquet(path)) != wanted:
            store.delete(old, True)
            if had:
                store.rename(aside, old)
            raise OSError(f"{staged}: not renamed")
        store.delete(aside, True)
    finally:
        store.delete(lock, False)


def _content(df: DataFrame) -> tuple:
    return tuple(certificate(df, [], df.columns).first() or ())


def append_shard(df: DataFrame, path: str, shard: int) -> None:
    """One shard of a table of shards, under its number; written again, it replaces itself. Read the folder for all of them."""
    df.write.mode("overwrite").csv(f"{path}/shard={shard}", header=True)


def write_leaderboard(df: DataFrame, path: str, incomplete: list[str] = ()) -> None:
    """A small table as one CSV file, its cells quoted where needed, below a line that names what is missing from it."""
    cell = lambda c: F.when(F.col(c).isNull(), "").otherwise(
        F.when(
            F.col(c).cast("string").rlike('[",\\r\\n]'),
            F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')),
        ).otherwise(F.col(c).cast("string"))
    )
    lines = [r[0] for r in df.select(F.concat_ws(",", *map(cell, df.columns))).toLocalIterator()]
    banner = [f"# INCOMPLETE: {', '.join(incomplete)}"] if incomplete else []
    write_text(df.sparkSession, path, "\r\n".join([*banner, ",".join(df.columns), *lines, ""]))


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """One pretty JSON document of small tables, each a list of rows; numbers that are not finite are null."""
    spark = next(iter(report.values())).sparkSession
    body = {
        name: [json.loads(r[0]) for r in finite_columns(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
        for name, df in report.items()
    }
    write_text(spark, path, json.dumps(body, indent=2, sort_keys=True))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text under a name, whole or not at all."""
    store, place, staged = _store(spark, path, f"{path}.staged")
    out = store.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(place, False)
    if not store.rename(staged, place):
        raise OSError(f"{path}: not renamed")


def write_files(files: DataFrame, root: str) -> None:
    """files: path (below the root) and content (binary). Each becomes a file, written by the task that has its row."""
    from pyarrow import fs

    def put(batches):
        store, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                store.create_dir(f"{folder}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{folder}/{path}") as out:
                    out.write(content)
            yield batch.select(["path"])

    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()


def encoded(voxels: DataFrame, grid: DataFrame, value: str | None = None) -> DataFrame:
    """(case, content): a NIfTI volume for each case of grid (nx, ny, nz, vx, vy, vz, and affine if there is one), 1 or the value at its voxels.

    A case is one volume, so a task holds one at a time. Voxels beyond the grid are an error.
    """
    own = voxels.select("case", "x", "y", "z", (F.col(value) if value else F.lit(1.0)).cast("double").alias("p"))
    matrix = F.col("affine") if "affine" in grid.columns else F.lit(None).cast("array<double>")

    def one(key, points: pd.DataFrame, grids: pd.DataFrame) -> pd.DataFrame:
        if grids.empty:
            raise ValueError(f"{key[0]}: no grid")
        g = grids.iloc[0]
        shape = (int(g.nx), int(g.ny), int(g.nz))
        data = np.zeros(shape, "f4" if value else "u1")
        at = tuple(points[a].to_numpy() for a in "xyz")
        if any(len(c) and (c.min() < 0 or c.max() >= n) for c, n in zip(at, shape)):
            raise ValueError(f"{key[0]}: voxels beyond the grid")
        data[at] = points["p"].to_numpy()
        return pd.DataFrame({"case": [key[0]], "content": [encode_nifti(data, (g.vx, g.vy, g.vz), g.affine)]})

    sides = own.groupBy("case"), grid.select("case", "nx", "ny", "nz", "vx", "vy", "vz", matrix.alias("affine")).groupBy("case")
    return sides[0].cogroup(sides[1]).applyInPandas(one, "case string, content binary")


def write_volumes(voxels: DataFrame, grid: DataFrame, path: str, value: str | None = None) -> None:
    """A file {case}.nii for each case; files of cases that are not among them go."""
    from pyarrow import fs

    def put(batches):
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for case, content in zip(batch.column("case").to_pylist(), batch.column("content").to_pylist()):
                with store.open_output_stream(f"{folder}/{case}.nii") as out:
                    out.write(content)
            yield batch.select(["case"])

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    kept = {f"{r[0]}.nii" for r in encoded(voxels, grid, value).mapInArrow(put, "case string").toLocalIterator()}
    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.base_name.endswith(".nii") and info.base_name not in kept:
            store.delete_file(info.path)


def write_by_case(df: DataFrame, path: str, case: str = "case") -> None:
    """A folder for each case; cases that are written again replace their old ones, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(case).parquet(path)
