"""Sources: listings, tables with explicit schemas, documents, logs, parameter grids, and volumes as voxel rows."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import duplicates, require_empty
from . import headers


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option(
        "recursiveFileLookup", "true",
    ).option("pathGlobFilter", glob).load(root).select("path", "length")


def subjects(files: DataFrame, roles: dict[str, str], subject: str = r"/(sub-[^/]+)/") -> DataFrame:
    """One row a subject with the first path of each role. roles: name -> regular expression."""
    found = files.withColumn("subject", F.regexp_extract("path", subject, 1)).filter("subject <> ''")
    return found.groupBy("subject").agg(*(F.min(F.when(F.col("path").rlike(p), F.col("path"))).alias(name) for name, p in roles.items()))


def sessions(files: DataFrame, roles: dict[str, str], site: str = r"/(R\d+[^/]*)/") -> DataFrame:
    """The same by site, subject and session."""
    keys = {"site": site, "subject": r"/(sub-[^/]+)/", "session": r"/(ses-[^/]+)/"}
    found = files.select(
        "path", *(F.regexp_extract("path", p, 1).alias(k) for k, p in keys.items()),
    ).filter("site <> '' AND subject <> '' AND session <> ''")
    return found.groupBy(*keys).agg(*(F.min(F.when(F.col("path").rlike(p), F.col("path"))).alias(name) for name, p in roles.items()))


def unique_paths(files: DataFrame, key: Column) -> DataFrame:
    """(id, path); fails if an id has two paths."""
    named = files.withColumn("id", key)
    require_empty(duplicates(named, ["id"]), "ids with several files")
    return named.select("id", "path")


def resolve(files: DataFrame, subject: Column, candidates: list[str]) -> DataFrame:
    """One file a subject: by the order of the candidate names, else the first by path."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, candidates)), name), F.lit(0)), F.lit(len(candidates) + 1))
    order = Window.partitionBy("subject").orderBy(rank, "path")
    return files.withColumn("subject", subject).withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("subject", "path")


def collection(files: DataFrame, classes: list[tuple[str, str]]) -> DataFrame:
    """(path, id, kind) by the first suffix that fits; other names and repeated ids of a kind are errors."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = ids = F.lit(None).cast("string")
    for k, suffix in reversed(classes):
        kind = F.when(name.endswith(suffix), k).otherwise(kind)
        ids = F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(ids)
    out = files.select("path", ids.alias("id"), kind.alias("kind"))
    require_empty(out.filter("kind IS NULL").select("path"), "unexpected files")
    require_empty(duplicates(out, ["kind", "id"]), "repeated files")
    return out


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Typed rows; anything that does not fit the schema fails."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def csv_faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, fault): repeated names in the header, and lines with too many or too few cells. Cells hold no line breaks."""
    lines = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", "text"),
    )
    cells = F.size(F.split(F.regexp_replace("text", r'"[^"]*"', "q"), ","))
    counted = lines.withColumn("cells", cells)
    head = counted.filter("line = 0").select("path", F.col("cells").alias("wanted"), F.split("text", ",").alias("names"))
    repeated = head.filter(F.size(F.array_distinct("names")) < F.size("names")).select(
        "path", F.lit(0).alias("line"), F.lit("repeated name").alias("fault"),
    )
    uneven = counted.filter("line > 0").join(F.broadcast(head), "path").filter("cells <> wanted").select(
        "path", "line", F.when(F.col("cells") > F.col("wanted"), "too many cells").otherwise("too few cells").alias("fault"),
    )
    return repeated.unionByName(uneven)


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = False) -> DataFrame:
    """A row a document; tolerant: broken documents are rows of NULLs."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE" if tolerant else "FAILFAST", allowNonNumericNumbers=True)


def json_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """An append-only log; torn lines are left out."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def shards(spark: SparkSession, path: str, row_schema: str, shard_count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of shard files {shard_count, rows: [...], errors: {...}}; all must agree on the number of shards."""
    schema = f"shard_index int, shard_count int, rows array<struct<{row_schema}>>, errors map<string,string>"
    files = json_documents(spark, path, schema)
    counts = [r[0] for r in files.select("shard_count").distinct().limit(3).collect()]
    if len(counts) > 1 or shard_count is not None and counts and counts != [shard_count]:
        raise ValueError(f"shards of different runs: {counts}")
    return files.select(F.explode("rows").alias("r")).select("r.*"), files.select(F.explode("errors").alias("id", "error"))


def case_list(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Distinct ids of a list file: trimmed, without blanks, comments and a suffix."""
    text = F.trim("value")
    return spark.read.text(path).select(text.alias("id")).filter("id <> '' AND NOT startswith(id, '#')").select(
        F.regexp_replace("id", f"{suffix}$", "").alias("id") if suffix else F.col("id")
    ).distinct()


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits from a log of NUL-separated sha, date and subject; a broken log fails."""
    parts = F.split(F.regexp_replace("value", r"\x00?\n?$", ""), r"\x00\n?")
    table = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("repo"), parts.alias("p"))
    whole = table.withColumn(
        "p", F.when(F.size("p") % 3 == 0, F.col("p")).otherwise(F.raise_error(F.lit("broken log")).cast("array<string>")),
    )
    return whole.select("repo", F.explode(F.sequence(F.lit(0), F.expr("size(p) div 3 - 1").cast("int"))).alias("i"), "p").select(
        "repo", F.col("p")[F.col("i") * 3].alias("sha"), F.to_timestamp(F.col("p")[F.col("i") * 3 + 1]).alias("ts"),
        F.col("p")[F.col("i") * 3 + 2].alias("subject"),
    )


def name_status(spark: SparkSession, path: str) -> DataFrame:
    """(repo, status, path) from NUL-separated pairs, without deletions."""
    parts = F.split(F.regexp_replace("value", r"\x00?\n?$", ""), r"\x00")
    table = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("repo"), parts.alias("p"))
    rows = table.select("repo", F.explode(F.sequence(F.lit(0), F.expr("size(p) div 2 - 1").cast("int"))).alias("i"), "p").select(
        "repo", F.col("p")[(F.col("i") * 2).cast("int")].alias("status"), F.col("p")[(F.col("i") * 2 + 1).cast("int")].alias("path"),
    )
    return rows.filter(~F.col("status").startswith("D"))


def case_metadata(df: DataFrame, text: str) -> DataFrame:
    """CENTER, CHRONICITY and DAYS_POST_STROKE of JSON texts; NULLs for broken ones."""
    return df.withColumn(
        "__m", F.from_json(text, "CENTER string, CHRONICITY double, DAYS_POST_STROKE double", {"mode": "PERMISSIVE"}),
    ).select("*", "__m.*").drop("__m")


def summary_rows(spark: SparkSession, path: str, label: str = "1") -> DataFrame:
    """A flat row for each case of nested summaries {metric_per_case: [{prediction_file, metrics: {label: {...}}}]}."""
    schema = "metric_per_case array<struct<prediction_file string, metrics map<string, struct<Dice double, IoU double, TP double, FP double, FN double, TN double>>>>"
    cases = json_documents(spark, path, schema).select(F.explode("metric_per_case").alias("c"))
    return cases.select(F.col("c.prediction_file").alias("path"), F.col("c.metrics")[label].alias("m")).filter("m IS NOT NULL").select(
        "path", *(F.nanvl(f"m.{k}", F.lit(None).cast("double")).alias(k.lower()) for k in ("Dice", "IoU", "TP", "FP", "FN", "TN")),
    )


def split_document(spark: SparkSession, path: str) -> DataFrame:
    """(fold, subset, case) of a list of {train, val}; a case in two folds' val is an error."""
    folds = F.from_json("value", "array<struct<train array<string>, val array<string>>>")
    rows = spark.read.text(path, wholetext=True).select(
        F.posexplode(
            F.coalesce(folds, F.from_json("value", "folds array<struct<train array<string>, val array<string>>>")["folds"])
        ).alias("fold", "f")
    )
    out = rows.select("fold", F.lit("train").alias("subset"), F.explode("f.train").alias("case")).unionByName(
        rows.select("fold", F.lit("val").alias("subset"), F.explode("f.val").alias("case"))
    )
    require_empty(duplicates(out.filter("subset = 'val'"), ["case"]), "cases that several folds validate on")
    return out


def grid(spark: SparkSession, text: str, name: str = "threshold", decimals: int = 6) -> DataFrame:
    """A parameter grid: "a,b,c", or "start:stop:step" with the stop included. Steps are whole numbers of 10^-decimals, so nothing drifts."""
    unit = 10**decimals
    if ":" in text:
        start, stop, step = (round(float(x) * unit) for x in text.split(":"))
        if step <= 0 or stop < start:
            raise ValueError(f"bad grid: {text}")
        return spark.range(start, stop + 1, step).select((F.col("id") / float(unit)).alias(name))
    values = sorted({round(float(x), decimals) for x in text.split(",") if x.strip()})
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def by_source_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first table that has the key."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table.join(out.select(key), key, "left_anti"), allowMissingColumns=True)
    return out


# --- volumes ----------------------------------------------------------------------------------


def decode_nifti(raw: bytes) -> tuple[np.ndarray, list[float]]:
    """(array, voxel sizes) of a .nii or .nii.gz file; a fourth axis of length 1 is dropped."""
    raw = gzip.decompress(raw) if headers.is_gzip(raw) else raw
    h = headers.nifti(raw)
    data = np.frombuffer(raw, np.dtype(h.dtype), int(np.prod(h.shape)), h.at).reshape(h.shape, order="F")
    return (data * h.slope + h.shift if (h.slope, h.shift) != (1.0, 0.0) else data), list(h.sizes)


def encode_nifti(array: np.ndarray, sizes: tuple[float, float, float], matrix: list[float] | None = None) -> bytes:
    """A minimal single-file NIfTI-1 of float32 or uint8; matrix: a flat 3 x 4 one from voxels to mm."""
    code = {"u1": 2, "f4": 16}[array.dtype.str[1:]]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *array.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, array.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *sizes, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    if matrix is not None:
        struct.pack_into("<2h", head, 252, 0, 1)
        struct.pack_into("<12f", head, 280, *matrix)
    head[344:348] = b"n+1\0"
    return bytes(head) + array.tobytes(order="F")


def decode_mha(raw: bytes) -> tuple[np.ndarray, list[float]]:
    """(array in x, y, z, voxel sizes) of a single-file .mha volume, compressed or not; anything but three axes is refused."""
    h = headers.mha(raw)
    body = zlib.decompress(raw[h.at :]) if h.compressed else raw[h.at :]
    return np.frombuffer(body, np.dtype(h.dtype), int(np.prod(h.shape))).reshape(h.shape, order="F"), list(h.sizes)


def decode_softmax(raw: bytes, channel: int = 1) -> tuple[np.ndarray, list[float]]:
    """(one class of an .npz archive of probabilities (class, z, y, x), as x, y, z; voxel sizes of 1)."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as archive:
        p = archive["probabilities"]
    if p.ndim != 4 or p.shape[0] < 2 or not 0 <= channel < p.shape[0]:
        raise ValueError(f"not a map of several classes: {p.shape}")
    return np.ascontiguousarray(p[channel].T), [1.0, 1.0, 1.0]


_DECODERS = {".mha": decode_mha, ".npz": decode_softmax}


def decode(name: str, raw: bytes) -> tuple[np.ndarray, list[float]]:
    """A volume by its file's suffix; NIfTI by default."""
    return next((f for suffix, f in _DECODERS.items() if name.endswith(suffix)), decode_nifti)(raw)


def _checked(name: str, raw: bytes, low: float | None, high: float | None) -> tuple[np.ndarray, list[float]]:
    data, sizes = decode(name, raw)
    if data.dtype.kind == "f" and not np.isfinite(data).all():
        raise ValueError("values that are not finite")
    if low is not None and data.size and (data.min() < low or data.max() > high):
        raise ValueError(f"values beyond {low} to {high}")
    return data, sizes


_VOXELS = "case string, x int, y int, z int, p double, error string"


def decoded(files: DataFrame, least: float = 0.0, strict: bool = True, low: float | None = None, high: float | None = None) -> DataFrame:
    """files: case, path, content. (case, x, y, z, p, error) of all voxels above ``least``.

    A volume that can't be read, has values that are not finite or, with low and
    high, lie beyond them, is one row with the reason in ``error``, and the others
    go on; strict: it fails instead.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for case, path, content in zip(batch["case"], batch["path"], batch["content"]):
                try:
                    data, _ = _checked(path, content, low, high)
                except Exception as e:  # whatever a broken file leads to
                    if strict:
                        raise ValueError(f"{case}: {e}") from e
                    yield pd.DataFrame(
                        {"case": [case], "x": [None], "y": [None], "z": [None], "p": [None], "error": [f"{type(e).__name__}: {e}"]}
                    )
                    continue
                at = np.nonzero(data > least)
                yield pd.DataFrame({"case": case, **{a: c.astype("int32") for a, c in zip("xyz", at)}, "p": data[at].astype("float64"), "error": None})

    return files.select("case", "path", "content").mapInPandas(rows, _VOXELS)


def _files(spark: SparkSession, root: str, case: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.regexp_extract("path", case, 1).alias("case"), "path", "content")


def voxels(spark: SparkSession, root: str, case: str, least: float = 0.0, glob: str = "*.nii*") -> DataFrame:
    """(case, x, y, z, p) of all voxels above ``least``; a file that can't be read is an error. case: regular expression on the path."""
    return decoded(_files(spark, root, case, glob), least).drop("error")


def voxels_or_errors(
    spark: SparkSession, root: str, case: str, least: float = 0.0, glob: str = "*.nii*", low: float | None = None, high: float | None = None,
) -> DataFrame:
    """The same with ``error``: a file that can't be read is one row with the reason."""
    return decoded(_files(spark, root, case, glob), least, False, low, high)


def grids_or_errors(spark: SparkSession, root: str, case: str, glob: str = "*.nii*") -> DataFrame:
    """(case, nx, ny, nz, vx, vy, vz, affine, error) of volumes; a file whose header can't be read is one row with the reason.

    affine: a flat 3 x 4 matrix, NULL for .npz archives. Voxels are not decoded, but for .npz.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, path, content in zip(batch["case"], batch["path"], batch["content"]):
                try:
                    if path.endswith(".npz"):
                        data, sizes = decode_softmax(content)
                        found.append((name, *data.shape, *sizes, None, None, None, None, None, None))
                    else:
                        found.append((name, *headers.fields(headers.header(path, content)), None))
                except Exception as e:  # whatever a broken file leads to
                    found.append((name, *[None] * 11, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(found, columns=[f.split()[0] for f in schema.split(", ")])

    schema = f"case string, {headers.FIELDS}, error string"
    return headers.grid_columns(_files(spark, root, case, glob).mapInPandas(rows, schema), "error")


def grids(spark: SparkSession, root: str, case: str, glob: str = "*.nii*") -> DataFrame:
    """The same without ``error``: a file that can't be read is an error."""
    found = grids_or_errors(spark, root, case, glob)
    message = F.concat(F.col("case"), F.lit(": "), F.col("error"))
    case_or_error = F.when(F.col("error").isNull(), F.col("case")).otherwise(F.raise_error(message).cast("string"))
    return found.withColumn("case", case_or_error).drop("error")


def select_folds(df: DataFrame, text: str, fold: str = "fold", n_folds: int = 5) -> DataFrame:
    """Rows of the folds of "all" or "0,2,..."; a number beyond the folds, or none, is an error."""
    if text.strip() == "all":
        return df
    folds = [int(x) for x in text.split(",") if x.strip()]
    if not folds or any(not 0 <= k < n_folds for k in folds):
        raise ValueError(f"bad folds: {text}")
    return df.filter(F.col(fold).isin(folds))
