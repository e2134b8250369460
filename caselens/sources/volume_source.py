"""Volumes as a data source of Spark: ``spark.read.format("caselens_volumes")``, once register() has been called.

Reading. ``what=grid`` gives one row a file from its header; of a file that is
not packed, only the first bytes are read. ``what=voxels`` gives the voxels
above ``least``; a file is cut into slabs of planes of about ``slab_bytes``
bytes, each a partition that reads its own planes; packed files are read whole.
With ``pushdown=true``, which needs spark.sql.python.filterPushdown.enabled, a
filter on ``case`` (equal to, or one of) leaves out other files before any is
opened. A file that can't be read is a row with the reason in ``error``, by each
of its slabs; ``strict=true`` makes it an error.

Writing. Rows of case and content become files {case}.nii, staged apart and moved
to their names when all tasks are done; a job that fails leaves what was there
(and perhaps the folder of a task that ended after it, whose name begins with an
underscore; reading passes over such folders).
``overwrite`` removes the folder's other volumes after that.

Paths are folders that pyarrow.fs reaches. Options: path, case (a regular
expression with one group), suffix, what, least, slab_bytes, strict, pushdown.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from . import headers

NAME = "caselens_volumes"
_GRID = f"case string, {headers.FIELDS}, path string, error string"
_VOXELS = "case string, x int, y int, z int, p double, error string"
_ARROW = pa.schema([("case", pa.string()), *((a, pa.int32()) for a in "xyz"), ("p", pa.float64()), ("error", pa.string())])


@dataclass
class Slab(InputPartition):
    """Part ``number`` of ``of`` equal parts of a file's planes."""

    path: str
    case: str
    number: int = 0
    of: int = 1


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


def _packed(path: str) -> bool:
    return path.endswith((".gz", ".mha", ".npz"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.cases = options, None
        self.voxels = options.get("what", "voxels") == "voxels"

    def partitions(self) -> list[Slab]:
        store, folder = fs.FileSystem.from_uri(self.options["path"])
        pattern, suffix = re.compile(self.options.get("case", r"([^/.]+)\.[^/]*$")), tuple(self.options.get("suffix", ".nii,.nii.gz").split(","))
        out = []
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
            found = pattern.search(info.path)
            hidden = any(part[:1] in "_." for part in info.path[len(folder) :].strip("/").split("/"))
            if hidden or info.type != fs.FileType.File or not info.path.endswith(suffix) or not found or self.cases is not None and found[1] not in self.cases:
                continue
            n = 1 if not self.voxels or _packed(info.path) else max(1, -(-info.size // int(self.options.get("slab_bytes", 1 << 24))))
            out += [Slab(info.path, found[1], k, n) for k in range(n)]
        return out

    def read(self, part: Slab) -> Iterator:
        if part is None:  # no files
            return
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        try:
            with store.open_input_file(part.path) as file:
                yield from self._voxels(file, part) if self.voxels else self._grid(file, part)
        except Exception as e:  # whatever a broken file leads to
            if self.options.get("strict", "false") == "true":
                raise ValueError(f"{part.path}: {e}") from e
            reason = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([{"case": part.case, "error": reason}], _ARROW) if self.voxels else (part.case, *[None] * 11, part.path, reason)

    def _grid(self, file, part: Slab) -> Iterator[tuple]:
        yield (part.case, *headers.fields(headers.header(part.path, file.read(headers.PREFIX))), part.path, None)

    def _voxels(self, file, part: Slab) -> Iterator[pa.RecordBatch]:
        begin = file.read(headers.PREFIX)
        h = headers.header(part.path, begin)
        nx, ny, nz = h.shape
        low, high = nz * part.number // part.of, nz * (part.number + 1) // part.of
        kind = np.dtype(h.dtype)
        if _packed(part.path) or headers.is_gzip(begin):
            raw = begin + file.read()
            raw = gzip.decompress(raw) if headers.is_gzip(raw) else raw
            body = (zlib.decompress(raw[h.at :]) if h.compressed else raw[h.at :])[low * nx * ny * kind.itemsize :]
        else:
            file.seek(h.at + low * nx * ny * kind.itemsize)
            body = file.read((high - low) * nx * ny * kind.itemsize)
        data = np.frombuffer(body, kind, nx * ny * (high - low)).reshape((nx, ny, high - low), order="F")
        data = data * h.slope + h.shift if (h.slope, h.shift) != (1.0, 0.0) else data
        x, y, z = np.nonzero(data > float(self.options.get("least", 0)))
        columns = [pa.array([part.case] * len(x), pa.string()), *(pa.array(a.astype(np.int32)) for a in (x, y, z + low)), pa.array(data[x, y, z].astype(np.float64)), pa.nulls(len(x), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class _FilteredReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("case",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.cases = wanted if self.cases is None else self.cases & wanted
            yield f  # Spark filters the rows as well


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.stage = options["path"], overwrite, f"_staged-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Staged:
        store, folder = self._place()
        store.create_dir(f"{folder}/{self.stage}", recursive=True)
        names = []
        for row in iterator:
            if row["case"] is None or row["content"] is None:
                raise ValueError(f"no case or no content: {row['case']}")
            names.append(f"{row['case']}.nii")
            with store.open_output_stream(f"{folder}/{self.stage}/{names[-1]}") as out:
                out.write(bytes(row["content"]))
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, folder = self._place()
        names = [n for m in messages if m is not None for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a case comes twice")
        for name in names:
            store.move(f"{folder}/{self.stage}/{name}", f"{folder}/{name}")
        self.abort(messages)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.path.endswith(".nii") and info.base_name not in set(names):
                    store.delete_file(info.path)

    def abort(self, messages: list[Staged | None]) -> None:
        store, folder = self._place()
        if store.get_file_info(f"{folder}/{self.stage}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.stage}")


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _VOXELS if self.options.get("what", "voxels") == "voxels" else _GRID

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteredReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeSource)


def _load(spark: SparkSession, path: str, what: str, options: dict) -> DataFrame:
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(path=path, what=what, pushdown=pushdown, **options).load()


def grids(spark: SparkSession, path: str, **options) -> DataFrame:
    """(case, nx, ny, nz, vx, vy, vz, affine, path, error) of the folder's volumes, from their headers."""
    return headers.grid_columns(_load(spark, path, "grid", options), "path", "error")


def voxels(spark: SparkSession, path: str, **options) -> DataFrame:
    """(case, x, y, z, p, error) of the folder's volumes."""
    return _load(spark, path, "voxels", options)


def write(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """files: case, content, as of sinks.encoded()."""
    register(files.sparkSession)
    files.select("case", "content").write.format(NAME).mode(mode).option("path", path).save()
