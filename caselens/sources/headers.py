"""Headers of volumes: what a file says of its grid, read from its first bytes. The matrix itself is made of columns."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine

#: Bytes that hold any NIfTI header; those of .mha files are texts and searched up to here first.
PREFIX = 4096

# numpy's names of the formats' element types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
MHA_TYPES = {
    "MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4",
    "MET_DOUBLE": "f8",
}
# Places of fields in the headers of NIfTI-1 and NIfTI-2.
NIFTI = {
    348: {"type": (70, "h"), "dim": (40, "8h"), "pixdim": (76, "8f"), "scale": (108, "3f"), "codes": (252, "2h"), "quatern": (256, "6f"), "srow": (280, "12f")},
    540: {"type": (12, "h"), "dim": (16, "8q"), "pixdim": (104, "8d"), "at": (168, "q"), "scale": (176, "2d"), "codes": (344, "2i"), "quatern": (352, "6d"), "srow": (400, "12d")},
}


class Header(NamedTuple):
    """codes: of qform and sform; axes: three unit vectors in LPS and the origin (.mha). Fields that a format lacks are None."""

    shape: tuple[int, int, int]
    sizes: tuple[float, float, float]
    dtype: str
    at: int
    slope: float = 1.0
    shift: float = 0.0
    compressed: bool = False
    codes: tuple[int, int] | None = None
    handed: float | None = None
    quatern: list[float] | None = None
    srow: list[float] | None = None
    axes: list[float] | None = None


def is_gzip(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b"


def inflated(raw: bytes, most: int) -> bytes:
    """The first bytes of a gzip file of which only the beginning is at hand."""
    return zlib.decompressobj(31).decompress(raw, most)


def _three(shape: list[int]) -> tuple[int, int, int]:
    while len(shape) > 3 and shape[-1] == 1:
        shape = shape[:-1]
    if len(shape) != 3 or min(shape) < 1:
        raise ValueError(f"not a 3-D volume: {shape}")
    return tuple(shape)


def nifti(raw: bytes) -> Header:
    """Of the first bytes of a NIfTI-1 or NIfTI-2 file, unpacked; axes of length 1 after the third are dropped."""
    order = "<" if struct.unpack("<i", raw[:4])[0] in NIFTI else ">"
    size = struct.unpack(f"{order}i", raw[:4])[0]
    if size not in NIFTI or len(raw) < size:
        raise ValueError("not a NIfTI header")
    field = lambda name: struct.unpack_from(order + NIFTI[size][name][1], raw, NIFTI[size][name][0])
    dim, pixdim, scale = field("dim"), field("pixdim"), field("scale")
    at, slope, shift = scale if size == 348 else (*field("at"), *scale)
    kind = NIFTI_TYPES.get(field("type")[0])
    if kind is None:
        raise ValueError(f"element type {field('type')[0]}")
    if slope == 0 or not np.isfinite([slope, shift]).all():
        slope, shift = 1.0, 0.0
    return Header(
        _three(list(dim[1 : dim[0] + 1])), tuple(float(v) for v in pixdim[1:4]), order + kind, int(at), float(slope), float(shift), False,
        tuple(field("codes")), -1.0 if pixdim[0] < 0 else 1.0, [float(v) for v in field("quatern")], [float(v) for v in field("srow")],
    )


def mha(raw: bytes) -> Header:
    """Of a single-file .mha, from bytes that hold its text."""
    head, at = {}, 0
    while "ElementDataFile" not in head:
        end = raw.index(b"\n", at)
        name, _, value = raw[at:end].decode("ascii").partition("=")
        head[name.strip()] = value.strip()
        at = end + 1
    numbers = lambda names, default: [float(x) for x in next((head[n] for n in names if n in head), default).split()]
    shape = [int(x) for x in head["DimSize"].split()]
    if len(shape) != 3 or head["ElementDataFile"] != "LOCAL":
        raise ValueError(f"not a 3-D volume in one file: {shape}")
    order = ">" if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")).lower() == "true" else "<"
    axes = numbers(("TransformMatrix", "Orientation", "Rotation"), "1 0 0 0 1 0 0 0 1") + numbers(("Offset", "Position", "Origin"), "0 0 0")
    return Header(
        _three(shape), tuple(numbers(("ElementSpacing", "ElementSize"), "1 1 1")), order + MHA_TYPES[head["ElementType"]], at,
        compressed=head.get("CompressedData", "False").lower() == "true", axes=axes,
    )


def header(path: str, raw: bytes) -> Header:
    """Of a file's first PREFIX bytes or more, by its suffix."""
    if path.endswith(".mha"):
        return mha(raw)
    return nifti(inflated(raw, PREFIX) if is_gzip(raw) else raw)


#: A row of header fields, as grid_columns() takes it.
FIELDS = "nx int, ny int, nz int, vx double, vy double, vz double, codes array<int>, handed double, quatern array<double>, srow array<double>, axes array<double>"


def fields(h: Header) -> tuple:
    return (*h.shape, *h.sizes, None if h.codes is None else list(h.codes), h.handed, h.quatern, h.srow, h.axes)


def matrix() -> Column:
    """The map from voxels to mm (to the right, front and head) of FIELDS: the sform, else the qform, else plain sizes; of .mha, its axes."""
    v = [F.col("vx"), F.col("vy"), F.col("vz")]
    q = [F.get("quatern", F.lit(i)) for i in range(6)]
    plain = F.array(*(v[i] if i == j else F.lit(0.0) for i in range(3) for j in range(4)))
    axes = affine.lps_to_ras(affine.from_axes(F.slice("axes", 1, 9), v, F.slice("axes", 10, 3)))
    form = F.when(F.get("codes", F.lit(1)) > 0, F.col("srow")).when(
        F.get("codes", F.lit(0)) > 0, affine.from_quaternion(*q[:3], v, F.col("handed"), q[3:]),
    )
    return F.when(F.col("axes").isNotNull(), axes).when(F.col("codes").isNotNull(), F.coalesce(form, plain))


def grid_columns(headers: DataFrame, *others: str) -> DataFrame:
    """(case, nx, ny, nz, vx, vy, vz, affine, others) of rows with FIELDS."""
    return headers.select("case", "nx", "ny", "nz", "vx", "vy", "vz", matrix().alias("affine"), *others)
