"""Matrices of grids from headers, their algebra, and resampling between two grids."""

import gzip
import math
import struct
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.functions import affine as A
from caselens.operators import volumes as V
from caselens.sources import readers as R

HALF_TURN = [0.0, 0.0, 1.0, 10.0, -20.0, 30.0]  # about z: x and y change their signs


def nifti1(shape=(2, 3, 4), quatern=None, handed=1.0, slope=0.0, srow=None, order="<"):
    head = bytearray(352)
    struct.pack_into(f"{order}i", head, 0, 348)
    struct.pack_into(f"{order}8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into(f"{order}2h", head, 70, 2, 8)
    struct.pack_into(f"{order}8f", head, 76, handed, 1.0, 2.0, 3.0, 0, 0, 0, 0)
    struct.pack_into(f"{order}3f", head, 108, 352.0, slope, 0.0)
    struct.pack_into(f"{order}2h", head, 252, int(quatern is not None), int(srow is not None))
    struct.pack_into(f"{order}6f", head, 256, *(quatern or [0.0] * 6))
    struct.pack_into(f"{order}12f", head, 280, *(srow or [0.0] * 12))
    return bytes(head) + bytes(int(np.prod(shape)))


def nifti2(shape, srow):
    head = bytearray(544)
    struct.pack_into("<i", head, 0, 540)
    struct.pack_into("<2h", head, 12, 4, 16)
    struct.pack_into("<8q", head, 16, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<8d", head, 104, 1.0, 1.5, 1.5, 2.0, 0, 0, 0, 0)
    struct.pack_into("<q2d", head, 168, 544, 2.0, 1.0)
    struct.pack_into("<2i", head, 344, 0, 1)
    struct.pack_into("<12d", head, 400, *srow)
    return bytes(head) + np.arange(np.prod(shape), dtype="<i2").tobytes()


def mha(direction, origin):
    lines = ["ObjectType = Image", "NDims = 3", f"TransformMatrix = {direction}", f"Offset = {origin}", "ElementSpacing = 1 2 3", "DimSize = 2 2 2", "ElementType = MET_UCHAR", "ElementDataFile = LOCAL"]
    return ("\n".join(lines) + "\n").encode() + bytes(8)


def test_matrices_of_files(spark, tmp_path):
    srow = [0.0, -1.5, 0.0, 4.0, 1.5, 0.0, 0.0, 5.0, 0.0, 0.0, 2.0, 6.0]
    files = {
        "turned.nii": nifti1(quatern=HALF_TURN), "left.nii": nifti1(quatern=HALF_TURN, handed=-1.0, order=">"), "packed.nii.gz": gzip.compress(nifti1(quatern=[0.0] * 6)),
        "both.nii": nifti1(quatern=HALF_TURN, srow=srow), "plain.nii": nifti1(), "two.nii": nifti2((2, 2, 3), srow), "axes.mha": mha("0 1 0 -1 0 0 0 0 1", "7 8 9"),
        "short.nii": nifti1()[:200], "flat.nii": nifti1((2, 3, 0)), "text.mha": b"NDims = 3\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r.case: r for r in R.grids_or_errors(spark, str(tmp_path), r"/(\w+)\.\w+(?:\.gz)?$", "*").collect()}
    assert {c for c, r in found.items() if r.error} == {"short", "flat", "text"} and found["short"].nx is None
    want = {
        "turned": [-1, 0, 0, 10, 0, -2, 0, -20, 0, 0, 3, 30], "left": [-1, 0, 0, 10, 0, -2, 0, -20, 0, 0, -3, 30], "packed": [1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 3, 0],
        "both": srow, "plain": [1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 3, 0], "two": srow, "axes": [0, 2, 0, -7, -1, 0, 0, -8, 0, 0, 3, 9],
    }
    for case, matrix in want.items():
        assert np.allclose(found[case].affine, matrix, atol=1e-6), case
    data, sizes = R.decode_nifti(files["two.nii"])
    assert data.shape == (2, 2, 3) and sizes == [1.5, 1.5, 2.0] and data[1, 1, 2] == 2 * 11 + 1
    with pytest.raises(Exception, match="short"):
        R.grids(spark, str(tmp_path), r"/(\w+)\.nii$", "short*").collect()


def turned(degrees, sizes, origin):
    a = math.radians(degrees)
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, math.cos(0.3), -math.sin(0.3)], [0, math.sin(0.3), math.cos(0.3)]])
    return np.column_stack([turn * np.array(sizes), origin])


def test_algebra(spark):
    maps = [turned(d, (1 + d / 90, 0.7, 2.5), (d, -3.0, 4.0)) for d in (0, 30, 75, 180)]
    rows = [(a.ravel().tolist(), b.ravel().tolist()) for a in maps for b in maps] + [([0.0] * 12, maps[0].ravel().tolist())]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    full = lambda m: np.vstack([np.array(m).reshape(3, 4), [0, 0, 0, 1]])
    out = df.select("a", "b", A.inverse(F.col("a")).alias("i"), A.between(F.col("b"), F.col("a")).alias("m"), F.array(*A.apply(F.col("a"), [F.lit(1), F.lit(2), F.lit(3)])).alias("p")).collect()
    assert out[-1].i is None
    for r in out[:-1]:
        assert np.allclose(full(r.i), np.linalg.inv(full(r.a))) and np.allclose(full(r.m), np.linalg.inv(full(r.a)) @ full(r.b))
        assert np.allclose([*r.p, 1], full(r.a) @ [1, 2, 3, 1])


def test_resampling_between_two_grids(spark):
    rng = np.random.default_rng(2)
    soft = rng.random((9, 8, 7)) * (rng.random((9, 8, 7)) < 0.6)
    own, ref = turned(0, (1.0, 1.2, 2.0), (-3.0, 2.0, 1.0)), turned(35, (0.8, 1.1, 1.4), (-5.0, 0.0, -2.0))
    shape = (12, 11, 9)
    full = lambda m: np.vstack([m, [0, 0, 0, 1]])
    m = np.linalg.inv(full(own)) @ full(ref)
    near, linear = {}, {}
    at = lambda i, j, k: soft[i, j, k] if all(0 <= v < n for v, n in zip((i, j, k), soft.shape)) else 0.0
    for t in product(*map(range, shape)):
        s = (m @ [*t, 1])[:3]
        if at(*np.rint(s).astype(int)) > 0:
            near["a", *t] = True
        low = np.floor(s).astype(int)
        total = sum(at(*(low + o)) * np.prod(np.where(o, s - low, 1 - (s - low))) for o in map(np.array, product((0, 1), repeat=3)))
        if total:
            linear["a", *t] = total
    rows = [(c, *map(int, v), float(soft[tuple(v)])) for c in "ab" for v in np.argwhere(soft)]
    df = spark.createDataFrame(rows, "case string, x int, y int, z int, p double")
    grid = lambda *g: spark.createDataFrame([(c, *n, mm.ravel().tolist()) for c, n, mm in g], "case string, nx int, ny int, nz int, affine array<double>")
    mine, theirs = grid(("a", soft.shape, own), ("b", soft.shape, own)), grid(("a", shape, ref), ("b", soft.shape, own))
    got = {tuple(r)[:4]: r.p for r in V.resample_onto(df, mine, theirs).collect()}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {r[:4]: r[4] for r in rows if r[0] == "b"}
    got = {k: v for k, v in got.items() if k[0] == "a"}
    assert got.keys() == linear.keys() and all(math.isclose(got[k], linear[k], rel_tol=1e-9) for k in got)
    assert {tuple(r) for r in V.resample_onto(df.drop("p"), mine, theirs).collect() if r.case == "a"} == near.keys()
    with pytest.raises(ValueError, match="no matrix"):
        V.resample_onto(df, mine, theirs.filter("case = 'a'"))
