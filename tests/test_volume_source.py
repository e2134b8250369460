"""Volumes as a data source: headers alone, slabs, errors as rows, and writes that are whole or not at all."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.sources import readers, volume_source as S


def content(seed, shape=(5, 4, 9)):
    data = np.random.default_rng(seed).integers(0, 3, shape).astype("u1")
    return data, readers.encode_nifti(data, (1.0, 2.0, 3.0), [1.0, 0, 0, -4, 0, 2.0, 0, 5, 0, 0, 3.0, 6])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("volumes")
    (path / "sub").mkdir()
    for k in range(3):
        (path / f"c{k}.nii").write_bytes(content(k)[1])
    (path / "sub" / "c3.nii.gz").write_bytes(gzip.compress(content(3)[1]))
    (path / "cut.nii").write_bytes(content(9)[1][:400])
    (path / "bad.nii").write_bytes(b"")
    (path / "note.txt").write_text("x")
    return f"file://{path}"


def places(rows):
    return {(r.case, r.x, r.y, r.z, r.p) for r in rows if r.error is None}


def want(cases):
    return {(f"c{k}", *map(int, v), float(content(k)[0][tuple(v)])) for k in cases for v in np.argwhere(content(k)[0])}


def test_grids_read_headers_alone(spark, folder):
    found = {r.case: r for r in S.grids(spark, folder).collect()}
    assert found.keys() == {"c0", "c1", "c2", "c3", "cut", "bad"}
    assert {c for c, r in found.items() if r.error} == {"bad"}  # what is cut has a whole header
    r = found["c3"]
    assert (r.nx, r.ny, r.nz, r.vx, r.vy, r.vz) == (5, 4, 9, 1.0, 2.0, 3.0) and r.affine == [1.0, 0, 0, -4, 0, 2.0, 0, 5, 0, 0, 3.0, 6]


@pytest.mark.parametrize("slab", [40, 1 << 24])
def test_slabs_hold_all_voxels(spark, folder, slab):
    rows = S.voxels(spark, folder, slab_bytes=slab)
    assert rows.rdd.getNumPartitions() == (6 if slab > 40 else 1 + 1 + 10 + 3 * 14)
    rows = rows.collect()
    assert places(r for r in rows if r.case != "cut") == want(range(4))
    assert {r.case for r in rows if r.error} == {"cut", "bad"}
    above = S.voxels(spark, folder, slab_bytes=slab, least=1).filter("case = 'c1'").collect()
    assert places(above) == {v for v in want([1]) if v[4] > 1}
    with pytest.raises(Exception, match="cut|bad"):
        S.voxels(spark, folder, strict="true").filter("case = 'cut'").collect()


def test_filters_leave_files_closed(spark, folder):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        assert places(S.voxels(spark, folder, strict="true").filter(F.col("case").isin("c0", "c3")).collect()) == want([0, 3])
        assert S.grids(spark, folder, strict="true").filter("case = 'c2'").count() == 1
    finally:
        spark.conf.set(name, before)


def test_writes_are_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    files = lambda ks: spark.createDataFrame([(f"c{k}", content(k)[1]) for k in ks], "case string, content binary").repartition(2)
    S.write(files([0, 1]), path)
    assert places(S.voxels(spark, path).collect()) == want([0, 1])
    S.write(files([2]), path, "append")
    assert places(S.voxels(spark, path).collect()) == want([0, 1, 2])
    broken = files([3]).unionByName(spark.createDataFrame([("c9", None)], "case string, content binary"))
    for bad in (broken, files([3, 3])):
        with pytest.raises(Exception):
            S.write(bad, path)
        assert sorted(p.name for p in (tmp_path / "out").glob("*.nii")) == ["c0.nii", "c1.nii", "c2.nii"]
        assert places(S.voxels(spark, path).collect()) == want([0, 1, 2])
    S.write(files([1, 3]), path)
    assert places(S.voxels(spark, path).collect()) == want([1, 3])
    assert S.voxels(spark, path, suffix=".none").count() == 0
