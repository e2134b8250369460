"""Readers, sinks and streams over files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import provenance
from caselens.sources import readers as R, sinks
from caselens.streaming import jobs


def test_listing_and_subjects(spark, tmp_path):
    for name in ("sub-1/ses-1/a_T1w.nii.gz", "sub-1/ses-1/a_mask.nii.gz", "sub-2/ses-1/b_T1w.nii.gz"):
        (tmp_path / "R001" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "R001" / name).write_bytes(b"x")
    files = R.listing(spark, str(tmp_path))
    roles = {"image": r"_T1w\.nii", "mask": r"_mask\.nii"}
    assert {r.subject: r["mask"] is None for r in R.subjects(files, roles).collect()} == {"sub-1": False, "sub-2": True}
    assert R.sessions(files, roles).count() == 2
    sub = F.regexp_extract("path", r"/(sub-[^/]+)/", 1)
    assert {r.subject: r.path.split("/")[-1] for r in R.resolve(files, sub, ["a_mask.nii.gz"]).collect()} == {"sub-1": "a_mask.nii.gz", "sub-2": "b_T1w.nii.gz"}
    with pytest.raises(ValueError):
        R.unique_paths(files, sub)
    kinds = R.collection(files, [("mask", "_mask.nii.gz"), ("image", "_T1w.nii.gz")]).collect()
    assert sorted((r.kind, r.id) for r in kinds) == [("image", "a"), ("image", "b"), ("mask", "a")]
    with pytest.raises(ValueError):
        R.collection(files, [("mask", "_mask.nii.gz")])


def test_text_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,a\n1,2,3\n1,"x,y",3\n1,2\n1,2,3,4\n')
    assert sorted((r.line, r.fault) for r in R.csv_faults(spark, str(tmp_path / "t.csv")).collect()) == [(0, "repeated name"), (3, "too few cells"), (4, "too many cells")]
    (tmp_path / "log.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id": 3, "x"')
    assert {r.id for r in R.json_log(spark, str(tmp_path / "log.jsonl"), "id int").collect()} == {1, 2}
    (tmp_path / "ids.txt").write_text("a.nii\n\n# no\nb\n a.nii \n")
    assert {r.id for r in R.case_list(spark, str(tmp_path / "ids.txt"), r"\.nii").collect()} == {"a", "b"}
    (tmp_path / "shards").mkdir()
    for k in range(2):
        (tmp_path / "shards" / f"s{k}.json").write_text(
            json.dumps(
                {"shard_index": k, "shard_count": 2, "rows": [{"id": k, "dice": float("nan") if k else 0.5}], "errors": {f"e{k}": "bad"}}
            )
        )
    rows, errors = R.shards(spark, str(tmp_path / "shards"), "id int, dice double", 2)
    assert rows.count() == 2 and errors.count() == 2
    with pytest.raises(ValueError):
        R.shards(spark, str(tmp_path / "shards"), "id int, dice double", 3)
    (tmp_path / "split.json").write_text(json.dumps([{"train": ["a"], "val": ["b"]}, {"train": ["b"], "val": ["a"]}]))
    assert {tuple(r) for r in R.split_document(spark, str(tmp_path / "split.json")).collect()} == {(0, "train", "a"), (0, "val", "b"), (1, "train", "b"), (1, "val", "a")}
    meta = spark.createDataFrame([('{"CENTER": "x", "CHRONICITY": null, "DAYS_POST_STROKE": 5}',), ("broken",)], "m string")
    assert [(r.CENTER, r.DAYS_POST_STROKE) for r in R.case_metadata(meta, "m").collect()] == [("x", 5.0), (None, None)]


def test_git_formats(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"s1\x002026-01-01T00:00:00Z\0Fix a\0\ns2\x002026-01-02T00:00:00Z\0Add b\0\n")
    assert [(r.sha, r.subject) for r in R.git_log(spark, str(tmp_path / "log")).orderBy("sha").collect()] == [("s1", "Fix a"), ("s2", "Add b")]
    (tmp_path / "names").write_bytes(b"A\0x/y\0D\0gone\0M\0z\0")
    assert sorted(r.path for r in R.name_status(spark, str(tmp_path / "names")).collect()) == ["x/y", "z"]


def test_grids(spark):
    assert [r[0] for r in R.grid(spark, "0.1:0.5:0.1").collect()] == [0.1, 0.2, 0.3, 0.4, 0.5]
    assert [r[0] for r in R.grid(spark, "3,1,1").collect()] == [1.0, 3.0]
    with pytest.raises(ValueError):
        R.grid(spark, "1:0:0.1")


def test_volumes_round_trip(spark, tmp_path):
    data = np.zeros((3, 4, 5), np.float32)
    data[1, 2, 3], data[0, 0, 4] = 0.5, 0.9
    (tmp_path / "C1.nii").write_bytes(R.encode_nifti(data, (1.0, 2.0, 3.0)))
    rows = R.voxels(spark, str(tmp_path), r"(C\d)\.nii").collect()
    assert {(r.case, r.x, r.y, r.z, round(r.p, 4)) for r in rows} == {("C1", 1, 2, 3, 0.5), ("C1", 0, 0, 4, 0.9)}
    assert tuple(R.grids(spark, str(tmp_path), r"(C\d)\.nii").first()) == (
        "C1", 3, 4, 5, 1.0, 2.0, 3.0, [1.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 3.0, 0],
    )


def test_other_formats_and_broken_files(spark, tmp_path):
    import io
    import zlib

    data = np.arange(24, dtype="<i2").reshape((2, 3, 4), order="F")
    head = "ObjectType = Image\nNDims = 3\nDimSize = 2 3 4\nElementSpacing = 1 2 3\nElementType = MET_SHORT\n"
    (tmp_path / "C1.mha").write_bytes(f"{head}ElementDataFile = LOCAL\n".encode() + data.tobytes(order="F"))
    (tmp_path / "C2.mha").write_bytes(
        f"{head}CompressedData = True\nElementDataFile = LOCAL\n".encode() + zlib.compress(data.tobytes(order="F"))
    )
    (tmp_path / "C3.mha").write_bytes(f"{head}ElementDataFile = LOCAL\n".encode() + b"\0\0")
    p = np.zeros((2, 4, 3, 2), np.float32)
    p[1, 3, 2, 1] = 0.75
    buf = io.BytesIO()
    np.savez(buf, probabilities=p)
    (tmp_path / "C4.npz").write_bytes(buf.getvalue())
    matrix = [1.0, 0, 0, -5, 0, 1, 0, 7, 0, 0, 2, 9]
    (tmp_path / "C5.nii").write_bytes(R.encode_nifti(np.full((1, 1, 1), np.nan, "f4"), (1, 1, 1), matrix))
    rows = R.voxels_or_errors(spark, str(tmp_path), r"(C\d)\.", 0.5, "C*").collect()
    good = {c: {(r.x, r.y, r.z): r.p for r in rows if r.case == c and r.error is None} for c in ("C1", "C2", "C4")}
    assert good["C1"] == good["C2"] == {(x, y, z): float(data[x, y, z]) for x in range(2) for y in range(3) for z in range(4) if data[x, y, z] > 0}
    assert good["C4"] == {(1, 2, 3): 0.75}
    assert {r.case for r in rows if r.error is not None} == {"C3", "C5"} and "not finite" in next(r.error for r in rows if r.case == "C5")
    with pytest.raises(Exception, match="C3"):
        R.voxels(spark, str(tmp_path), r"(C\d)\.", glob="C3*").collect()
    assert {r.case for r in R.voxels_or_errors(spark, str(tmp_path), r"(C\d)\.", glob="C4*", low=0.0, high=0.5).filter("error IS NOT NULL").collect()} == {"C4"}
    assert R.grids(spark, str(tmp_path), r"(C\d)\.", "C5*").first().affine == matrix


def test_volumes_on_the_callers_grid(spark, tmp_path):
    voxels = spark.createDataFrame([("A", 0, 1, 2), ("A", 1, 1, 1), ("B", 0, 0, 0)], "case string, x int, y int, z int")
    grid = spark.createDataFrame(
        [(c, 2, 3, 4, 1.0, 1.5, 2.0, [float(v) for v in (1, 0, 0, 4, 0, 1.5, 0, 5, 0, 0, 2, 6)]) for c in "ABC"],
        "case string, nx int, ny int, nz int, vx double, vy double, vz double, affine array<double>",
    )
    (tmp_path / "old.nii").write_bytes(b"stale")
    sinks.write_volumes(voxels, grid, f"file://{tmp_path}")
    assert sorted(p.name for p in tmp_path.glob("*.nii")) == ["A.nii", "B.nii", "C.nii"]
    back = R.voxels(spark, str(tmp_path), r"([ABC])\.nii")
    assert {(r.case, r.x, r.y, r.z) for r in back.collect()} == {tuple(r) for r in voxels.collect()}
    assert {r["case"]: tuple(r)[1:] for r in R.grids(spark, str(tmp_path), r"([ABC])\.nii").collect()} == {r["case"]: tuple(r)[1:] for r in grid.collect()}
    with pytest.raises(Exception, match="beyond the grid"):
        sinks.encoded(voxels.withColumn("x", F.col("x") + 5), grid).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan")), (1, 0.5)], "id int, v double")
    sinks.write_json(df, str(tmp_path / "j"), ["id"])
    assert [json.loads(x) for p in sorted((tmp_path / "j").glob("part*")) for x in p.read_text().splitlines()] == [{"id": 1, "v": 0.5}, {"id": 2, "v": None}]
    assert json.loads(
        sinks.document(sinks.finite_columns(df), "rows", ["id"]).first().document
    ) == {"rows": [{"id": 1, "v": 0.5}, {"id": 2, "v": None}]}
    sinks.write_new(df, str(tmp_path / "n"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_new(df, str(tmp_path / "n"))
    sinks.promote(df, str(tmp_path / "p"), lambda t: t.filter("id > 5"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        sinks.promote(df, str(tmp_path / "p"), lambda t: t.filter("id > 1"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and not (tmp_path / "p.staged").exists()
    sinks.promote(df.limit(1), str(tmp_path / "p"), lambda t: t.limit(0))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1 and sorted(x.name for x in tmp_path.glob("p*")) == ["p"]
    (tmp_path / "p.lock").write_text("")
    with pytest.raises(RuntimeError, match="being written"):
        sinks.promote(df, str(tmp_path / "p"), lambda t: t.limit(0))
    with pytest.raises(ValueError, match="lies within"):
        sinks.write_outside(df, str(tmp_path / "tree" / "out"), str(tmp_path / "tree"))
    for shard in (0, 1, 1):
        sinks.append_shard(df, str(tmp_path / "shards"), shard)
    assert spark.read.csv(str(tmp_path / "shards"), header=True).count() == 4
    names = spark.createDataFrame([("a,b", 'q"', 1.5), ("c", None, None)], "x string, y string, z double")
    sinks.write_leaderboard(names, str(tmp_path / "board.csv"), ["m1", "m2"])
    assert (tmp_path / "board.csv").read_text(newline="") == '# INCOMPLETE: m1, m2\r\nx,y,z\r\n"a,b","q""",1.5\r\nc,,\r\n'
    sinks.write_report({"rows": df}, str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == {"rows": [{"id": 2, "v": None}, {"id": 1, "v": 0.5}]}
    with pytest.raises(ValueError, match="bad folds"):
        R.select_folds(spark.range(3), "0,9", "id")
    assert R.select_folds(spark.range(3), "0,2", "id").count() == 2 and R.select_folds(spark.range(3), "all", "id").count() == 3


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    q = jobs.tumbling(
        stream, "ts", "6 hours", "1000 days", ["event_type"], "value",
    ).writeStream.outputMode("complete").format("memory").queryName("tumbling_out").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r)[:4] for r in jobs.tumbling(events, "ts", "6 hours", "1 hour", ["event_type"], "value").collect()}
    assert {tuple(r)[:4] for r in spark.sql("SELECT * FROM tumbling_out").collect()} == want
    for _ in range(2):  # the second run finds nothing new
        source = jobs.read_files(spark, str(tmp_path / "in"), events.schema)
        jobs.incremental(source, str(tmp_path / "out"), str(tmp_path / "cp"), "event_id", lambda b: b.select("event_id")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    events.limit(5).unionByName(
        events.limit(1).withColumn("event_id", F.lit(-1).cast("bigint"))
    ).write.mode("append").parquet(str(tmp_path / "in"))
    source = jobs.read_files(spark, str(tmp_path / "in"), events.schema)
    jobs.incremental(source, str(tmp_path / "out"), str(tmp_path / "cp"), "event_id", lambda b: b.select("event_id")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == events.count() + 1


def test_episodes(spark):
    rows = [
        ("r", "a", "2026-01-01", "Alpha thing", ["x/1"]), ("r", "b", "2026-01-02", "Other", ["y/1"]),
        ("r", "c", "2026-01-03", "Third", ["z/1"]), ("r", "d", "2026-01-04", "Third again", ["q/1"]),
        ("r", "e", "2026-02-01", "Fix third", ["q/1"]),
    ]
    commits = spark.createDataFrame(
        rows, "repo string, sha string, ts string, subject string, files array<string>",
    ).withColumn("ts", F.to_timestamp("ts"))
    found = provenance.episodes(commits)
    assert {r.sha: r.episode for r in found.collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    nodes = provenance.episode_nodes(commits, found)
    assert {(r.episode, r.kind, r.n_commits) for r in nodes.collect()} == {(0, "artifact", 2), (1, "artifact", 2), (2, "correction", 1)}
    assert provenance.episode_edges(nodes).count() == 2
    assert {(r.path, r.sha) for r in provenance.last_touch(commits).collect()} >= {("q/1", "e"), ("z/1", "c")}
    assert provenance.pipeline_files(
        commits.select(F.explode("files").alias("p")).union(spark.createDataFrame([("scripts/x.py",), ("a/Makefile",)], "p string")), "p",
    ).count() == 2
