"""Episodes in chunks and on streams against a plain fold."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caselens.operators import provenance as P
from caselens.streaming import episodes as S
from caselens.streaming.jobs import incremental, read_files, state_store

LOG = "repo string, sha string, ts timestamp, subject string, files array<string>"
START = datetime(2026, 1, 1)


def log(n, repos, seed=0, words=40, days=40):
    rng = random.Random(seed)
    times = sorted(rng.randrange(days * 86400) for _ in range(n))
    return [
        (rng.choice(repos), f"{k:05d}", START + timedelta(seconds=t), f"word{rng.randrange(words)} thing{rng.randrange(words)}", [f"d{rng.randrange(words)}/f"])
        for k, t in enumerate(times)
    ]


def fold(rows):
    out, state = {}, {}
    for repo, sha, ts, subject, files in sorted(rows, key=lambda r: (r[0] or "", r[2], r[1])):
        number, last, size, seen = state.get(repo, (-1, None, 0, set()))
        own = {*subject.split(), *(f.split("/")[0] for f in files)}
        if last is None or ts - last > timedelta(days=3) or size >= 2 and not seen & own:
            number, size, seen = number + 1, 0, set()
        state[repo] = number, ts, size + 1, seen | own
        out[repo, sha] = number
    return out


@pytest.mark.parametrize(("repos", "words", "chunk"), [(["one"], 40, 25), (["one"], 3, 25), (["a", "b", None], 12, 20), (["a", "b"], 40, 1000)])
def test_chunks_change_nothing(spark, repos, words, chunk):
    rows = log(200, repos, words=words)
    found = P.episodes(spark.createDataFrame(rows, LOG), chunk).collect()
    assert {(r.repo, r.sha): r.episode for r in found} == fold(rows) and len(found) == 200


def test_no_commits(spark):
    assert P.episodes(spark.createDataFrame([], LOG)).count() == 0


def run(spark, batches, folder, restart_after=None):
    """Batches as files, read one at a time; a last one far in the future lets all others out. restart_after: stop there and go on from the checkpoint."""
    end = [("end", "end", START + timedelta(days=400), "x", ["x/y"])]
    for k, rows in enumerate([*batches, end]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if k == restart_after or k == len(batches):
            source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
            out = S.stream_episodes(source, "2 days").writeStream.format("parquet").option("checkpointLocation", str(folder / "state"))
            with state_store(spark):
                running = out.outputMode("append").trigger(availableNow=True).start(str(folder / "out"))
            running.awaitTermination()
    found = spark.read.parquet(str(folder / "out")).collect()
    assert len(found) == len({(r.repo, r.sha) for r in found})
    return {(r.repo, r.sha): r.episode for r in found if r.repo != "end"}


def test_stream_equals_batch(spark, tmp_path):
    rows = log(120, ["a", "b"], seed=3, words=9, days=20)
    want = {(r.repo, r.sha): r.episode for r in P.episodes(spark.createDataFrame(rows, LOG)).collect()}
    assert want == fold(rows) and max(want.values()) > 3
    rng = random.Random(1)
    near = sorted(rows, key=lambda r: r[2] + timedelta(hours=rng.randrange(40)))  # out of order, but less than the two days
    assert run(spark, [rows[:50], rows[50:]], tmp_path / "a") == want
    late = ("a", "late", rows[0][2] - timedelta(hours=1), "word1", ["d1/f"])  # comes when its time is long past
    assert run(spark, [near[:40], near[40:80], [*near[80:], late]], tmp_path / "b", restart_after=1) == want


def test_a_batch_does_not_read_what_was_written(spark, tmp_path):
    places = [str(tmp_path / name) for name in ("in", "out", "state")]

    def step(ids):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(places[0])
        query = incremental(read_files(spark, places[0], "id long"), places[1], places[2], "id", lambda batch: batch)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert step(range(50)) == 50
    before = spark.read.parquet(places[1])
    assert sorted(r.id for r in before.collect()) == list(range(50))
    for old in (tmp_path / "out").iterdir():  # gone, and still known after a restart
        old.rename(tmp_path / old.name)
    assert step([3, 4, 4, 50, 51, 51]) == 6
    assert sorted(r.id for r in spark.read.parquet(places[1]).collect()) == [50, 51]


def test_repositories_share_state_and_come_out_at_the_watermark(spark, tmp_path):
    """Rows of state are as many as buckets ask for, whatever the repositories; sessions need not be in UTC."""
    rows = log(200, [None, *(f"r{k}" for k in range(30))], seed=5, words=9, days=20)
    newest = START + timedelta(days=60)
    end, on = ("end", "end", newest, "x", ["x/y"]), ("on", "on", newest - timedelta(days=2), "x", ["x/y"])
    above = ("above", "above", newest - timedelta(days=2) + timedelta(microseconds=500), "x", ["x/y"])
    never = ("r1", "never", None, "x", ["x/y"])
    more = ("end", "more", newest + timedelta(milliseconds=1), "x", ["x/y"])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found, state = [], []
        for batch in ([*rows, end, on, above, never], [more]):
            spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
            out = S.stream_episodes(source, "2 days", buckets=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
            with state_store(spark):
                running = out.outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
            running.awaitTermination()
            state.append(max(p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress))
            result = spark.read.parquet(str(tmp_path / "out")).collect()
            assert len(result) == len({(r.repo, r.sha) for r in result})
            found.append({(r.repo, r.sha): r.episode for r in result})
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == fold(rows) | {("on", "on"): 0}
    assert found[1] == found[0] | {("above", "above"): 0}
    assert max(state) <= 16  # at first one of them for each repository
