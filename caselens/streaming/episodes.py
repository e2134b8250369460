"""Episodes of a stream of commits: the rule of provenance.episodes() with state that survives batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.provenance import Running, commit_keys

#: Groups of repositories that hold state together. A checkpoint goes on with the number that it began with.
BUCKETS = 2_048

_SETS = [("paths", pa.list_(pa.string())), ("words", pa.list_(pa.string()))]
_COMMITS = pa.schema([("repo", pa.string()), ("sha", pa.string()), ("micros", pa.int64()), *_SETS])
_RUNS = pa.schema([("repo", pa.string()), ("number", pa.int64()), *_SETS, ("size", pa.int32()), ("last", pa.int64())])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _table(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


class _Run(Running):
    """Times are whole microseconds."""

    GAP = Running.GAP // pd.Timedelta(microseconds=1)


class _Episodes(StatefulProcessor):
    """Commits of a bucket of repositories wait until the watermark has passed them; then no earlier one can come, and they join their repository's running episode in order.

    State is a few packed tables for each bucket, so that calls to the store are as many as buckets, and not as repositories or commits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "commits binary")
        self.running = handle.getValueState("running", "runs binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, micros: int) -> None:
        """One timer for each bucket, that of its earliest commit: the first millisecond of the watermark that passes it."""
        at, old = -(-micros // 1_000), self.timer.get() if self.timer.exists() else None
        if old is not None and old[0] <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for batch in rows:
            if len(batch):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(batch[_COMMITS.names], _COMMITS, preserve_index=False)),))
                first.append(int(batch["micros"].min()))
        if first:
            self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        self.timer.clear()
        rows = pa.concat_tables(_table(x) for (x,) in self.waiting.get())
        due = rows.filter(pc.less_equal(rows["micros"], passed)).sort_by([(c, "ascending") for c in ("repo", "micros", "sha")])
        rest = rows.filter(pc.greater(rows["micros"], passed))
        self.waiting.clear()
        if len(rest):
            self.waiting.appendValue((_packed(rest),))
            self._wake(pc.min(rest["micros"]).as_py())
        if not len(due):
            return
        runs = {}
        if self.running.exists():
            for x in _table(self.running.get()[0]).to_pylist():
                runs[x["repo"]] = [x["number"], _Run(x["repo"], x["paths"], x["words"], x["size"], x["last"])]
        out = []
        for repo, micros, paths, words in zip(*(due[c].to_pylist() for c in ("repo", "micros", "paths", "words"))):
            if repo not in runs:
                runs[repo] = [-1, _Run()]
            own = runs[repo]
            own[0] += own[1].add(repo, micros, paths, words)
            out.append(own[0])
        state = [
            {"repo": repo, "number": k, "paths": list(run.paths), "words": list(run.words), "size": run.size, "last": run.last}
            for repo, (k, run) in runs.items()
        ]
        self.running.update((_packed(pa.Table.from_pylist(state, _RUNS)),))
        yield pd.DataFrame({"repo": due["repo"].to_pylist(), "sha": due["sha"].to_pylist(), "episode": out})

    def close(self) -> None:
        pass


def stream_episodes(commits: DataFrame, late: str, buckets: int = BUCKETS) -> DataFrame:
    """commits: a stream of repo (string), sha (string), ts, subject, files. (repo, sha, episode), as episodes() numbers them.

    A commit comes out when the watermark, ``late`` behind the newest one, has passed it. Commits later than that are left
    out, since their episode's place is taken, and so are those without a time, which no watermark passes. A task holds a
    bucket of repositories at a time: its waiting commits and running episodes. Start it inside jobs.state_store().
    """
    timed = commits.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    keyed = commit_keys(timed).select(
        F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int").alias("bucket"), "ts", F.unix_micros("ts").alias("micros"), "repo", "sha", "paths", "words",
    )
    return keyed.groupBy("bucket").transformWithStateInPandas(
        _Episodes(), "repo string, sha string, episode bigint", "Append", "EventTime",
    )
