"""Commit logs: episodes, their summaries, significance, last touch, and the graph of nodes and edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import classify, subject_words, top_level
from ..storage import stash
from .ranking import chain
from .relational import first_by_priority

# Significance of the kinds of commits, and paths that are pipelines.
SIGNIFICANCE = {"correction": 5, "negative": 4, "decision": 3, "result": 2, "artifact": 1}
PIPELINE_NAME = r"(?i)^(Dockerfile|Makefile|package\.json|pyproject\.toml|compose\.ya?ml)$"
PIPELINE_PATHS = (
    r"(?i)(^|/)(workflows?|pipelines?|scripts?)/", r"(?i)(^|/)analysis_[a-z0-9_-]+\.(sh|py)$", r"(?i)\.(workflow|pipeline)\.ya?ml$",
)


def gap_sessions(df: DataFrame, keys: list[str], ts: str, order: list[str], gap_seconds: int) -> DataFrame:
    """df with ``session``: a new one starts after a longer gap within the key, fractions of seconds included. Rows without a time come last."""
    own = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in (ts, *order)))
    second = lambda c: c.cast("timestamp").cast("double")
    late = second(F.col(ts)) - second(F.lag(ts).over(own)) > gap_seconds
    return df.withColumn("session", F.sum(F.when(late, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def session_summary(sessions: DataFrame, keys: list[str], ts: str, last: int, value: str, tie: str) -> DataFrame:
    """Begin, end, length and the last few values of each session, in order."""
    falling = (F.col(c).desc_nulls_first() for c in (ts, tie))
    newest = F.row_number().over(Window.partitionBy(*keys, "session").orderBy(*falling)) <= last
    place = (F.col(ts).isNull().alias("__t"), ts, F.col(tie).isNull().alias("__i"), tie)
    kept = F.array_sort(F.collect_list(F.when(F.col("__new"), F.struct(*place, value))))
    marked = sessions.withColumn("__new", newest)
    return marked.groupBy(*keys, "session").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"),
        F.transform(kept, lambda x: x[value]).alias("last_values"),
    )


class Running:
    """The running episode of a repository: what it has gathered so far. A fresh one has no size."""

    GAP = pd.Timedelta(days=3)

    def __init__(self, repo=None, paths=(), words=(), size: int = 0, last=None):
        self.repo, self.paths, self.words, self.size, self.last = repo, set(paths), set(words), size, last

    def add(self, repo, ts, paths, words) -> bool:
        """Take the next commit, in order of repository, time and sha; whether it begins an episode."""
        near = self.size > 0 and repo == self.repo and ts - self.last <= self.GAP
        fresh = not (near and (self.size < 2 or self.paths & set(paths) or self.words & set(words)))
        if fresh:
            self.paths, self.words, self.size = set(), set(), 0
        self.paths |= set(paths)
        self.words |= set(words)
        self.repo, self.size, self.last = repo, min(self.size + 1, 2), ts
        return fresh


#: Commits that one task folds at a time, on average.
CHUNK_COMMITS = 50_000


def commit_keys(commits: DataFrame) -> DataFrame:
    """(repo, sha, ts, paths, words): what the rule of episodes looks at."""
    return commits.select(
        "repo", "sha", F.col("ts").cast("timestamp").alias("ts"), top_level("files").alias("paths"), subject_words("subject").alias("words"),
    )


def _folded(rows: pd.DataFrame, entering: pd.DataFrame) -> tuple[pd.DataFrame, Running, list[bool]]:
    """A chunk in order, the episode that runs at its end, and where episodes begin. entering: the one that runs at its start, if any."""
    rows = rows.sort_values(["repo", "ts", "sha"], na_position="first", kind="stable")
    run = Running(*entering.iloc[0][["repo", "paths", "words", "size", "last"]]) if len(entering) else Running()
    return rows, run, [run.add(*x) for x in zip(rows["repo"], rows["ts"], rows["paths"], rows["words"])]


def _leaving(chunked: DataFrame, entering: DataFrame) -> DataFrame:
    """(chunk, first_repo, first_ts, repo, paths, words, size, last): the episode that runs at each chunk's end."""
    kind = dict(chunked.dtypes)

    def one(key, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame()
        rows, run, _ = _folded(rows, state)
        first = rows.iloc[0]
        return pd.DataFrame({
            "chunk": [key[0]], "first_repo": [first["repo"]], "first_ts": [first["ts"]], "repo": [run.repo], "paths": [sorted(run.paths)],
            "words": [sorted(run.words)], "size": [run.size], "last": [run.last],
        })

    schema = f"chunk int, first_repo {kind['repo']}, first_ts timestamp, {_state(kind['repo'])}"
    return chunked.groupBy("chunk").cogroup(entering.groupBy("chunk")).applyInPandas(one, schema)


def _state(repo: str) -> str:
    return f"repo {repo}, paths array<string>, words array<string>, size int, last timestamp"


def _entering(leaving: DataFrame, before: DataFrame) -> DataFrame:
    """(chunk, state columns, mark) of chunks that an episode of the chunk before may reach into. before: chunk, previous."""
    own = leaving.select("chunk", "first_repo", "first_ts").join(before, "chunk")
    state = leaving.select(F.col("chunk").alias("previous"), "repo", "paths", "words", "size", "last")
    near = F.col("repo").eqNullSafe(F.col("first_repo")) & (F.col("first_ts") - F.col("last") <= F.expr("INTERVAL 3 DAYS"))
    mark = F.sha2(F.to_json(F.struct("paths", "words", "size")), 256)
    return own.join(state, "previous").filter(near).select("chunk", "repo", "paths", "words", "size", "last", mark.alias("mark"))


def _settled(chunked: DataFrame) -> DataFrame:
    """The episode that enters each chunk: chunks are folded as if none did, then again as long as what enters them changes.

    After a first pass over all chunks, a round folds only those whose entering episode is another than in their last fold.
    Rounds end early where episodes begin inside the chunks, or where what they gather no longer grows; at worst, if one
    episode grows through all chunks, there are as many rounds as chunks.
    """
    nothing = chunked.sparkSession.createDataFrame([], f"chunk int, {_state(dict(chunked.dtypes)['repo'])}, mark string")
    leaving, used = stash(_leaving(chunked, nothing)), nothing
    before = leaving.select("chunk", F.lag("chunk").over(Window.orderBy("chunk")).alias("previous"))  # over chunks
    while True:
        entering = stash(_entering(leaving, before))
        marks = lambda df, name: df.select("chunk", F.col("mark").alias(name))
        changed = marks(entering, "new").join(marks(used, "old"), "chunk", "full").filter(~F.col("new").eqNullSafe(F.col("old"))).select("chunk")
        changed = stash(changed)
        if changed.isEmpty():
            return entering
        again = _leaving(chunked.join(changed, "chunk", "left_semi"), entering.join(changed, "chunk", "left_semi"))
        leaving, used = stash(leaving.join(changed, "chunk", "left_anti").unionByName(again)), entering


def episodes(commits: DataFrame, chunk_commits: int = CHUNK_COMMITS) -> DataFrame:
    """commits: repo, sha, ts, subject, files. (repo, sha, episode): commits within three days that share paths or words.

    Whether a commit begins an episode depends on all that the running one has gathered. The log is dealt into chunks by
    ranges of (repo, ts, sha), whatever the repositories' sizes; chunks are folded apart, see _settled(), and numbered by
    prefix sums over chunks. A task holds a chunk and the running episode's sets.
    """
    rows, n = commit_keys(commits), commits.count()
    parts = max(1, -(-n // chunk_commits))
    chunked = stash(rows.repartitionByRange(parts, "repo", "ts", "sha").withColumn("chunk", F.spark_partition_id()))
    kind = dict(rows.dtypes)

    def numbered(key, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows, _, begins = _folded(rows, state)
        slot = rows["repo"].ne(rows["repo"].shift()).where(rows["repo"].notna() | rows["repo"].shift().notna(), False).cumsum()
        inside = pd.Series(begins, index=rows.index).groupby(slot).cumsum()
        return pd.DataFrame({"repo": rows["repo"], "sha": rows["sha"], "chunk": key[0], "slot": slot, "inside": inside})

    entering = _settled(chunked) if parts > 1 else chunked.limit(0).select("chunk", "repo", "paths", "words", F.lit(0).alias("size"), F.col("ts").alias("last"))
    found = stash(
        chunked.groupBy("chunk").cogroup(entering.groupBy("chunk")).applyInPandas(
            numbered, f"repo {kind['repo']}, sha {kind['sha']}, chunk int, slot bigint, inside bigint",
        )
    )
    sums = found.groupBy("chunk", "slot").agg(F.first("repo").alias("repo"), F.max("inside").alias("k"))
    upto = Window.partitionBy("repo").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # chunks of a repository
    sums = sums.select("chunk", "slot", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("before"))
    return found.join(sums, ["chunk", "slot"]).select("repo", "sha", (F.col("before") + F.col("inside") - 1).alias("episode"))


def episode_nodes(commits: DataFrame, membership: DataFrame, most: int = 14) -> DataFrame:
    """The last episodes of each repository, with time span, subjects and their most significant commit."""
    joined = commits.join(membership, ["repo", "sha"]).withColumn("kind", classify("subject"))
    rank = F.create_map(*(x for k, v in SIGNIFICANCE.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    lead = first_by_priority(joined, ["repo", "episode"], [rank.desc(), F.col("ts"), F.col("sha")]).select(
        "repo", "episode", F.col("sha").alias("lead_sha"), F.col("subject").alias("title"), "kind",
    )
    spans = joined.groupBy("repo", "episode").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_commits"))
    newest = F.dense_rank().over(Window.partitionBy("repo").orderBy(F.col("episode").desc()))
    return spans.join(lead, ["repo", "episode"]).withColumn("__n", newest).filter(F.col("__n") <= most).drop("__n").withColumn(
        "id", F.concat_ws("-", F.lit("episode"), "repo", F.col("episode").cast("string")),
    )


def episode_edges(nodes: DataFrame) -> DataFrame:
    return chain(nodes, ["repo"], [F.col("episode")], "id").withColumn("relation", F.lit("precedes"))


def pipeline_files(files: DataFrame, path: str) -> DataFrame:
    name = F.element_at(F.split(F.col(path), "/"), -1)
    match = name.rlike(PIPELINE_NAME)
    for p in PIPELINE_PATHS:
        match = match | F.col(path).rlike(p)
    return files.filter(match)


def last_touch(commits: DataFrame) -> DataFrame:
    """The newest commit of each path; of ties, the largest sha."""
    return first_by_priority(
        commits.select("repo", F.explode("files").alias("path"), "sha", "ts"), ["repo", "path"], [F.col("ts").desc(), F.col("sha").desc()],
    )


def repository_statistics(commits: DataFrame, author: str = "author") -> DataFrame:
    kinds = commits.withColumn("kind", classify("subject"))
    files = commits.select("repo", F.explode_outer("files").alias("f")).groupBy("repo").agg(F.count_distinct("f").alias("n_files"))
    return kinds.groupBy("repo").agg(
        F.count("*").alias("n_commits"), F.count_distinct(author).alias("n_contributors"),
        F.count_if(F.col("kind") == "decision").alias("n_decisions"), F.count_if(F.col("kind") == "correction").alias("n_corrections"),
    ).join(files, "repo")


def repository_graph(commits: DataFrame, most: int = 14) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node for each repository, for its last episodes and for its pipeline files; edges contain and precede.

    nodes: id, kind, title, parent. edges: source, target, relation.
    """
    found = episode_nodes(commits, episodes(commits), most)
    root = F.concat(F.lit("repo-"), F.col("repo"))
    touched = pipeline_files(last_touch(commits), "path")
    file_id = F.concat_ws("-", F.lit("file"), "repo", "path")
    node = lambda df, i, kind, title, parent: df.select(
        i.alias("id"), kind.alias("kind"), title.alias("title"), parent.alias("parent"),
    )
    nothing = F.lit(None).cast("string")
    nodes = node(commits.select("repo").distinct(), root, F.lit("repository"), F.col("repo"), nothing)
    nodes = nodes.unionByName(node(found, F.col("id"), F.col("kind"), F.col("title"), root)).unionByName(
        node(touched, file_id, F.lit("pipeline"), F.col("path"), root)
    )
    contains = nodes.filter("parent IS NOT NULL").select(
        F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"),
    )
    return nodes, contains.unionByName(episode_edges(found).select("source", "target", "relation"))
