"""Queries over commit logs, which events play: a user is a repository, an event a commit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, provenance
from ..storage import shared_dir, stash
from ..streaming import episodes, jobs
from .catalog import query

_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_KIND = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(subject), '{rule.removeprefix('(?i)')}') THEN '{name}'" for name, rule in S.SUBJECT_RULES
) + " ELSE 'artifact' END"
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in provenance.SIGNIFICANCE.items()) + " END"
_LOG = """l AS (SELECT CAST(user_id AS VARCHAR) AS repo, CAST(event_id AS VARCHAR) AS sha, ts, CASE WHEN value < 50 THEN 'fix ' WHEN value < 120 THEN 'adopt the ' WHEN value > 470 THEN 'score of ' ELSE '' END || event_type AS subject, [CASE WHEN value < 100 THEN 'scripts/run.sh' ELSE event_type || '/data' END, event_type || '/' || user_id % 3] AS files FROM events)"""
_EPISODES = f"""{_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, sha) AS k, list_distinct(list_transform(files, lambda f: split_part(f, '/', 1))) AS paths, list_distinct(list_filter(string_split(trim(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) AS words FROM l),
e(repo, k, ts, episode, paths, words, size) AS (SELECT repo, k, ts, 0::BIGINT, paths, words, 1 FROM o WHERE k = 1 UNION ALL
 SELECT repo, k, ts, CASE WHEN near THEN episode ELSE episode + 1 END, CASE WHEN near THEN list_distinct(list_concat(seen_paths, paths)) ELSE paths END, CASE WHEN near THEN list_distinct(list_concat(seen_words, words)) ELSE words END, CASE WHEN near THEN size + 1 ELSE 1 END
 FROM (SELECT o.repo, o.k, o.ts, e.episode, e.paths AS seen_paths, o.paths, e.words AS seen_words, o.words, e.size, epoch(o.ts) - epoch(e.ts) <= 259200 AND (e.size < 2 OR list_has_any(e.paths, o.paths) OR list_has_any(e.words, o.words)) AS near FROM e JOIN o ON o.repo = e.repo AND o.k = e.k + 1)),
m AS (SELECT o.*, e.episode, {_KIND} AS kind FROM o JOIN e USING (repo, k))"""
_NODES = f"""{_EPISODES}, sp AS (SELECT repo, episode, count(*) AS n_commits FROM m GROUP BY ALL), ld AS (SELECT repo, episode, sha AS lead_sha, subject AS title, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo, episode ORDER BY {_RANK} DESC, ts, sha) AS i FROM m) WHERE i = 1),
n AS (SELECT * FROM (SELECT repo, episode, n_commits, lead_sha, title, kind, row_number() OVER (PARTITION BY repo ORDER BY episode DESC) AS i FROM sp JOIN ld USING (repo, episode)) WHERE i <= 14)"""
_TOUCH = "t AS (SELECT repo, path, sha FROM (SELECT repo, path, sha, row_number() OVER (PARTITION BY repo, path ORDER BY ts DESC, sha DESC) AS i FROM (SELECT repo, sha, ts, unnest(files) AS path FROM l)) WHERE i = 1)"
_PIPELINE = "(regexp_matches(regexp_extract(path, '[^/]*$'), '" + provenance.PIPELINE_NAME + "')" + "".join(f" OR regexp_matches(path, '{p}')" for p in provenance.PIPELINE_PATHS) + ")"


def _commits(table):
    v, kind = F.col("value"), F.col("event_type")
    subject = F.concat(F.when(v < 50, "fix ").when(v < 120, "adopt the ").when(v > 470, "score of ").otherwise(""), kind)
    files = F.array(
        F.when(v < 100, "scripts/run.sh").otherwise(F.concat(kind, F.lit("/data"))),
        F.concat(kind, F.lit("/"), (F.col("user_id") % 3).cast("string")),
    )
    return table("events").select(
        F.col("user_id").cast("string").alias("repo"), F.col("event_id").cast("string").alias("sha"), "ts", subject.alias("subject"),
        files.alias("files"),
    )


@query(f"WITH RECURSIVE {_EPISODES} SELECT repo, sha, episode FROM m")
def commit_episodes(table):
    return provenance.episodes(_commits(table))


_ONE_LOG = """l AS (SELECT 'all' AS repo, CAST(event_id AS VARCHAR) AS sha, ts, 'w' || CAST(floor(value) AS INT) || ' ' || event_type || user_id AS subject, ['d' || user_id % 40 || '/f'] AS files FROM events)"""


@query(f"WITH RECURSIVE {_EPISODES.replace(_LOG, _ONE_LOG)} SELECT repo, sha, episode FROM m")
def log_episodes(table):
    """The whole table as the log of one repository, folded in chunks."""
    v, user = F.floor("value").cast("string"), F.col("user_id")
    commits = table("events").select(
        F.lit("all").alias("repo"), F.col("event_id").cast("string").alias("sha"), "ts",
        F.concat(F.lit("w"), v, F.lit(" "), F.col("event_type"), user.cast("string")).alias("subject"),
        F.array(F.concat(F.lit("d"), (user % 40).cast("string"), F.lit("/f"))).alias("files"),
    )
    return provenance.episodes(commits, 5_000)


@query(f"WITH RECURSIVE {_EPISODES} SELECT repo, sha, episode FROM m WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM l)")
def streamed_episodes(table):
    """The same rule on a stream: what the watermark has passed when all events are read."""
    commits = stash(_commits(table))
    spark, folder = commits.sparkSession, f"{shared_dir(commits.sparkSession)}/{uuid.uuid4().hex}"
    source = spark.readStream.schema(commits.schema).parquet(commits.inputFiles()[0].rpartition("/")[0])
    out = episodes.stream_episodes(source, "2 days").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    with jobs.state_store(spark):
        running = out.outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    running.awaitTermination()
    return spark.read.schema("repo string, sha string, episode bigint").parquet(f"{folder}/out")


@query(f"WITH RECURSIVE {_NODES} SELECT repo, episode, n_commits, lead_sha, title, kind FROM n")
def episode_nodes(table):
    commits = _commits(table)
    return provenance.episode_nodes(commits, provenance.episodes(commits)).select(
        "repo", "episode", "n_commits", "lead_sha", "title", "kind",
    )


@query(f"WITH {_LOG}, {_TOUCH} SELECT repo, path, sha FROM t")
def last_touches(table):
    return provenance.last_touch(_commits(table)).select("repo", "path", "sha")


@query(f"WITH {_LOG}, {_TOUCH} SELECT repo, path FROM t WHERE {_PIPELINE}")
def pipeline_candidates(table):
    return provenance.pipeline_files(provenance.last_touch(_commits(table)), "path").select("repo", "path")


@query(
    f"""WITH {_LOG}, k AS (SELECT repo, {_KIND} AS kind, split_part(subject, ' ', -1) AS author, files FROM l) SELECT repo, count(*) AS n_commits, count(DISTINCT author) AS n_contributors, count(*) FILTER (WHERE kind = 'decision') AS n_decisions, count(*) FILTER (WHERE kind = 'correction') AS n_corrections, (SELECT count(DISTINCT f) FROM (SELECT unnest(files) AS f FROM l WHERE l.repo = k.repo)) AS n_files FROM k GROUP BY repo"""
)
def repository_statistics(table):
    """The last word of a subject plays the author."""
    return provenance.repository_statistics(_commits(table).withColumn("author", F.element_at(F.split("subject", " "), -1)))


@query(f"""WITH RECURSIVE {_NODES}, {_TOUCH}, f AS (SELECT repo, path FROM t WHERE {_PIPELINE}), ids AS (SELECT 'repo-' || repo AS id, NULL AS parent FROM (SELECT DISTINCT repo FROM l) UNION ALL SELECT 'episode-' || repo || '-' || episode, 'repo-' || repo FROM n UNION ALL SELECT 'file-' || repo || '-' || path, 'repo-' || repo FROM f)
SELECT parent AS source, id AS target, 'contains' AS relation FROM ids WHERE parent IS NOT NULL UNION ALL SELECT source, target, 'precedes' FROM (SELECT 'episode-' || repo || '-' || episode AS source, lead('episode-' || repo || '-' || episode) OVER (PARTITION BY repo ORDER BY episode) AS target FROM n) WHERE target IS NOT NULL""")
def repository_graph(table):
    return provenance.repository_graph(_commits(table))[1]


_LENSES = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_regionkey AS BIGINT) END AS parent, [lower(r_name), CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END] AS lenses, CASE WHEN n_nationkey % 7 = 0 THEN 'hidden' ELSE 'shown' END AS status FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _nodes(table):
    k = F.col("n_nationkey")
    rows = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lenses = F.array(F.lower("r_name"), F.when(k % 2 == 0, "even").otherwise("odd"))
    return rows.select(
        k.cast("bigint").alias("id"), F.when(k % 3 > 0, F.col("n_regionkey").cast("bigint")).alias("parent"), lenses.alias("lenses"),
        F.when(k % 7 == 0, "hidden").otherwise("shown").alias("status"),
    )


_SCOPE = "s AS (SELECT * FROM n WHERE parent = 1 AND status <> 'hidden'), e AS (SELECT a.id AS source, b.id AS target, list_intersect(a.lenses, b.lenses) AS lenses FROM s a JOIN s b ON b.id > a.id AND b.id <= a.id + 12)"
_ORDER = ("odd", "america", "even", "asia")


@query(f"""WITH {_LENSES}, {_SCOPE}, k AS (SELECT unnest({list(_ORDER)}) AS lens, unnest(range(0, {len(_ORDER)})) AS i), p AS (SELECT lens, i, 1000 * (SELECT count(*) FROM e WHERE list_contains(lenses, lens)) + (SELECT count(*) FROM s WHERE list_contains(lenses, lens)) AS score FROM k)
SELECT lens, score FROM p ORDER BY score DESC, lens <> 'even', i LIMIT 1""")
def inferred_lens(table):
    """The lens under which a scope shows most: edges count a thousand nodes; on a tie the given one stays."""
    nodes = _nodes(table)
    a, b = (nodes.select(F.col("id").alias(end), F.col("lenses").alias(f"{end}_lenses")) for end in ("source", "target"))
    edges = a.join(b, F.col("target").between(F.col("source") + 1, F.col("source") + 12)).select(
        "source", "target", F.array_intersect("source_lenses", "target_lenses").alias("lenses"),
    )
    return graph.best_lens(*graph.scope(nodes, edges, 1, None, ("hidden",)), _ORDER, "even")


@query(
    f"WITH {_LENSES}, v AS (SELECT * FROM n WHERE parent IS NULL AND list_contains(lenses, 'even') AND status <> 'hidden') SELECT a.id AS source, b.id AS target FROM v a JOIN v b ON b.id = a.id + 6"
)
def scoped_edges(table):
    """Roots seen through a lens without hidden ones, and the edges among them."""
    nodes = _nodes(table)
    edges = nodes.select(F.col("id").alias("source"), (F.col("id") + 6).alias("target"))
    return graph.scope(nodes, edges, None, "even", ("hidden",))[1].select("source", "target")


@query(
    f"WITH {_LENSES} SELECT 'bad status' AS kind, id FROM n WHERE status <> 'shown' UNION ALL SELECT 'no parent', id FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n) UNION ALL SELECT 'no target', id FROM n WHERE id + 6 NOT IN (SELECT id FROM n)"
)
def graph_faults(table):
    nodes = _nodes(table)
    edges = nodes.select("id", F.col("id").alias("source"), (F.col("id") + 6).alias("target"))
    return graph.bad_values(nodes, "status", ("shown",)).unionByName(graph.dangling(nodes, edges))
