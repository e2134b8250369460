"""Files written by the sinks and read by the readers, from the given tables and against them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports
from ..sources import readers, sinks
from ..storage import shared_dir
from .catalog import query


def _place(df) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"


# --- tables -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders")
def csv_round_trip(table):
    rows = table("orders")
    path = _place(rows)
    sinks.write_csv(rows, path, ["o_orderkey", "o_orderstatus", "o_totalprice"], ["o_orderkey"])
    return readers.csv(rows.sparkSession, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE round(s_acctbal, 6) END AS balance FROM supplier")
def json_round_trip(table):
    """Values that are not finite come back as NULL."""
    balance = F.when(F.col("s_suppkey") % 10 == 0, float("nan")).otherwise(F.col("s_acctbal"))
    rows = table("supplier").select(F.col("s_suppkey").alias("id"), balance.alias("balance"))
    path = _place(rows)
    sinks.write_json(rows, path, ["id"])
    return readers.json_log(rows.sparkSession, path, "id bigint, balance double")


@query("SELECT o_orderkey % 4 AS shard, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1")
def appended_shards(table):
    """Shards under their numbers, one of them written twice."""
    rows = table("orders").select("o_orderkey", "o_custkey")
    path = _place(rows)
    for k in (0, 1, 2, 3, 2):
        sinks.append_shard(rows.filter(F.col("o_orderkey") % 4 == k), path, k)
    read = rows.sparkSession.read.schema("o_orderkey bigint, o_custkey bigint, shard bigint").csv(path, header=True)
    return read.groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("SELECT CASE WHEN t % 1 = 0 THEN CAST(CAST(t AS BIGINT) AS VARCHAR) ELSE CAST(CAST(t AS DOUBLE) AS VARCHAR) END AS threshold, n FROM (SELECT round(l_discount * 10, 6) AS t, count(*) AS n FROM lineitem GROUP BY 1)")
def sweep_files(table):
    rows = table("lineitem").groupBy(F.round(F.col("l_discount").cast("double") * 10, 6).alias("threshold")).agg(F.count("*").alias("n"))
    path = _place(rows)
    sinks.write_sweep(rows, path, ["threshold", "n"])
    return readers.csv(rows.sparkSession, path, "threshold string, n bigint")


@query("""WITH b AS (SELECT n_name || CASE WHEN n_nationkey % 3 = 0 THEN ', "x"' ELSE '' END AS name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name) SELECT name, n FROM b""")
def leaderboard_file(table):
    """Quoted cells below a line that names what is missing."""
    odd = F.when(F.col("n_nationkey") % 3 == 0, ', "x"').otherwise("")
    rows = table("nation").join(table("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy("n_nationkey", F.concat("n_name", odd).alias("name")).agg(F.count("*").alias("n")).select("name", "n")
    path = _place(rows)
    sinks.write_leaderboard(rows, path, ["a", "b"])
    read = rows.sparkSession.read.option("comment", "#").option("header", True).option("escape", '"')
    return read.schema("name string, n bigint").csv(path)


@query("SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'largest', max(n_nationkey)::BIGINT FROM nation")
def report_document(table):
    """One document of two tables."""
    nation = table("nation")
    regions = table("region").join(nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))
    path = _place(nation)
    sinks.write_report({"regions": regions, "top": nation.agg(F.max("n_nationkey").cast("bigint").alias("n"))}, path)
    read = readers.json_documents(nation.sparkSession, path, "regions array<struct<region string, n bigint>>, top array<struct<n bigint>>")
    return read.select(F.explode("regions").alias("r")).select("r.region", "r.n").unionByName(
        read.select(F.lit("largest").alias("region"), F.col("top")[0]["n"].alias("n"))
    )


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT unnest(['| n_nationkey | n_name |', '|---|---|'])")
def markdown_file(table):
    nation = table("nation")
    path, spark = _place(nation), nation.sparkSession
    sinks.write_text(spark, path, "\n".join(reports.markdown_table(nation.orderBy("n_nationkey"), ["n_nationkey", "n_name"])) + "\n")
    return spark.read.text(path).select(F.regexp_replace("value", r"^\|[-| :]+\|$", "|---|---|").alias("line"))


@query("SELECT p_partkey, p_name, 'kept' AS state FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT NULL, NULL, 'refused'")
def promoted_table(table):
    """A table that takes its name twice, and one with faults that does not."""
    parts, spark = table("part").select("p_partkey", "p_name"), table("part").sparkSession
    path, faults = _place(parts), lambda df: df.filter("p_partkey % 3 = 0").select("p_partkey")
    for rows in (parts.limit(0), parts.filter("p_partkey % 3 > 0")):
        sinks.promote(rows, path, faults)
    try:
        sinks.promote(parts, path, faults)
        state = "promoted"
    except ValueError:
        state = "refused"
    nothing = spark.range(1).select(F.lit(None).cast("bigint").alias("p_partkey"), F.lit(None).cast("string").alias("p_name"), F.lit(state).alias("state"))
    return spark.read.parquet(path).withColumn("state", F.lit("kept")).unionByName(nothing)


@query("SELECT s_suppkey, 'written' AS state FROM supplier UNION ALL SELECT NULL, unnest(['exists', 'inside'])")
def exclusive_table(table):
    """A new table outside of what was scanned; not over another, and not within."""
    rows = table("supplier").select("s_suppkey")
    root, spark, states = _place(rows), rows.sparkSession, []
    sinks.write_outside(rows, f"{root}/out", f"{root}/scanned")
    for state, path, scanned in (("exists", f"{root}/out", f"{root}/scanned"), ("inside", f"{root}/scanned/a", f"{root}/scanned/")):
        try:
            sinks.write_outside(rows, path, scanned)
            states.append("written")
        except Exception:  # an existing path is Spark's own error
            states.append(state)
    refused = spark.range(1).select(F.lit(None).cast("bigint").alias("s_suppkey"), F.explode(F.array(*map(F.lit, states))).alias("state"))
    return spark.read.parquet(f"{root}/out").withColumn("state", F.lit("written")).unionByName(refused)


@query("SELECT o_orderpriority AS \"case\", count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 2 = 1 OR o_orderpriority <> '1-URGENT' GROUP BY 1")
def tables_by_case(table):
    """A folder for each case; one of them is written again with fewer rows."""
    rows = table("orders").select(F.col("o_orderpriority").alias("case"), "o_orderkey")
    path = _place(rows)
    sinks.write_by_case(rows, path)
    sinks.write_by_case(rows.filter("case = '1-URGENT' AND o_orderkey % 2 = 1"), path)
    read = rows.sparkSession.read.schema("o_orderkey bigint, case string").parquet(path)
    return read.groupBy("case").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


# --- documents, lists and logs ------------------------------------------------------------------


def _files(rows, path, content):
    """Each row as a file; their folder."""
    place = _place(rows)
    sinks.write_files(rows.select(path.alias("path"), content.alias("content")), place)
    return place


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS line, CASE WHEN n_nationkey % 5 = 0 THEN 'too many cells' ELSE 'too few cells' END AS fault FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 1 UNION ALL SELECT 0, 'repeated name'")
def csv_fault_report(table):
    k = F.col("n_nationkey")
    line = F.when(k % 5 == 0, F.concat_ws(",", k, "n_name", F.lit('"x,y"'), k)).when(k % 7 == 1, F.concat_ws(",", k, "n_name")).otherwise(F.concat_ws(",", k, "n_name", k))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("line")))), lambda x: x["line"])
    text = table("nation").agg(F.concat(F.lit("a,b,a\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    place = _files(text, F.lit("t.csv"), F.col("text"))
    return readers.csv_faults(text.sparkSession, f"{place}/t.csv").drop("path")


@query("SELECT 'row' AS kind, o_orderkey::VARCHAR AS id, round(o_totalprice, 6) AS value FROM orders WHERE o_orderkey % 50 > 0 UNION ALL SELECT 'error', o_orderkey::VARCHAR, NULL FROM orders WHERE o_orderkey % 50 = 0")
def shard_union(table):
    """Rows and errors of shard documents."""
    k = F.col("o_orderkey")
    rows = table("orders").groupBy((k % 8).cast("int").alias("shard_index"), F.lit(8).alias("shard_count")).agg(
        F.collect_list(F.when(k % 50 > 0, F.struct(k.alias("id"), F.col("o_totalprice").alias("value")))).alias("rows"),
        F.map_from_entries(F.collect_list(F.when(k % 50 == 0, F.struct(k.cast("string"), F.lit("bad"))))).alias("errors"),
    )
    place = _files(rows, F.concat(F.lit("shard_"), "shard_index", F.lit(".json")), F.to_json(F.struct("*")))
    found, errors = readers.shards(rows.sparkSession, place, "id bigint, value double", 8)
    return found.select(F.lit("row").alias("kind"), F.col("id").cast("string").alias("id"), "value").unionByName(
        errors.select(F.lit("error").alias("kind"), "id", F.lit(None).cast("double").alias("value"))
    )


@query("SELECT DISTINCT c_name AS id FROM customer WHERE c_custkey % 4 > 0")
def listed_cases(table):
    """Lists with blanks, comments, suffixes and repeats."""
    k, name = F.col("c_custkey"), F.col("c_name")
    line = F.when(k % 4 == 0, F.concat(F.lit("# "), name)).when(k % 4 == 1, F.concat(F.lit("  "), name, F.lit(".nii "))).otherwise(name)
    rows = table("customer").select(F.explode(F.array(line, F.lit(""), line)).alias("value"))
    path = _place(rows)
    rows.write.text(path)
    return readers.case_list(rows.sparkSession, path, r"\.nii")


def _logs(table, content):
    """A log file for each user, its pieces in order of event_id."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("event_id", content.alias("piece")))), lambda x: x["piece"])
    rows = table("events").groupBy("user_id").agg(F.array_join(pieces, "").alias("log"))
    return rows.sparkSession, _files(rows, F.concat(F.lit("r"), "user_id", F.lit(".log")), F.col("log"))


@query("SELECT event_id::VARCHAR AS sha, date_trunc('second', ts) AS ts, 'about ' || event_type AS subject FROM events")
def scanned_commits(table):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    spark, place = _logs(table, F.concat(F.col("event_id").cast("string"), F.lit("\0"), stamp, F.lit("\0about "), "event_type", F.lit("\0\n")))
    return readers.git_log(spark, place).select("sha", F.col("ts").cast("timestamp_ntz").alias("ts"), "subject")


@query("SELECT event_type || '/' || event_id AS path, CASE WHEN value < 100 THEN 'M' ELSE 'A' END AS status FROM events WHERE value >= 20")
def scanned_changes(table):
    """Names without deletions."""
    status = F.when(F.col("value") < 20, "D").when(F.col("value") < 100, "M").otherwise("A")
    spark, place = _logs(table, F.concat(status, F.lit("\0"), "event_type", F.lit("/"), "event_id", F.lit("\0")))
    return readers.name_status(spark, place).select("path", "status")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 6 > 0 THEN 'n' || s_nationkey END AS \"CENTER\", CASE WHEN s_suppkey % 6 > 0 THEN round(s_acctbal, 6) END AS \"CHRONICITY\", CASE WHEN s_suppkey % 6 > 0 AND s_suppkey % 4 > 0 THEN s_suppkey::DOUBLE END AS \"DAYS_POST_STROKE\" FROM supplier")
def metadata_documents(table):
    """Fields of metadata, missing for some, and broken documents as NULLs."""
    k = F.col("s_suppkey")
    fields = F.struct(F.concat(F.lit("n"), "s_nationkey").alias("CENTER"), F.col("s_acctbal").alias("CHRONICITY"), F.when(k % 4 > 0, k).alias("DAYS_POST_STROKE"))
    text = F.when(k % 6 == 0, '{"CENTER": ').otherwise(F.to_json(fields))
    return readers.case_metadata(table("supplier").select("s_suppkey", text.alias("text")), "text").drop("text")


@query("SELECT 'p' || o_orderkey AS path, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE round(o_totalprice, 6) END AS dice, o_custkey::DOUBLE AS tp FROM orders WHERE o_orderkey % 5 > 0")
def summary_documents(table):
    """Nested summaries to flat rows: cases without the label go, NaN is NULL."""
    k = F.col("o_orderkey")
    dice = F.when(k % 9 == 0, float("nan")).otherwise(F.col("o_totalprice").cast("double"))
    one = F.create_map(F.when(k % 5 > 0, "1").otherwise("2"), F.struct(dice.alias("Dice"), F.col("o_custkey").cast("double").alias("TP")))
    rows = table("orders").groupBy((k % 6).alias("g")).agg(
        F.collect_list(F.struct(F.concat(F.lit("p"), k).alias("prediction_file"), one.alias("metrics"))).alias("metric_per_case"),
    )
    place = _files(rows, F.concat(F.lit("s"), "g", F.lit(".json")), F.to_json(F.struct("metric_per_case")))
    return readers.summary_rows(rows.sparkSession, place).select("path", "dice", "tp")


@query("SELECT f AS fold, CASE WHEN s_suppkey % 3 = f THEN 'val' ELSE 'train' END AS subset, s_name AS \"case\" FROM supplier, (SELECT unnest([0, 2])::BIGINT AS f)")
def split_documents(table):
    """Folds of a split document, two of three chosen."""
    name, k = F.col("s_name"), F.col("s_suppkey")
    fold = lambda f: F.struct(F.collect_list(F.when(k % 3 != f, name)).alias("train"), F.collect_list(F.when(k % 3 == f, name)).alias("val"))
    rows = table("supplier").agg(F.array(*map(fold, range(3))).alias("folds"))
    place = _files(rows, F.lit("splits.json"), F.to_json("folds"))
    return readers.select_folds(readers.split_document(rows.sparkSession, f"{place}/splits.json"), "0,2", n_folds=3)


# --- folders ----------------------------------------------------------------------------------


def _tree(table):
    """Sites, subjects and sessions as folders; every subject has an image, two of three a mask."""
    k = F.col("s_suppkey")
    folder = F.concat(F.lit("R"), k % 4, F.lit("/sub-"), k, F.lit("/ses-"), k % 2)
    name = F.explode(F.array_compact(F.array(F.lit("a_T1w.nii.gz"), F.when(k % 3 > 0, "a_mask.nii.gz"), F.when(k % 5 == 0, "0_other.nii.gz"))))
    rows = table("supplier").select(folder.alias("folder"), name.alias("name"))
    place = _files(rows, F.concat("folder", F.lit("/"), "name"), F.lit("x"))
    return readers.listing(rows.sparkSession, place, "*.nii.gz")


_ROLES = {"image": r"_T1w\.nii", "mask": r"_mask\.nii"}
_LAST = "regexp_extract(path, '[^/]+$', 0)"


@query("SELECT 'sub-' || s_suppkey AS subject, 'a_T1w.nii.gz' AS image, CASE WHEN s_suppkey % 3 > 0 THEN 'a_mask.nii.gz' END AS mask FROM supplier")
def subject_files(table):
    last = lambda c: F.element_at(F.split(c, "/"), -1).alias(c)
    return readers.subjects(_tree(table), _ROLES).select("subject", last("image"), last("mask"))


@query("SELECT 'R' || s_suppkey % 4 AS site, 'sub-' || s_suppkey AS subject, 'ses-' || s_suppkey % 2 AS session, s_suppkey % 3 > 0 AS has_mask FROM supplier")
def session_files(table):
    return readers.sessions(_tree(table), _ROLES, r"/(R\d+)/").select("site", "subject", "session", F.col("mask").isNotNull().alias("has_mask"))


@query("SELECT 'sub-' || s_suppkey AS subject, CASE WHEN s_suppkey % 3 > 0 THEN 'a_mask.nii.gz' WHEN s_suppkey % 5 = 0 THEN '0_other.nii.gz' ELSE 'a_T1w.nii.gz' END AS name FROM supplier")
def resolved_files(table):
    """The first candidate's file, else the first by path."""
    found = readers.resolve(_tree(table), F.regexp_extract("path", r"/(sub-[^/]+)/", 1), ["b_mask.nii.gz", "a_mask.nii.gz"])
    return found.select("subject", F.expr(_LAST).alias("name"))


@query("SELECT 's' || s_suppkey AS id, unnest(['image', 'label']) AS kind FROM supplier")
def collection_files(table):
    """Files by the first suffix that fits; one path for each id of a kind."""
    name = F.explode(F.array(*(F.concat(F.lit("s"), "s_suppkey", F.lit(s)) for s in ("_0000.nii.gz", ".nii.gz"))))
    rows = table("supplier").select(name.alias("name"))
    files = readers.listing(rows.sparkSession, _files(rows, F.col("name"), F.lit("x")))
    found = readers.collection(files, [("image", "_0000.nii.gz"), ("label", ".nii.gz")])
    ids = readers.unique_paths(found.filter("kind = 'image'").select("path"), F.regexp_extract("path", r"/(s\d+)_0000", 1))
    return found.select("id", "kind").join(ids.select("id"), "id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'sidecar' WHEN s_suppkey % 3 = 0 THEN 'embedded' ELSE 'computed' END AS source FROM supplier")
def tables_by_priority(table):
    """Rows of the first table that has them."""
    rows = table("supplier").select(F.col("s_suppkey").alias("id"))
    part = lambda condition, name: rows.filter(condition).withColumn("source", F.lit(name))
    return readers.by_source_priority([part("id % 2 = 0", "sidecar"), part("id % 3 = 0", "embedded"), part("true", "computed")], "id")
