"""More queries over tables: joins with fallbacks, contamination, picks, folds, labels, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, ranking, relational, reports, selection, splits
from .catalog import query


@query(
    """SELECT c_custkey, coalesce(l.price, c_acctbal) AS c_acctbal, coalesce(l.status, c_mktsegment) AS c_mktsegment FROM (SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer) LEFT JOIN (SELECT o_custkey AS c_custkey, round(max(o_totalprice), 6) AS price, max(o_orderstatus) AS status FROM orders WHERE o_totalprice > 200000 GROUP BY 1) l USING (c_custkey)"""
)
def join_with_fallback(table):
    right = table("orders").filter("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal"), F.max("o_orderstatus").alias("c_mktsegment"),
    )
    return relational.with_fallback(
        table("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), right, ["c_custkey"], ["c_acctbal", "c_mktsegment"],
    )


@query("""WITH d AS (SELECT doc_id, sha256(text) AS sha, substr(text, 1, 40) AS head, CAST(n_chars AS VARCHAR) || source AS place FROM documents), a AS (SELECT * FROM d WHERE doc_id % 2 = 0), b AS (SELECT * FROM d WHERE doc_id % 2 = 1)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, 'sha' AS reason FROM a JOIN b ON a.sha = b.sha UNION SELECT a.doc_id, b.doc_id, 'head' FROM a JOIN b ON a.head = b.head UNION SELECT a.doc_id, b.doc_id, 'place' FROM a JOIN b ON a.place = b.place""")
def contamination_any_key(table):
    """Documents with even ids play the pseudo-labelled set, those with odd ids the labelled one."""
    rows = table("documents").select(
        "doc_id", F.sha2("text", 256).alias("sha"), F.substring("text", 1, 40).alias("head"),
        F.concat(F.col("n_chars").cast("string"), "source").alias("place"),
    )
    return relational.any_key_matches(
        rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), ["sha", "head", "place"], "doc_id", "doc_id",
    )


@query(
    """SELECT CAST(k AS BIGINT) AS fold, c_custkey FROM (SELECT c_custkey, c_nationkey % 3 AS held FROM customer), (SELECT DISTINCT c_nationkey % 3 AS k FROM customer) WHERE held <> k"""
)
def fold_complement(table):
    held = table("customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("fold"))
    return relational.complement(held, held, "c_custkey", "fold").select("fold", "c_custkey")


@query(
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars, CASE WHEN i < 3 THEN 'worst' WHEN i >= n // 2 - 1 AND i < n // 2 + 1 THEN 'middle' ELSE 'best' END AS role FROM r WHERE i < 3 OR (i >= n // 2 - 1 AND i < n // 2 + 1) OR i >= n - 2"""
)
def representative_cases(table):
    return ranking.representative(table("documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("""WITH r AS (SELECT doc_id, (rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0) / count(*) OVER () AS pct FROM documents), q AS (SELECT * FROM (VALUES (0.25), (0.5), (0.75), (0.95)) t(quantile))
SELECT CAST(quantile AS DOUBLE) AS quantile, doc_id, round(pct, 6) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY quantile ORDER BY abs(pct - quantile), doc_id) AS k FROM r, q) WHERE k = 1""")
def quantile_cases(table):
    return ranking.quantile_nearest(table("documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("quantile", "doc_id", "pct")


@query(
    """SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i FROM documents) WHERE i % 50 = 0"""
)
def size_ranked_cases(table):
    return ranking.every_kth(table("documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 50)


@query(
    """SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3"""
)
def top_orders(table):
    return ranking.top_per_group(
        table("orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3,
    ).select("o_orderpriority", "o_orderkey")


@query(
    """WITH g AS (SELECT source AS held FROM documents GROUP BY 1 HAVING count(*) >= 5) SELECT held, CASE WHEN source = held THEN 'val' ELSE 'train' END AS subset, count(*) AS n FROM documents, g GROUP BY ALL"""
)
def leave_group_out(table):
    return splits.leave_group_out(table("documents"), "doc_id", "source", 5).groupBy("held", "subset").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT c_nationkey % 5 AS fold, count(*) AS n, sum(round(c_acctbal * 100)) / 100 AS balance FROM customer GROUP BY 1) SELECT CAST(fold AS BIGINT) AS fold, round(CAST(n AS DOUBLE), 6) AS n, round(balance, 6) AS balance, round(n - avg(n) OVER (), 6) AS n_deviation, round(balance - avg(balance) OVER (), 6) AS balance_deviation FROM f"""
)
def fold_loads(table):
    rows = table("customer").withColumn("fold", (F.col("c_nationkey") % 5).cast("bigint"))
    return splits.fold_summary(rows, "fold", {"n": F.count("*"), "balance": F.sum(F.round(F.col("c_acctbal") * 100)) / 100})


@query(
    """WITH f AS (SELECT c_nationkey % 5 AS fold, CAST(count(*) AS DOUBLE) AS load FROM customer GROUP BY 1) SELECT round(sum(load) / 5, 6) AS target, round(min(load), 6) AS min, round(max(load), 6) AS max, round(max(load) - min(load), 6) AS range, round(stddev_pop(load) / avg(load), 6) AS cv FROM f"""
)
def fold_distribution(table):
    return reports.distribution(table("customer").withColumn("fold", F.col("c_nationkey") % 5), "fold", F.lit(1), 5)


@query(
    """SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT CAST(round(l_quantity / 10) AS INT))), ',') AS labels FROM lineitem GROUP BY 1"""
)
def label_sets(table):
    return reports.label_set(table("lineitem").withColumn("q", F.col("l_quantity") / 10), ["l_returnflag"], "q")


@query("""WITH p AS (SELECT event_type, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1), j AS (SELECT event_type AS arm, v, n, CASE WHEN v <= 60 THEN 'mean too low' END AS a, CASE WHEN n < 500 THEN 'too few' END AS b FROM p), d AS (SELECT arm, concat_ws('; ', a, b) AS reasons, CASE WHEN a IS NULL AND b IS NULL THEN 'ADOPT' ELSE 'REJECT' END AS decision, n FROM j)
SELECT arm, decision, reasons, decision = 'ADOPT' AND row_number() OVER (PARTITION BY decision ORDER BY n, arm) = 1 AS chosen FROM d""")
def arm_decision(table):
    arms = table("events").groupBy(F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 6).alias("v"), F.count("*").alias("n"))
    rules = [("mean too low", F.col("v") > 60), ("too few", F.col("n") >= 500)]
    return selection.decide(arms, "arm", rules, "n").select("arm", "decision", "reasons", "chosen")


@query("""WITH s AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL), c AS (SELECT * FROM (VALUES ('pair', 'click'), ('pair', 'view'), ('single', 'view')) t(candidate, event_type)), j AS (SELECT candidate, user_id, avg(v) AS v, count(*) AS n FROM s JOIN c USING (event_type) GROUP BY ALL)
SELECT candidate, count(*) AS n, round(avg(round(v, 6)), 6) AS mean FROM j JOIN (SELECT candidate, count(*) AS k FROM c GROUP BY 1) USING (candidate) WHERE n = k GROUP BY 1""")
def candidate_means(table):
    scores = table("events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    members = scores.sparkSession.createDataFrame(
        [("pair", "click"), ("pair", "view"), ("single", "view")], "candidate string, event_type string",
    )
    means = ensemble.candidate_scores(scores, members, "user_id", "event_type", "v").withColumn("v", F.round("v", 6))
    return means.groupBy("candidate").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


@query(
    """WITH a AS (SELECT l_returnflag, round(avg(l_tax), 6) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag, round(avg(l_tax), 6) AS v FROM lineitem WHERE l_linenumber < 7 GROUP BY 1) SELECT a.l_returnflag, a.v, abs(a.v - b.v) <= 1e-6 AS reproduced FROM a JOIN b USING (l_returnflag)"""
)
def reproduced_summary(table):
    mean = lambda t: t.groupBy("l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("v"))
    a, b = mean(table("lineitem")), mean(table("lineitem").filter("l_linenumber < 7"))
    off = selection.reproduces(a, b, ["l_returnflag"], "v").select("l_returnflag", F.lit(False).alias("reproduced"))
    return a.join(off, "l_returnflag", "left").select("l_returnflag", "v", F.coalesce("reproduced", F.lit(True)).alias("reproduced"))


@query(
    """WITH a AS (SELECT doc_id, toxic FROM labels), m AS (SELECT avg(abs(quality - toxic)) AS x, max(abs(quality - toxic)) AS y, count(*) AS n FROM labels) SELECT n, round(x, 6) AS mean_abs, round(CAST(y AS DOUBLE), 6) AS max_abs, round((SELECT avg(100.0 * (toxic - quality) / nullif(quality, 0)) FROM labels), 6) AS mean_change_percent FROM m"""
)
def stored_deployed_agreement(table):
    rows = table("labels").select(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return ensemble.agreement(rows, "quality", "toxic")


@query("""WITH e AS (SELECT user_id % 5 AS fold, hour(ts) < 12 AS small, event_type AS config, value FROM events), g AS (SELECT fold, small, config, sum(value) AS s, count(*) AS n FROM e GROUP BY ALL),
o AS (SELECT *, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS outside FROM g WINDOW w AS (PARTITION BY small, config)), r AS (SELECT *, row_number() OVER (PARTITION BY fold, small ORDER BY outside DESC NULLS LAST, config) AS k FROM o)
SELECT fold, a.config AS below, b.config AS above FROM (SELECT fold, config FROM r WHERE k = 1 AND small) a FULL JOIN (SELECT fold, config FROM r WHERE k = 1 AND NOT small) b USING (fold)""")
def size_policy(table):
    """For each fold, the best configurations of small and of large cases outside it."""
    rows = table("events").select((F.col("user_id") % 5).alias("fold"), F.hour("ts").alias("size"), F.col("event_type").alias("config"), "value")
    return selection.best_below_and_above(rows, "fold", "size", 12, "config", "value")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders))")
def common_customers(table):
    """Orders of the customers that every priority has."""
    return relational.common_subjects(table("orders"), "o_custkey", "o_orderpriority").select("o_custkey", "o_orderkey")


@query("SELECT user_id, round(CAST(sum(value * w) / sum(w) AS DOUBLE), 6) AS value, count(*) AS n_members FROM (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY ALL) JOIN (SELECT unnest(['click', 'view', 'error']) AS event_type, unnest([2.0, 1.0, 0.5]) AS w) USING (event_type) GROUP BY 1")
def parsed_weights(table):
    """Weights from texts; a member of weight 0 takes no part."""
    weights = ensemble.parse_weights(["click=2", "view=1", "error=0.5", "signup=0"])
    rows = table("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    return ensemble.weighted_average(rows, ["user_id"], "event_type", "value", weights)
