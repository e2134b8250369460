"""All registered queries of the library, each with its SQL equivalent for DuckDB.

Every query returns bigints, doubles rounded to six places, strings and
booleans, so that values do not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ensemble, graph, leakage, metrics, provenance, ranking, relational, reports, selection, splits
from ..sources import readers
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader, under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint"}
    return df.select(*(F.round(n, 6).alias(n) if t == "double" else F.col(n).cast(kinds.get(t, t)).alias(n) if t in kinds else F.col(n) for n, t in df.dtypes))


_METRICS = """CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS dice,
 CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END AS iou,
 CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tn AS DOUBLE) / nullif(tn + fn, 0) AS npv"""
_ROUND = "round(dice, 6) AS dice, round(iou, 6) AS iou, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(npv, 6) AS npv"
_COUNTS = "count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn"


# --- overlap metrics and summaries --------------------------------------------------------------


@query(f"""WITH c AS (SELECT lang, source, {_COUNTS} FROM (SELECT lang, source, quality = 1 AS t, toxic = 1 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY ALL),
m AS (SELECT *, {_METRICS} FROM c) SELECT lang, source, tp, fp, fn, tn, {_ROUND} FROM m""")
def confusion_by_source(table):
    rows = relational.matched(table("labels"), table("documents").select("doc_id", "lang", "source"), ["doc_id"])
    return metrics.confusion(
        rows, ["lang", "source"], F.col("quality") == 1, F.col("toxic") == 1,
    ).select("lang", "source", "tp", "fp", "fn", "tn", *metrics.overlap())


@query("""WITH l AS (UNPIVOT (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value)
SELECT l_returnflag, metric, count(value) AS n_valid, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM l GROUP BY ALL""")
def metric_summary_long(table):
    return reports.summarise(table("lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""WITH d AS (SELECT coalesce(nullif(trim(o_orderstatus), ''), 'unknown') AS status, coalesce(nullif(trim(c_mktsegment), ''), 'unknown') AS segment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(segment) = 0 THEN 'segment' ELSE 'all' END AS dim, coalesce(status, segment, 'all') AS stratum, count(*) AS n, count(o_totalprice) AS n_valid, round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(stddev_pop(o_totalprice), 6) AS std
FROM d GROUP BY GROUPING SETS ((status), (segment), ())""")
def strata_grouping_sets(table):
    rows = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        S.category("o_orderstatus").alias("status"), S.category("c_mktsegment").alias("segment"), "o_totalprice",
    )
    return reports.strata(rows, ["status", "segment"], [F.count("*").alias("n"), *reports.six("o_totalprice")[:4]])


@query("""WITH b(bin_order, size_bin, lo, hi) AS (VALUES (0, 'below 10', 0, 10), (1, '10 to 25', 10, 25), (2, '25 to 45', 25, 45), (3, '45 to 90', 45, 90), (4, 'from 90', 90, 1e12))
SELECT CAST(bin_order AS BIGINT) AS bin_order, size_bin, count(l_quantity) AS n_gt, count(*) FILTER (WHERE l_returnflag = 'R') AS n_detected, round(count(*) FILTER (WHERE l_returnflag = 'R') / CAST(nullif(count(l_quantity), 0) AS DOUBLE), 6) AS recall
FROM b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY ALL""")
def pooled_bin_recall(table):
    bins = (("below 10", 0, 10), ("10 to 25", 10, 25), ("25 to 45", 25, 45), ("45 to 90", 45, 90), ("from 90", 90, None))
    return reports.pooled_bins(table("lineitem"), S.range_bin("l_quantity", bins), F.col("l_returnflag") == "R", bins)


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(abs(total - o_totalprice), 6) AS abs_diff, round(total - o_totalprice, 6) AS signed_diff, round(CASE WHEN o_totalprice > 0 THEN abs(total - o_totalprice) / o_totalprice END, 6) AS relative_diff FROM (SELECT l_orderkey, round(total, 4) AS total FROM s) JOIN orders ON o_orderkey = l_orderkey""")
def volume_diff(table):
    totals = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 4).alias("total"))
    return totals.join(table("orders"), "o_orderkey").select(
        "o_orderkey", *metrics.volume_difference(F.col("total"), F.col("o_totalprice")),
    )


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS cell FROM events), t AS (SELECT event_id, cell, CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 13 = 0 THEN ' ' || cell || ' ' ELSE cell END AS raw FROM e)
SELECT event_id, CASE WHEN lower(trim(raw)) IN ('', 'na', 'n/a', 'nan', 'none', 'null') THEN NULL ELSE round(TRY_CAST(trim(raw) AS DOUBLE), 6) END AS number, CASE WHEN trim(raw) IN ('1') THEN true WHEN trim(raw) IN ('0') THEN false END AS flag, CASE WHEN trim(raw) IS NULL OR trim(raw) = '' THEN 'unknown' ELSE trim(raw) END AS category FROM t""")
def clean_parse(table):
    cell = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 7 == 0, "N/A").when(F.col("event_id") % 11 == 0, "NaN").when(
        F.col("event_id") % 13 == 0, F.concat(F.lit(" "), cell, F.lit(" ")),
    ).otherwise(cell)
    return table("events").select("event_id", raw.alias("raw")).select(
        "event_id", S.parse_float("raw").alias("number"), S.parse_bool("raw").alias("flag"), S.category("raw").alias("category"),
    )


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(min(l_extendedprice), 6) AS min, """ + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{round(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + """, round(max(l_extendedprice), 6) AS max, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std FROM lineitem GROUP BY 1""")
def numeric_profile(table):
    return reports.profile(table("lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""SELECT n_name, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.95), 6) AS p95, count(*) FILTER (WHERE l_discount = 0) AS n_empty, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS share
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 100""")
def site_rollup(table):
    rows = table("lineitem").join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        table("nation"), F.col("s_nationkey") == F.col("n_nationkey"),
    )
    return reports.rollup(rows, ["n_name"], "l_quantity", F.col("l_discount") == 0, F.col("l_returnflag") == "R", 100)


@query("""SELECT 'brand' AS what, value, n FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
UNION ALL SELECT 'source', value, n FROM (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) UNION ALL SELECT 'distinct brands', NULL, count(DISTINCT p_brand) FROM part""")
def value_counts_top(table):
    top = lambda t, c, what: reports.value_counts(table(t), c, 10).select(F.lit(what).alias("what"), "value", "n")
    brands = table("part").agg(F.count_distinct("p_brand").alias("n")).select(
        F.lit("distinct brands").alias("what"), F.lit(None).cast("string").alias("value"), "n",
    )
    return top("part", "p_brand", "brand").unionByName(top("documents", "source", "source")).unionByName(brands)


@query(
    """SELECT count(*) FILTER (WHERE quality IS NULL) AS n_unlabelled, count(*) FILTER (WHERE n_chars < 200) AS n_short, count(*) FILTER (WHERE n_chars > 20000) AS n_long, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS n_empty, count(*) FILTER (WHERE length(text) <> n_chars) AS n_mismatch, count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id)"""
)
def sanity_flags(table):
    rows = table("documents").join(table("labels"), "doc_id", "left")
    return reports.flags(
        rows,
        {
            "n_unlabelled": F.col("quality").isNull(), "n_short": F.col("n_chars") < 200, "n_long": F.col("n_chars") > 20000,
            "n_empty": F.col("text").isNull() | (F.trim("text") == ""), "n_mismatch": F.length("text") != F.col("n_chars"),
            "n_toxic": F.col("toxic") == 1,
        },
    )


# --- sweeps, ranks, curves ----------------------------------------------------------------------

_SWEEP = f"""WITH s AS (SELECT user_id % 3 AS arm, event_type = 'purchase' AS t, value / 600.0 AS s FROM events), g AS (SELECT k / 20.0 AS threshold FROM range(1, 20) r(k)),
c AS (SELECT arm, threshold, {_COUNTS} FROM (SELECT arm, threshold, t, floor(s * 20 + 1e-9) / 20.0 >= threshold AS p FROM s, g) GROUP BY ALL), m AS (SELECT *, {_METRICS} FROM c)
SELECT arm, round(threshold, 6) AS threshold, tp, fp, fn, tn, {_ROUND}, round(coalesce(2 * coalesce(precision, 0) * coalesce(sensitivity, 0) / nullif(coalesce(precision, 0) + coalesce(sensitivity, 0), 0), 0), 6) AS hmean FROM m"""


def _scored(table):
    return table("events").select(
        "event_id", "user_id", (F.col("user_id") % 3).alias("arm"), (F.col("event_type") == "purchase").alias("truth"),
        (F.col("value") / 600.0).alias("score"),
    )


def _swept(counts):
    return counts.select("arm", "threshold", "tp", "fp", "fn", "tn", *metrics.overlap()).withColumn(
        "hmean", S.harmonic(F.coalesce("precision", F.lit(0.0)), F.coalesce("sensitivity", F.lit(0.0))),
    )


@query(_SWEEP)
def threshold_sweep(table):
    rows = _scored(table).withColumn("score", F.floor(F.col("score") * 20 + 1e-9) / 20.0)
    return _swept(metrics.sweep_at(rows, ["arm"], "score", F.col("truth"), [r[0] for r in readers.grid(rows.sparkSession, "0.05:0.95:0.05").collect()]))


@query(_SWEEP)
def threshold_sweep_cumulative(table):
    return _swept(metrics.sweep(_scored(table), ["arm"], "score", F.col("truth"), 19))


_LONG = """l AS (SELECT p_brand AS subject, n_name AS config, avg(l_extendedprice) AS price, avg(l_discount) AS discount, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
u AS (SELECT subject, config, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT subject, config, CAST(price AS DOUBLE) AS price, CAST(discount AS DOUBLE) AS discount, CAST(quantity AS DOUBLE) AS quantity FROM l) ON price, discount, quantity INTO NAME metric VALUE value)),
w AS (SELECT u.* FROM u WHERE subject IN (SELECT subject FROM u GROUP BY 1 HAVING count(DISTINCT config) = (SELECT count(DISTINCT config) FROM u)))"""


def _configs(table):
    """Brand as subject, the supplier's nation as configuration, three metrics; subjects that all configurations have."""
    rows = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey")).join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        table("nation"), F.col("s_nationkey") == F.col("n_nationkey"),
    )
    wide = rows.groupBy(F.col("p_brand").alias("subject"), F.col("n_name").alias("config")).agg(
        F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.sum("l_quantity").alias("quantity"),
    )
    return relational.common_subjects(
        reports.to_long(wide, ["subject", "config"], ["price", "discount", "quantity"]).withColumn("value", F.round("value", 6)), "subject",
        "config",
    )


@query(f"""WITH {_LONG}, k AS (SELECT *, CASE WHEN metric = 'discount' THEN value ELSE -value END AS key FROM w),
r AS (SELECT config, metric, rank() OVER (PARTITION BY subject, metric ORDER BY key) + (count(*) OVER (PARTITION BY subject, metric, key) - 1) / 2.0 AS rank FROM k),
m AS (SELECT config, metric, avg(rank) AS rank FROM r GROUP BY ALL) SELECT config, round(avg(rank), 6) AS mean_rank, count(*) AS n_metrics FROM m GROUP BY 1""")
def rank_aggregate(table):
    return ranking.rank_aggregate(_configs(table), "subject", "config", ["price", "quantity"])


@query(f"""WITH {_LONG}, k AS (SELECT config, metric, round(avg(value), 6) AS value FROM w GROUP BY ALL), j AS (SELECT *, CASE WHEN metric = 'discount' THEN value ELSE -value END AS key FROM k),
r AS (SELECT config, rank() OVER (PARTITION BY metric ORDER BY key) + (count(*) OVER (PARTITION BY metric, key) - 1) / 2.0 AS rank FROM j) SELECT config, round(avg(rank), 6) AS mean_rank FROM r GROUP BY 1""")
def rank_of_means(table):
    means = _configs(table).groupBy("config", "metric").agg(F.round(F.avg("value"), 6).alias("value"))
    return ranking.rank_of_means(means, "config", ["price", "quantity"])


@query(f"""WITH {_LONG}, z AS (SELECT subject, config, CASE WHEN stddev_pop(value) OVER g < 1e-12 THEN 0 ELSE (value - avg(value) OVER g) / nullif(stddev_pop(value) OVER g, 0) END * CASE WHEN metric = 'discount' THEN -1 ELSE 1 END AS z FROM w WINDOW g AS (PARTITION BY subject, metric)),
s AS (SELECT subject, config, round(sum(z), 6) AS score FROM z GROUP BY ALL) SELECT subject, config, score FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, config) AS n FROM s) WHERE n = 1""")
def scalarise_best_config(table):
    scores = ranking.scalarise(_configs(table), "subject", "config", ["price", "quantity"]).withColumn("score", F.round("score", 6))
    return ranking.best_row(scores, ["subject"], [F.col("score").desc(), F.col("config")]).select("subject", "config", "score")


@query("""WITH b AS (SELECT lang, n_chars AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM b GROUP BY ALL),
w AS (SELECT lang, s, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY lang) AS np, count(*) OVER (PARTITION BY lang) AS levels FROM g WINDOW o AS (PARTITION BY lang ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT lang, s, np, levels, CAST(tp AS DOUBLE) / (tp + fp) AS pr, CAST(tp AS DOUBLE) / nullif(np, 0) AS rc FROM w),
l AS (SELECT lang, np, levels, (rc - coalesce(lag(rc) OVER o, 0.0)) * (pr + coalesce(lag(pr) OVER o, 1.0)) / 2 AS area FROM r WINDOW o AS (PARTITION BY lang ORDER BY s DESC))
SELECT lang, round(CASE WHEN max(np) = 0 THEN CASE WHEN max(levels) = 1 THEN 1.0 ELSE 0.0 END ELSE sum(area) END, 6) AS pr_auc FROM l GROUP BY 1""")
def pr_auc(table):
    rows = table("documents").select("doc_id", "lang", "n_chars").join(table("labels"), "doc_id")
    return metrics.pr_auc(rows, ["lang"], "n_chars", F.col("quality") == 1)


# --- paired statistics and selection ------------------------------------------------------------

_PAIRS = "p AS (SELECT user_id, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL)"


def _pairs(table):
    return relational.paired(
        table("events"), "user_id", "event_type", "value", "view", "click",
    ).withColumns({"a": F.round("a", 6), "b": F.round("b", 6)})


@query(f"""WITH {_PAIRS}, d AS (SELECT user_id, round(b - a, 6) AS d FROM p), s AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd, sum(d) AS total, count(*) FILTER (WHERE d > 0) AS better, count(*) FILTER (WHERE d < 0) AS worse, count(*) FILTER (WHERE d = 0) AS unchanged FROM d), t AS (SELECT user_id, d FROM d ORDER BY abs(d) DESC, user_id LIMIT 1)
SELECT n, round(m, 6) AS mean_diff, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, round(CASE WHEN sd = 0 THEN 0 ELSE m / (sd / sqrt(n)) END, 6) AS t, better, worse, unchanged, user_id AS most_influential, round((total - d) / (n - 1), 6) AS mean_without FROM s, t""")
def paired_delta(table):
    return selection.paired_statistics(
        _pairs(table).select("user_id", F.lit(0.0).alias("a"), F.round(F.col("b") - F.col("a"), 6).alias("b")), [], "user_id",
    )


_MODELS = "m AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


def _models(table):
    return table("events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))


@query(f"""WITH {_MODELS}, j AS (SELECT a.event_type AS first, b.event_type AS second, a.v AS x, b.v AS y FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type < b.event_type)
SELECT first, second, round(avg(CASE WHEN x > y THEN 1.0 ELSE 0.0 END), 6) AS p_first_better, round(avg(abs(x - y)), 6) AS mean_abs_diff, round(CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 6) AS r, count(*) AS n FROM j GROUP BY ALL""")
def pairwise_complementarity(table):
    return selection.complementarity(_models(table), "user_id", "event_type", "v")


@query(f"""WITH {_MODELS}, o AS (SELECT avg(x) AS oracle FROM (SELECT user_id, max(v) AS x FROM m GROUP BY 1)), b AS (SELECT event_type, avg(v) AS mean FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT round(oracle, 6) AS oracle, event_type AS best_single, round(mean, 6) AS best_mean, round(oracle - mean, 6) AS headroom FROM o, b""")
def oracle_headroom(table):
    return selection.oracle(_models(table), "user_id", "event_type", "v")


@query("""WITH d AS (SELECT s_nationkey AS case_id, p_brand AS cell, round(avg(l_quantity), 6) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
o AS (SELECT case_id, cell, v, round((sum(v) OVER w - v) / nullif(count(*) OVER w - 1, 0), 6) AS mean_of_others FROM d WINDOW w AS (PARTITION BY cell))
SELECT CAST(case_id AS BIGINT) AS case_id, cell, v, mean_of_others FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY mean_of_others DESC NULLS LAST, cell) AS n FROM o) WHERE n = 1""")
def loo_selection(table):
    rows = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey")).join(
        table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"),
    )
    cells = rows.groupBy(
        F.col("s_nationkey").alias("case_id"), F.col("p_brand").alias("cell"),
    ).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return selection.leave_one_out(cells, "case_id", "cell", "v").select("case_id", "cell", "v", "mean_of_others")


@query("""WITH f AS (SELECT user_id % 5 AS fold, event_type AS config, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL),
o AS (SELECT fold, config, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS outside, s / n AS inside FROM f WINDOW w AS (PARTITION BY config))
SELECT fold, config, round(outside, 6) AS outside, round(inside, 6) AS inside FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY outside DESC, config) AS k FROM o) WHERE k = 1""")
def nested_selection(table):
    return selection.nested(
        table("events").withColumn("fold", F.col("user_id") % 5), "fold", "event_type", "value",
    ).withColumnRenamed("event_type", "config")


@query(
    f"""WITH a AS (SELECT *, sensitivity >= 0.5 AS ok FROM ({_SWEEP})) SELECT arm, round(threshold, 6) AS threshold, dice, sensitivity, NOT (SELECT max(ok) FROM a) AS relaxed FROM a WHERE ok OR NOT (SELECT max(ok) FROM a) ORDER BY dice DESC, threshold, arm LIMIT 1"""
)
def constrained_argmax(table):
    rows = plain(_swept(metrics.sweep(_scored(table), ["arm"], "score", F.col("truth"), 19)))
    return ranking.constrained_best(
        rows, F.col("sensitivity") >= 0.5, [F.col("dice").desc(), F.col("threshold"), F.col("arm")],
    ).select("arm", "threshold", "dice", "sensitivity", "relaxed")


@query(f"""WITH {_MODELS}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM m), p AS (SELECT avg(v) AS policy FROM h WHERE n = 1), f AS (SELECT avg(v) AS fixed FROM m WHERE event_type = 'view'), o AS (SELECT avg(x) AS oracle FROM (SELECT max(v) AS x FROM m GROUP BY user_id))
SELECT round(policy, 6) AS policy, round(fixed, 6) AS fixed, round(oracle, 6) AS oracle, round((policy - fixed) / nullif(oracle - fixed, 0), 6) AS headroom_taken FROM p, f, o""")
def policy_headroom(table):
    rows = _models(table)
    chosen = ranking.best_row(rows, ["user_id"], [F.col("event_type")])
    return selection.policy(rows, chosen, "user_id", "event_type", "v", "view")


# --- integrity ----------------------------------------------------------------------------------

_FOLDED = "f AS (SELECT c_custkey, n_name, crc AS fold FROM (SELECT c_custkey, n_name, n_nationkey % 5 AS crc FROM customer JOIN nation ON c_nationkey = n_nationkey))"


@query(f"""WITH {_FOLDED}, b AS (SELECT fold, CASE WHEN c_custkey % 97 = 0 THEN (fold + 1) % 5 ELSE fold END AS held, c_custkey, n_name FROM f)
SELECT 'center leak' AS kind, CAST(held AS BIGINT) AS fold, n_name AS item FROM (SELECT k.held, b.n_name FROM (SELECT DISTINCT held FROM b) k, b GROUP BY ALL HAVING count(*) FILTER (WHERE b.held = k.held) > 0 AND count(*) FILTER (WHERE b.held <> k.held) > 0)""")
def group_fold_certificate(table):
    """Customers whose key divides by 97 are put into the wrong fold: each leaks its nation into two."""
    cases = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name", (F.col("n_nationkey") % 5).alias("fold"),
    )
    held = cases.withColumn("held", F.when(F.col("c_custkey") % 97 == 0, (F.col("fold") + 1) % 5).otherwise(F.col("fold")))
    folds = held.select(F.col("held").alias("k")).distinct()
    rows = held.crossJoin(F.broadcast(folds)).select(
        F.col("k").alias("fold"), F.when(F.col("held") == F.col("k"), "val").otherwise("train").alias("subset"), "c_custkey",
    )
    return relational.split_violations(rows, cases, "c_custkey", "n_name")


@query("SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def leakage_check(table):
    return leakage.contained(table("documents"), table("benchmark"), "doc_id", "item_id")


@query(
    """SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, substr(sha256(text), 1, 16) AS prefix FROM documents GROUP BY text HAVING count(*) > 1"""
)
def duplicate_hash_groups(table):
    return table("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").select(
        "sha", "n", "first_id", F.substring("sha", 1, 16).alias("prefix"),
    )


@query(
    """SELECT doc_id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def set_reconcile(table):
    return relational.reconcile(table("documents"), table("labels"), ["doc_id"])


@query(
    """WITH h AS (SELECT doc_id, lang, source, sha256('7:' || doc_id) AS h FROM documents) SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) - 1) % 5 AS BIGINT) AS place FROM h"""
)
def stratified_round_robin(table):
    dealt = ranking.round_robin(table("documents"), ["lang"], "doc_id", 5, seed=7)
    offset = F.pmod(F.crc32(F.concat_ws(":", F.lit("7"), "lang")), F.lit(5))
    return dealt.select("doc_id", "lang", F.pmod(F.col("fold") - offset, F.lit(5)).cast("bigint").alias("place"))


@query(
    """WITH h AS (SELECT doc_id, source, sha256('3:' || doc_id) AS h FROM documents) SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS n FROM h) WHERE n <= 3"""
)
def stratified_sample(table):
    return ranking.stratified_sample(table("documents"), ["source"], "doc_id", 3, seed=3).select("source", "doc_id")


@query(
    """SELECT round(avg(l_extendedprice), 6) AS pooled, (SELECT round(avg(m), 6) FROM (SELECT avg(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey)) AS macro, count(l_extendedprice) AS n_rows, count(DISTINCT l_suppkey) AS n_groups FROM lineitem"""
)
def case_pooled_vs_macro(table):
    return reports.pooled_and_macro(table("lineitem"), "l_suppkey", "l_extendedprice")


@query("""WITH u AS (UNPIVOT (SELECT l_linestatus || l_returnflag AS method, CAST(l_quantity AS DOUBLE) AS l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value), s AS (SELECT method, metric, avg(value) AS mean FROM u GROUP BY ALL)
SELECT method, round(max(mean) FILTER (WHERE metric = 'l_quantity'), 6) AS l_quantity, round(max(mean) FILTER (WHERE metric = 'l_discount'), 6) AS l_discount, round(max(mean) FILTER (WHERE metric = 'l_tax'), 6) AS l_tax FROM s GROUP BY 1""")
def leaderboard_pivot(table):
    rows = table("lineitem").withColumn("method", F.concat("l_linestatus", "l_returnflag"))
    return reports.leaderboard(
        reports.means(rows, ["method"], ["l_quantity", "l_discount", "l_tax"]), "method", ["l_quantity", "l_discount", "l_tax"],
        "l_quantity",
    )


@query(
    """SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS n FROM conversations) WHERE n = 1"""
)
def dedupe_priority(table):
    order = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    return relational.first_by_priority(table("conversations"), ["conv_id"], [order, F.col("turn")]).select(
        "conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"),
    )


@query("""WITH d AS (SELECT text, count(*) AS n FROM documents GROUP BY 1), h AS (SELECT n, sha256(text || ',' || n) AS h FROM d), l AS (SELECT substr(h, 1, 2) AS leaf, count(*) AS n, sum(n) AS bytes, sha256(string_agg(h, '' ORDER BY h)) AS s FROM h GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(s, '' ORDER BY leaf)) AS content_sha256 FROM l""")
def inventory_counts(table):
    rows = table("documents").groupBy("text").agg(F.count("*").alias("n"))
    return relational.certificate(rows, [], ["text", "n"], "n")


# --- ensembles ----------------------------------------------------------------------------------

_WEIGHTS = {str(k): float(k % 4) for k in range(10)}


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS p, CAST(label % 4 AS DOUBLE) AS w FROM embeddings)
SELECT i, round(sum(p * w) / sum(w), 6) AS p, count(*) AS n_members FROM e WHERE w > 0 GROUP BY 1""")
def weighted_ensemble(table):
    rows = table("embeddings").select("label", F.posexplode("embedding").alias("i", "p")).withColumn("p", F.col("p").cast("double"))
    return ensemble.weighted_average(rows, ["i"], "label", "p", _WEIGHTS)


@query("""WITH s AS (SELECT doc_id, least(n_chars / 10000.0, 1.0) AS a, CAST(quality AS DOUBLE) AS b, toxic FROM documents JOIN labels USING (doc_id)), g AS (SELECT w / 10.0 AS w FROM range(0, 11, 2) r(w)), c AS (SELECT w, round(avg(abs(w * a + (1 - w) * b - toxic)), 9) AS err FROM s, g GROUP BY 1)
SELECT round(w, 6) AS w, round(err, 6) AS err, err = (SELECT min(err) FROM c) AS is_best FROM c""")
def blend_grid(table):
    rows = table("documents").join(table("labels"), "doc_id")
    weights = [r[0] for r in readers.grid(rows.sparkSession, "0:1:0.2", "w").collect()]
    a, b = F.least(F.col("n_chars") / 10000.0, F.lit(1.0)), F.col("quality").cast("double")
    mixed = ensemble.blends(rows, a, b, weights)
    errors = mixed.groupBy("w").agg(F.round(F.avg(F.abs(F.col("p") - F.col("toxic"))), 9).alias("err"))
    best = ensemble.best_cells(errors.withColumn("family", F.lit("all")).withColumn("score", -F.col("err")), "family", "score", ["w"])
    return errors.crossJoin(best.select(F.col("err").alias("__e"))).select("w", "err", (F.col("err") == F.col("__e")).alias("is_best"))


# --- provenance and graphs ----------------------------------------------------------------------


@query("""WITH l AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 43200 THEN 1 ELSE 0 END AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM l)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n, array_to_string(list_slice(list(event_type ORDER BY ts, event_id), -3, -1), ',') AS last_values FROM s GROUP BY 1, 2""")
def gap_sessions(table):
    marked = provenance.gap_sessions(table("events"), ["user_id"], "ts", ["event_id"], 43200)
    return provenance.session_summary(
        marked, ["user_id"], "ts", 3, "event_type", "event_id",
    ).withColumn("last_values", F.array_join("last_values", ","))


@query(r"""WITH t AS (SELECT conv_id, turn, lower(text) AS x FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(x, '\b(correct|fix|invalidate|retract|repair|restore|regression)\w*') THEN 'correction' WHEN regexp_matches(x, '\b(abandon|fail|negative|no gain|regress|worse)\w*') THEN 'negative' WHEN regexp_matches(x, '\b(adopt|choose|deprecat|drop|replace|retire|select|ship|stop|switch)\w*') THEN 'decision' WHEN regexp_matches(x, '\b(benchmark|complete|done|eval|result|score|summary|win)\w*') THEN 'result' ELSE 'artifact' END AS kind,
len(list_filter(list_distinct(string_split(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) > 2 AND w NOT IN ('add', 'after', 'and', 'before', 'for', 'from', 'into', 'latest', 'more', 'next', 'run', 'the', 'this', 'update', 'with'))) AS n_words FROM t""")
def classify_text_rules(table):
    return table("conversations").select(
        "conv_id", "turn", S.classify("text").alias("kind"), F.size(S.subject_words("text")).cast("bigint").alias("n_words"),
    )


@query(
    """WITH e AS (SELECT conv_id, turn AS source, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) SELECT conv_id, source, target, target - source AS step FROM e WHERE target IS NOT NULL"""
)
def graph_integrity(table):
    """Edges from each turn to the next one, as far as both ends are turns of the table (all are)."""
    rows = table("conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    edges = ranking.chain(rows, ["conv_id"], [F.col("turn")], "id").withColumn("id", F.concat("source", F.lit(">"), "target"))
    relational.require_empty(graph.dangling(rows.select("id"), edges), "dangling edges")
    place = lambda c: F.split(c, "-")[1].cast("bigint")
    return graph.induced(rows.select("id"), edges).select(
        "conv_id", place("source").alias("source"), place("target").alias("target"), (place("target") - place("source")).alias("step"),
    )


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN NULL WHEN c_custkey % 50 = 42 THEN c_custkey + 5 ELSE c_custkey - 1 END AS parent FROM customer),
u(id, up, n) AS (SELECT id, parent, 1 FROM c UNION ALL SELECT u.id, c.parent, n + 1 FROM u JOIN c ON u.up = c.id WHERE n < 20) SELECT DISTINCT id FROM u WHERE n = 20 AND up IS NOT NULL""")
def parent_cycles(table):
    """Chains of ten, in every fifth of which a parent points forward."""
    c = F.col("c_custkey")
    nodes = table("customer").select(c.alias("id"), F.when(c % 10 == 1, None).when(c % 50 == 42, c + 5).otherwise(c - 1).alias("parent"))
    return graph.cyclic(nodes)


@query("""WITH l AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 43200 THEN 0 ELSE 1 END AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM l)
SELECT event_id AS node, root FROM (SELECT event_id, min(event_id) OVER g AS root, count(*) OVER g AS n FROM s WINDOW g AS (PARTITION BY user_id, k)) WHERE n > 1""")
def components_demo(table):
    """Events of a user that follow each other within twelve hours hang together."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = lambda c: c.cast("timestamp").cast("double")
    near = second(F.col("ts")) - second(F.lag("ts").over(own)) <= 43200
    edges = table("events").select(F.col("event_id").alias("a"), F.when(near, F.lag("event_id").over(own)).alias("b"))
    return graph.components(edges.filter("b IS NOT NULL"))


# --- scalars, streams, resampling ---------------------------------------------------------------


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, coalesce(nullif(regexp_extract(url, '(\d+)', 1), ''), 'none') AS id, sha256(url)[1:16] AS prefix FROM pages"""
)
def path_ids(table):
    return table("pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"),
        F.coalesce(F.nullif(F.regexp_extract("url", r"(\d+)", 1), F.lit("")), F.lit("none")).alias("id"), S.hash16("url").alias("prefix"),
    )


@query("""SELECT p_partkey, round(p_size * 1.0 / least(p_size, 10), 6) AS anisotropy, abs(p_size - 10) < 0.01 AS iso, round(p_size * 10.0 * 10.0 / 1000, 6) AS ml, CAST(ceil(250.0 / greatest(p_size * 100.0, 1e-9)) AS BIGINT) AS least, printf('thr%.2f_k%d', p_size / 100.0, p_size) AS config, rtrim(rtrim(printf('%.6f', p_size / 100.0), '0'), '.') AS short,
CASE WHEN p_size > 25 AND p_size < 180 THEN 'lt180d' WHEN p_size % 2 = 1 THEN 'ge180d' ELSE 'unknown' END AS bin FROM (SELECT p_partkey, p_size + 10 AS p_size FROM part)""")
def case_scalars(table):
    rows = table("part").select("p_partkey", (F.col("p_size") + 10).alias("x"), F.lit(10).alias("y"), F.lit(10).alias("z"))
    days = F.when(F.col("x") > 25, F.col("x"))
    return rows.select(
        "p_partkey", S.anisotropy("x", "y", "z").alias("anisotropy"), S.isotropic("x", "y", "z").alias("iso"),
        S.voxel_ml("x", "y", "z").alias("ml"), S.least_voxels(250, F.col("x") * 100.0).alias("least"),
        S.config_name(F.col("x") / 100.0, "x").alias("config"), S.short_threshold(F.col("x") / 100.0).alias("short"),
        S.chronicity(days, F.col("x") % 2)["bin"].alias("bin"),
    )


@query(
    """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"""
)
def stream_tumbling(table):
    """The batch form of the stream: the same function, over a table."""
    return jobs.tumbling(table("events"), "ts", "6 hours", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 6))


@query(
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM l) SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(table):
    return jobs.session_windows(table("events"), "ts", "12 hours", "1 hour", ["user_id"])


_BOOT = f"""WITH {_PAIRS}, b AS (SELECT user_id, b - a AS d, boot, ('0x' || substr(md5(user_id || ':' || boot || ':1'), 1, 10))::BIGINT / 1099511627776.0 AS u FROM p, range(0, 500) r(boot)),
w AS (SELECT boot, d, {" + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in selection.POISSON)} AS w FROM b), m AS (SELECT boot, sum(d * w) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1),
g AS (SELECT (SELECT avg(b) - avg(a) FROM p) AS effect, (SELECT count(*) FROM p) AS n_cases, stddev_samp(m) AS se, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi, count(*) AS n_boot FROM m)
SELECT round(effect, 6) AS effect, n_cases, round(se, 6) AS se, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, n_boot, round(effect / nullif(se, 0), 6) AS z, effect > se AS deviates, 'effect ' || CASE WHEN effect < 0 THEN '-' ELSE '+' END || printf('%.5f', abs(effect)) || CASE WHEN effect > se THEN ' exceeds ' ELSE ' does not exceed ' END || printf('%.5f', se) AS reason FROM g"""


@query(_BOOT)
def bootstrap_gate(table):
    boot = selection.gate(selection.bootstrap(_pairs(table), "user_id", 500, 1))
    return boot.select("effect", "n_cases", "se", "ci_lo", "ci_hi", "n_boot", "z", "deviates", "reason")


_COUNTERS = """k AS (SELECT user_id, count(*) FILTER (WHERE value >= 40) AS a_pred, count(*) FILTER (WHERE value >= 60) AS b_pred, count(*) FILTER (WHERE event_type = 'click') AS a_gt, count(*) FILTER (WHERE event_type = 'click') AS b_gt, count(*) FILTER (WHERE event_type = 'click' AND value >= 40) AS a_tp, count(*) FILTER (WHERE event_type = 'click' AND value >= 60) AS b_tp FROM events GROUP BY 1)"""


def _pooled_sql() -> str:
    f1 = lambda s: f"CASE WHEN sum({s}_pred * w) + sum({s}_gt * w) = 0 THEN 1.0 ELSE 2.0 * sum({s}_tp * w) / (sum({s}_pred * w) + sum({s}_gt * w)) END"
    weights = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in selection.POISSON)
    return f"""WITH {_COUNTERS}, b AS (SELECT *, ('0x' || substr(md5(user_id || ':' || boot || ':2'), 1, 10))::BIGINT / 1099511627776.0 AS u FROM k, range(0, 300) r(boot)), w AS (SELECT *, {weights} AS w FROM b),
m AS (SELECT boot, {f1("b")} - {f1("a")} AS m FROM w WHERE w > 0 GROUP BY 1), e AS (SELECT {f1("b")} - {f1("a")} AS effect, count(*) AS n_cases FROM (SELECT *, 1 AS w FROM k)), g AS (SELECT effect, n_cases, stddev_samp(m) AS se, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi, count(*) AS n_boot FROM e, m GROUP BY ALL)
SELECT round(effect, 6) AS effect, n_cases, round(se, 6) AS se, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, n_boot, effect > se AS deviates FROM g"""


@query(_pooled_sql())
def bootstrap_pooled(table):
    """The gate on a pooled F1: events above either of two values as predictions of clicks, users as cases."""
    v, click = F.col("value"), F.col("event_type") == "click"
    sides = {"a": v >= 40, "b": v >= 60}
    counts = {"pred": lambda on: on, "gt": lambda on: click, "tp": lambda on: click & on}
    cases = table("events").groupBy("user_id").agg(*(F.count_if(f(on)).alias(f"{s}_{c}") for s, on in sides.items() for c, f in counts.items()))
    boot = selection.bootstrap_scores(cases, "user_id", selection.pooled_f1("tp", "pred", "tp", "gt"), 300, 2)
    return selection.gate(boot).select("effect", "n_cases", "se", "ci_lo", "ci_hi", "n_boot", "deviates")


@query()
def balanced_folds(table):
    """Nations dealt into five folds, even in customers by segment and in balance; the restarts are Spark tasks."""
    segments = [r[0] for r in table("customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    profiles = splits.group_profiles(table("customer"), "c_nationkey", {"c_mktsegment": segments})
    return splits.assign_folds(profiles, "c_nationkey", 5, {"case_count": 4.0, "c_mktsegment": 3.0}, restarts=8)


from . import check_queries, file_queries, guard_queries, log_queries, table_queries, volume_queries  # noqa: E402, F401  they register theirs
