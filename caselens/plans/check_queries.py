"""Queries over checks: split and record certificates, reconciliation, lineage, coverage, gates, decisions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ensemble, metrics, ranking, relational, reports, selection, splits
from .catalog import query

# --- certificates -------------------------------------------------------------------------------

_FAULTY = """base AS (SELECT c_custkey AS k, c_nationkey AS nation, c_nationkey % 3 AS own FROM customer), fold AS (SELECT unnest([0, 1, 2]) AS fold),
clean AS (SELECT fold, CASE WHEN own = fold THEN 'val' ELSE 'train' END AS subset, k FROM base, fold),
s AS (SELECT * FROM clean WHERE NOT (k % 83 = 0 AND fold = 1) UNION ALL SELECT * FROM clean WHERE k % 97 = 0 AND subset = 'train' UNION ALL SELECT fold, subset, -k FROM clean WHERE k % 101 = 0
 UNION ALL SELECT fold, 'val', k FROM clean WHERE k % 89 = 0 AND subset = 'train' UNION ALL SELECT 3, 'train', k FROM base),
folds AS (SELECT DISTINCT fold FROM s)"""


@query(f"""WITH {_FAULTY}
SELECT 'duplicate' AS kind, CAST(fold AS BIGINT) AS fold, CAST(k AS VARCHAR) AS item FROM s GROUP BY fold, subset, k HAVING count(*) > 1
UNION ALL SELECT 'unknown', fold, CAST(k AS VARCHAR) FROM s WHERE k NOT IN (SELECT k FROM base)
UNION ALL SELECT 'overlap', fold, CAST(k AS VARCHAR) FROM (SELECT fold, k FROM s WHERE subset = 'val' INTERSECT SELECT fold, k FROM s WHERE subset = 'train')
UNION ALL SELECT 'incomplete', fold, CAST(k AS VARCHAR) FROM base, folds WHERE (fold, k) NOT IN (SELECT (fold, k) FROM s)
UNION ALL SELECT 'empty', fold, 'val' FROM folds WHERE fold NOT IN (SELECT fold FROM s WHERE subset = 'val')
UNION ALL SELECT 'center leak', fold, CAST(nation AS VARCHAR) FROM s JOIN base USING (k) GROUP BY fold, nation HAVING count(DISTINCT subset) > 1
UNION ALL SELECT 'coverage', NULL, CAST(k AS VARCHAR) FROM base LEFT JOIN (SELECT k, count(*) AS n FROM s WHERE subset = 'val' GROUP BY 1) USING (k) WHERE n IS NULL OR n <> 1""")
def split_violation_kinds(table):
    """Folds of customers by nation with faults of every kind put in: repeated, unknown, lost and doubly dealt cases, a fold without validation."""
    key = F.col("c_custkey")
    cases = table("customer").select("c_custkey", "c_nationkey")
    dealt = cases.withColumn("fold", F.explode(F.array(*map(F.lit, range(3)))))
    clean = dealt.select("fold", F.when(F.col("c_nationkey") % 3 == F.col("fold"), "val").otherwise("train").alias("subset"), "c_custkey")
    train = clean.filter("subset = 'train'")
    rows = clean.filter(~((key % 83 == 0) & (F.col("fold") == 1))).unionByName(train.filter(key % 97 == 0))
    rows = rows.unionByName(clean.filter(key % 101 == 0).withColumn("c_custkey", -key))
    rows = rows.unionByName(train.filter(key % 89 == 0).withColumn("subset", F.lit("val")))
    rows = rows.unionByName(cases.select(F.lit(3).alias("fold"), F.lit("train").alias("subset"), "c_custkey"))
    return relational.split_violations(rows, cases, "c_custkey", "c_nationkey")


@query("""WITH r AS (SELECT CASE WHEN p_partkey % 40 = 0 THEN ' ' WHEN p_partkey % 30 = 0 THEN CAST(p_partkey // 60 AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN p_partkey % 55 = 0 THEN '' WHEN p_partkey % 77 <> 0 THEN p_brand END AS center FROM part)
SELECT 'missing id' AS kind, '' AS item FROM r WHERE trim(id) = '' UNION ALL SELECT 'duplicate id', id FROM r WHERE trim(id) <> '' GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'blank center', id FROM r WHERE coalesce(trim(center), '') = ''""")
def record_faults(table):
    k = F.col("p_partkey")
    ids = F.when(k % 40 == 0, " ").when(k % 30 == 0, F.expr("p_partkey div 60").cast("string")).otherwise(k.cast("string"))
    rows = table("part").select(ids.alias("id"), F.when(k % 55 == 0, "").when(k % 77 != 0, F.col("p_brand")).alias("center"))
    return relational.record_violations(rows, "id", "center")


@query("""WITH a AS (SELECT p_partkey, p_type AS version, md5(p_name) AS hash FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS version, CASE WHEN p_partkey % 11 = 0 THEN md5(p_brand) ELSE md5(p_name) END AS hash FROM part WHERE p_size <> 13)
SELECT a.p_partkey, CASE WHEN a.version IS NOT DISTINCT FROM b.version AND a.hash IS NOT DISTINCT FROM b.hash THEN 'reuse' ELSE 'convert' END AS action FROM a LEFT JOIN b USING (p_partkey)""")
def reuse_actions(table):
    """The manifest of before lacks parts of one size, and differs in versions and hashes of others."""
    k = F.col("p_partkey")
    now = table("part").select("p_partkey", F.col("p_type").alias("version"), F.md5("p_name").alias("hash"))
    before = table("part").filter("p_size <> 13").select(
        "p_partkey", F.when(k % 7 != 0, F.col("p_type")).alias("version"),
        F.md5(F.when(k % 11 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("hash"),
    )
    return relational.reuse(now, before, "p_partkey", ["version", "hash"]).select("p_partkey", "action")


@query(
    """SELECT CASE WHEN l_quantity < 5 THEN 'too few' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' END AS reason, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1"""
)
def skip_log(table):
    rules = [("too few", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08), ("returned", F.col("l_returnflag") == "R")]
    return relational.skip_reasons(table("lineitem"), rules).groupBy("reason").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"),
    )


@query("""WITH a AS (SELECT o_orderstatus AS key, count(*) AS n, CAST(min(o_orderkey) AS VARCHAR) AS first FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS key, count(*) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n, CAST(min(o_orderkey) AS VARCHAR) AS first FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
j AS (SELECT key, 'n' AS field, CAST(a.n AS VARCHAR) AS expected, CAST(b.n AS VARCHAR) AS actual FROM a FULL JOIN b USING (key) UNION ALL SELECT key, 'first', a.first, b.first FROM a FULL JOIN b USING (key)) SELECT * FROM j WHERE expected IS DISTINCT FROM actual""")
def summary_reconcile(table):
    """A recorded summary that misses a group and is wrong about another."""
    rows = table("orders").groupBy(F.col("o_orderstatus").alias("key")).agg(
        F.count("*").alias("n"), F.min("o_orderkey").cast("string").alias("first"),
    )
    recorded = rows.filter("key <> 'P'").withColumn("n", F.col("n") - (F.col("key") == "F").cast("int"))
    return relational.reconcile_values(rows, recorded, ["key"], ["n", "first"])


@query("""WITH e AS (SELECT 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM documents UNION ALL SELECT 'labelled', CAST(count(*) AS VARCHAR) FROM labels UNION ALL SELECT 'seed', '1'), a AS (SELECT 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM documents UNION ALL SELECT 'labelled', CAST(count(*) + 1 AS VARCHAR) FROM labels UNION ALL SELECT 'device', 'cpu')
SELECT 'value' AS kind, key AS item, coalesce(e.value, 'none') || ' <> ' || coalesce(a.value, 'none') AS detail FROM e FULL JOIN a USING (key) WHERE e.value IS DISTINCT FROM a.value
UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR), 'missing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'toxic', CAST(doc_id AS VARCHAR), 'unexpected' FROM labels WHERE toxic = 0""")
def lineage_certificate(table):
    """Recorded settings against found ones, and two lists of documents against each other."""
    docs, labels = table("documents"), table("labels")
    count = lambda df, name, more=0: df.agg(F.lit(name).alias("key"), (F.count("*") + more).cast("string").alias("value"))
    one = docs.sparkSession.createDataFrame([("seed", "1")], "key string, value string")
    expected = count(docs, "rows").unionByName(count(labels, "labelled")).unionByName(one)
    actual = count(docs, "rows").unionByName(count(labels, "labelled", 1)).unionByName(
        one.select(F.lit("device").alias("key"), F.lit("cpu").alias("value"))
    )
    return relational.lineage_faults(expected, actual, {"labels": (docs, labels), "toxic": (labels.filter("toxic = 1"), labels)}, "doc_id")


@query(
    """SELECT event_type AS config, count(DISTINCT user_id) AS n_subjects, (SELECT max(n) <> min(n) FROM (SELECT count(DISTINCT user_id) AS n FROM events GROUP BY event_type)) AS uneven FROM events GROUP BY 1"""
)
def coverage_warning(table):
    return relational.coverage(table("events"), "event_type", "user_id").withColumnRenamed("event_type", "config")


@query(
    """SELECT count(*) AS n_files, (SELECT count(*) FROM customer) AS n_cases, count(*) = (SELECT count(*) FROM customer) AS ok FROM supplier"""
)
def count_gate(table):
    folds = table("customer").select(F.lit("val").alias("subset"), "c_custkey")
    return relational.count_gate(table("supplier"), folds)


@query(
    """WITH a AS (SELECT DISTINCT c_custkey AS id, c_mktsegment AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS v FROM orders) SELECT id, a.v AS "left", b.v AS "right" FROM a JOIN b USING (id) WHERE a.v IS DISTINCT FROM b.v"""
)
def identity_conflicts(table):
    a = table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    return relational.identity_conflicts(
        a, table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("v")), "id", "v",
    )


@query("""WITH h AS (SELECT lang, sha256(CAST(doc_id AS VARCHAR) || ',' || source || ',' || text) AS h, n_chars FROM documents), l AS (SELECT lang, substr(h, 1, 2) AS leaf, count(*) AS n, sum(n_chars) AS bytes, sha256(string_agg(h, '' ORDER BY h)) AS s FROM h GROUP BY 1, 2)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(s, '' ORDER BY leaf)) AS content_sha256 FROM l GROUP BY 1""")
def content_certificate(table):
    return relational.certificate(table("documents"), ["lang"], ["doc_id", "source", "text"], "n_chars")


@query(
    """WITH c AS (SELECT doc_id, lang, quality IS NULL AS lacks FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, lang, concat_ws(',', CASE WHEN lacks THEN 'labels' END, CASE WHEN doc_id NOT IN (SELECT item_id FROM benchmark) THEN 'benchmark' END) AS lacks FROM c"""
)
def manifest_status(table):
    tables = {"labels": table("labels"), "benchmark": table("benchmark").select(F.col("item_id").alias("doc_id"))}
    return relational.manifest_status(table("documents").select("doc_id", "lang"), tables, ["doc_id"]).select("doc_id", "lang", "lacks")


@query(
    """SELECT lang, count(*) AS n_cases, count(quality) AS n_predicted, round(avg(quality), 6) AS mean_skip, round(avg(coalesce(quality, 0)), 6) AS mean_empty FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""
)
def missing_predictions(table):
    docs, labels = table("documents").select("doc_id", "lang"), table("labels")
    side = lambda how: relational.with_predictions(docs, labels, ["doc_id"], ["quality"], how).groupBy("lang")
    skip = side("skip").agg(F.count("*").alias("n_predicted"), F.avg("quality").alias("mean_skip"))
    return side("empty").agg(
        F.count("*").alias("n_cases"), F.avg("quality").alias("mean_empty"),
    ).join(skip, "lang").select("lang", "n_cases", "n_predicted", "mean_skip", "mean_empty")


@query(
    """SELECT o_orderkey, round(o_totalprice, 6) AS price, c_mktsegment AS segment, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
)
def three_way_join(table):
    a = table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"))
    b = relational.matched(
        a, table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("n_nationkey")),
        ["c_custkey"],
    )
    return relational.matched(
        b, table("nation").select("n_nationkey", F.col("n_name").alias("nation")), ["n_nationkey"],
    ).select("o_orderkey", "price", "segment", "nation")


@query(
    """SELECT DISTINCT doc_id, subset FROM (SELECT doc_id, 'train' AS subset FROM documents UNION ALL SELECT doc_id, 'train' FROM labels)"""
)
def split_merge(table):
    """Labelled and pseudo-labelled cases as one training list, each once."""
    train = lambda df: df.select("doc_id", F.lit("train").alias("subset"))
    return relational.union([train(table("documents")), train(table("labels"))]).dropDuplicates(["doc_id"])


@query(
    """SELECT r_name, n_name, len(list_intersect(string_split(lower(r_name), ''), string_split(lower(n_name), ''))) > 0 AS shares, len(list_intersect(string_split(lower(r_name), ''), ['e', 'u'])) > 0 AS vowels FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def set_overlaps(table):
    rows = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    letters = lambda c: F.split(F.lower(c), "")
    return rows.select(
        "r_name", "n_name", F.arrays_overlap(letters("r_name"), letters("n_name")).alias("shares"),
        F.arrays_overlap(letters("r_name"), F.array(F.lit("e"), F.lit("u"))).alias("vowels"),
    )


# --- decisions and resampling -------------------------------------------------------------------

_ARMS = "SELECT event_type AS arm, avg(value) / 100 AS rq, stddev_pop(value) / 100 AS avd, median(value) / 100 AS dice FROM events GROUP BY 1"


@query(
    f"""WITH a AS ({_ARMS}), b AS (SELECT * FROM a WHERE arm = 'view'), d AS (SELECT a.arm, a.rq - b.rq AS rq_gain, a.avd - b.avd AS avd_change, a.dice - b.dice AS dice_change FROM a, b) SELECT arm, round(rq_gain, 6) AS rq_gain, round(avd_change, 6) AS avd_change, round(dice_change, 6) AS dice_change, (rq_gain >= 0.02 OR avd_change <= -0.3) AND dice_change >= -0.005 AS promoted FROM d"""
)
def promotion_gate(table):
    v = F.col("value")
    arms = table("events").groupBy(F.col("event_type").alias("arm")).agg(
        (F.avg(v) / 100).alias("rq"), (F.stddev_pop(v) / 100).alias("avd"), (F.percentile(v, 0.5) / 100).alias("dice"),
    )
    base = arms.filter("arm = 'view'").select(*(F.col(c).alias(f"__{c}") for c in ("rq", "avd", "dice")))
    moved = arms.crossJoin(base).select(
        "arm", (F.col("rq") - F.col("__rq")).alias("rq_gain"), (F.col("avd") - F.col("__avd")).alias("avd_change"),
        (F.col("dice") - F.col("__dice")).alias("dice_change"),
    )  # one row of base
    return moved.withColumn("promoted", selection.promotion(F.col("rq_gain"), F.col("avd_change"), F.col("dice_change")))


@query(
    """WITH t AS (SELECT p_size / 10.0 AS threshold, avg(p_retailprice) AS price FROM part GROUP BY 1), c AS (SELECT threshold AS chosen FROM t ORDER BY price DESC, threshold LIMIT 1) SELECT min(threshold) < max(threshold) AND (abs((SELECT chosen FROM c) - min(threshold)) <= 1e-9 OR abs((SELECT chosen FROM c) - max(threshold)) <= 1e-9) AS on_edge FROM t"""
)
def grid_edge(table):
    cells = table("part").groupBy((F.col("p_size") / 10.0).alias("threshold")).agg(F.avg("p_retailprice").alias("price"))
    return selection.best_on_edge(cells, "threshold", "price")


@query(
    """WITH k AS (SELECT p_brand AS fold, p_size AS config, round(avg(p_retailprice), 6) AS v FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(abs(v - 1200.5), 12), config) AS n FROM k) SELECT fold, CAST(config AS BIGINT) AS config, v FROM r WHERE n = 1"""
)
def nearest_value(table):
    rows = table("part").groupBy(
        F.col("p_brand").alias("fold"), F.col("p_size").alias("config"),
    ).agg(F.round(F.avg("p_retailprice"), 6).alias("v"))
    return ranking.nearest(rows, ["fold"], "v", F.lit(1200.5), "config")


@query(
    """WITH e AS (SELECT user_id, dayofyear(ts) AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, day) AS n FROM e) SELECT user_id, day, v FROM b WHERE n = 1"""
)
def best_checkpoint(table):
    """Days play the epochs; the first one of the best mean stays."""
    rows = table("events").groupBy("user_id", F.dayofyear("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return ranking.best_so_far(rows, ["user_id"], "day", "v").select("user_id", "day", "v")


@query(
    """WITH e AS (SELECT embedding, vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS p FROM embeddings), r AS (SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS n FROM e) SELECT vec_id, i, round(CAST(p AS DOUBLE), 6) AS p FROM r WHERE n = 1"""
)
def class_argmax(table):
    rows = table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "p")).withColumn("p", F.col("p").cast("double"))
    return ensemble.decide_class(rows, ["vec_id"], "i", "p").select("vec_id", "i", "p")


@query(
    """WITH s AS (SELECT event_id, event_type, CASE WHEN user_id % 7 = 0 THEN 0 ELSE user_id % 5 END AS used, user_id % 5 AS held, user_id, value FROM events) SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'view' AND used = held), 6) AS a, round(avg(value) FILTER (WHERE event_type = 'click' AND used = held), 6) AS b, round(avg(value) FILTER (WHERE event_type = 'click' AND used = held) - avg(value) FILTER (WHERE event_type = 'view' AND used = held), 6) AS delta, count(*) FILTER (WHERE used <> held) AS n_contaminated FROM s GROUP BY 1"""
)
def clean_arms(table):
    u = F.col("user_id")
    return reports.clean_arms(
        table("events"), "user_id", "event_type", "value", F.when(u % 7 == 0, 0).otherwise(u % 5), u % 5, "view", "click",
    )


# --- profiles, folds and reports ----------------------------------------------------------------

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f"""SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(count(*) AS DOUBLE) AS case_count, {", ".join(f"CAST(count(*) FILTER (WHERE c_mktsegment = '{v}') AS DOUBLE) AS \"c_mktsegment={v}\"" for v in _SEGMENTS)}, CAST(count(b) AS DOUBLE) AS volume_known, round(coalesce(sum(b), 0), 6) AS volume_sum, round(coalesce(sum(ln(1 + b)), 0), 6) AS volume_log1p FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) GROUP BY 1""")
def group_profiles(table):
    rows = table("customer").withColumn("b", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return splits.group_profiles(rows, "c_nationkey", {"c_mktsegment": _SEGMENTS}, "b")


@query(
    """SELECT c_mktsegment, count(b) AS n_known, count(*) - count(b) AS n_missing, round(sum(b), 6) AS sum, round(avg(b), 6) AS mean, round(quantile_cont(b, 0.5), 6) AS median, round(sum(ln(1 + b)), 6) AS sum_log1p FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) GROUP BY 1"""
)
def volume_summary(table):
    return reports.volume_summary(
        table("customer").withColumn("b", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), ["c_mktsegment"], "b",
    )


@query("""WITH l AS (SELECT fold, unnest([case_count, balance]) AS load, unnest(['case_count', 'balance']) AS feature FROM (SELECT c_nationkey % 5 AS fold, CAST(count(*) AS DOUBLE) AS case_count, sum(round(c_acctbal * 100)) / 100 AS balance FROM customer GROUP BY 1)),
m AS (SELECT feature, avg(load) AS target FROM l GROUP BY 1) SELECT round(sum(w * mse), 6) AS objective FROM (SELECT feature, CASE feature WHEN 'case_count' THEN 4.0 ELSE 1.0 END AS w, avg(((load - target) / greatest(target, 1.0)) ** 2) AS mse FROM l JOIN m USING (feature) WHERE target > 1e-12 GROUP BY 1)""")
def fold_imbalance(table):
    rows = table("customer").withColumn("fold", F.col("c_nationkey") % 5)
    loads = rows.groupBy("fold").agg(
        F.count("*").cast("double").alias("case_count"), (F.sum(F.round(F.col("c_acctbal") * 100)) / 100).alias("balance"),
    )
    return splits.objective(loads, "fold", {"case_count": 4.0, "balance": 1.0})


@query(
    """SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN c_nationkey % 4 = fold THEN 'val' ELSE 'train' END AS subset, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer, (SELECT DISTINCT c_nationkey % 4 AS fold FROM customer) GROUP BY ALL"""
)
def split_rows(table):
    """An assignment of nations to folds as rows of training and validation."""
    assignment = table("customer").select("c_nationkey").distinct().withColumn("fold", F.col("c_nationkey") % 4)
    rows = splits.splits(table("customer"), assignment, "c_custkey", "c_nationkey")
    return rows.groupBy("fold", "subset").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


_FIVE = ", ".join(f"count({m}) AS {m}_n, round(avg({m}), 6) AS {m}_mean, round(quantile_cont({m}, 0.5), 6) AS {m}_median, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max" for m in ("l_quantity", "l_discount", "l_tax"))


@query(f"SELECT l_returnflag, count(*) AS n, {_FIVE} FROM lineitem GROUP BY 1")
def group_report(table):
    return reports.group_report(table("lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"])


@query(
    """WITH r AS (SELECT event_type AS variant, CAST(user_id % 4 AS VARCHAR) AS eval_set, round(avg(value), 6) AS v FROM events WHERE NOT (event_type = 'view' AND user_id % 4 = 2) GROUP BY ALL) SELECT 'reference' AS variant, '0' AS eval_set, 250.0 AS v UNION ALL SELECT variant, eval_set, v FROM (SELECT DISTINCT event_type AS variant FROM events) CROSS JOIN (SELECT CAST(unnest(range(0, 5)) AS VARCHAR) AS eval_set) LEFT JOIN r USING (variant, eval_set)"""
)
def report_matrix(table):
    """One cell of the results is missing, and one evaluation set has none at all."""
    events = table("events")
    results = events.filter("NOT (event_type = 'view' AND user_id % 4 = 2)").groupBy(
        F.col("event_type").alias("variant"), (F.col("user_id") % 4).cast("string").alias("eval_set"),
    ).agg(F.avg("value").alias("v"))
    sets = events.sparkSession.range(5).select(F.col("id").cast("string").alias("eval_set"))
    reference = events.sparkSession.createDataFrame([("reference", "0", 250.0)], "variant string, eval_set string, v double")
    return reports.dense_matrix(results, events.select(F.col("event_type").alias("variant")).distinct(), sets, reference)


@query(
    """SELECT event_type AS config, count(*) AS n, round(avg(CASE WHEN value < 60 THEN 1.0 ELSE value / 600 END), 6) AS mean_flat, count(*) FILTER (WHERE value < 60) AS n_pred_empty, count(*) FILTER (WHERE user_id % 9 = 0) AS n_gt_empty, length(event_type) AS threshold FROM events GROUP BY 1"""
)
def config_extras(table):
    rows = table("events").select(
        F.col("event_type").alias("config"), "value", "user_id",
        F.when(F.col("value") < 60, 1.0).otherwise(F.col("value") / 600).alias("flat"), F.length("event_type").alias("threshold"),
    )
    return reports.config_extras(rows, "config", "flat", F.col("value") < 60, F.col("user_id") % 9 == 0, ["threshold"])


@query(
    """WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'refused' WHEN p_size % 2 = 0 THEN 'resampled' ELSE 'on_grid' END AS status FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY p_partkey) AS k FROM s) SELECT status, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey) FILTER (WHERE k <= 20), ',') AS examples FROM r GROUP BY 1"""
)
def geometry_counters(table):
    size = F.col("p_size")
    return reports.status_counts(
        table("part").select(
            "p_partkey", F.when(size % 5 == 0, "refused").when(size % 2 == 0, "resampled").otherwise("on_grid").alias("status"),
        ),
        "status", "p_partkey",
    )


@query(
    """SELECT event_type, round(CASE WHEN count(*) FILTER (WHERE value > 450) = 0 THEN 1.0 ELSE (1 + count(*) FILTER (WHERE value > 450) / CAST(count(*) AS DOUBLE)) / 2 END, 6) AS flat_pr_auc FROM events GROUP BY 1"""
)
def flat_pr_auc(table):
    counts = table("events").groupBy("event_type").agg(F.count_if(F.col("value") > 450).alias("pos"), F.count("*").alias("n"))
    return counts.select("event_type", metrics.flat_pr_auc(F.col("pos"), F.col("n")).alias("flat_pr_auc"))


_STEPS = (0.05, 0.1, 0.35, 0.5, 0.75)
_CASES = f"""c AS (SELECT user_id AS case_id, threshold, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM (SELECT user_id, event_type IN ('purchase', 'click') AS t, value / 600.0 >= threshold AS p, threshold FROM events, (SELECT CAST(unnest({list(_STEPS)}) AS DOUBLE) AS threshold)) GROUP BY ALL),
k AS (SELECT *, CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS dice, CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END AS iou, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision,
 (tp + fn) % 7 AS gt_count, (tp + fp) % 7 AS pred_count, least((tp + fn) % 7, tp % 5) AS detected_gt, least((tp + fp) % 7, tp % 5) AS tp_pred, (tp + fp) * 0.5 AS pred_ml, (tp + fn) * 0.5 AS gt_ml FROM c)"""


@query(f"""WITH {_CASES}, s AS (SELECT threshold, count(*) AS n_cases, avg(dice) AS mean_dice, avg(iou) AS mean_iou, avg(sensitivity) AS mean_sensitivity, avg(precision) AS mean_precision, quantile_cont(dice, 0.5) AS median_dice, sum(tp) AS sum_tp, sum(fp) AS sum_fp, sum(fn) AS sum_fn, sum(tn) AS sum_tn, sum(gt_count) AS sum_gt_count, sum(pred_count) AS sum_pred_count, sum(detected_gt) AS sum_detected_gt, sum(tp_pred) AS sum_tp_pred, avg(abs(pred_ml - gt_ml)) AS mean_abs_ml, avg(abs(pred_count - gt_count)) AS mean_abs_count FROM k GROUP BY 1),
q AS (SELECT *, CAST(sum_tp_pred AS DOUBLE) / nullif(sum_pred_count, 0) AS pr, CAST(sum_detected_gt AS DOUBLE) / nullif(sum_gt_count, 0) AS rc FROM s), f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM q)
SELECT round(threshold, 6) AS threshold, n_cases, round(mean_dice, 6) AS mean_dice, round(mean_iou, 6) AS mean_iou, round(mean_sensitivity, 6) AS mean_sensitivity, round(mean_precision, 6) AS mean_precision, round(median_dice, 6) AS median_dice, sum_tp::BIGINT AS sum_tp, sum_fp::BIGINT AS sum_fp, sum_fn::BIGINT AS sum_fn, sum_tn::BIGINT AS sum_tn, sum_gt_count::BIGINT AS sum_gt_count, sum_pred_count::BIGINT AS sum_pred_count, sum_detected_gt::BIGINT AS sum_detected_gt, sum_tp_pred::BIGINT AS sum_tp_pred, round(mean_abs_ml, 6) AS mean_abs_ml, round(mean_abs_count, 6) AS mean_abs_count,
round(2.0 * sum_tp / nullif(2 * sum_tp + sum_fp + sum_fn, 0), 6) AS pooled_dice, round(pr, 6) AS lesion_precision, round(rc, 6) AS lesion_recall, round(f1, 6) AS lesion_f1, (sum_pred_count - sum_tp_pred)::BIGINT AS fp_lesions, (sum_gt_count - sum_detected_gt)::BIGINT AS fn_lesions, round(CASE WHEN mean_dice + f1 = 0 THEN 0.0 ELSE 2 * mean_dice * f1 / (mean_dice + f1) END, 6) AS harmonic FROM f""")
def sweep_summary(table):
    """All users play cases; lesion counts are made of the voxel counts."""
    rows = table("events").select(
        F.col("user_id").alias("case_id"), F.col("event_type").isin("purchase", "click").alias("truth"),
        (F.col("value") / 600.0).alias("score"),
    )
    counts = metrics.sweep_at(rows, ["case_id"], "score", F.col("truth"), list(_STEPS))
    truth, predicted = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    cases = counts.select("*", *metrics.overlap()).withColumns(
        {"gt_count": truth % 7, "pred_count": predicted % 7, "pred_ml": predicted * 0.5, "gt_ml": truth * 0.5}
    )
    cases = cases.withColumns({"detected_gt": F.least("gt_count", F.col("tp") % 5), "tp_pred": F.least("pred_count", F.col("tp") % 5)})
    return reports.sweep_summary(cases)


# --- text forms ---------------------------------------------------------------------------------


@query(
    r"""SELECT n_nationkey::BIGINT AS n_nationkey, replace(n_name || '|x', '|', '\|') AS markdown, printf('%.2f', n_nationkey / 7.0) AS number, CAST(n_nationkey AS VARCHAR) || 'x3x' || CAST(n_regionkey AS VARCHAR) AS shape, abs(n_nationkey / 3.0 - n_nationkey * 0.333333333333) <= 1e-9 AS near, n_nationkey > 5 AS above, r_name <> n_name AS two_tops FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def text_forms(table):
    rows = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    paths = F.array(F.concat("r_name", F.lit("/a/b")), F.concat("n_name", F.lit("/c")), F.concat("r_name", F.lit("/d")))
    return rows.select(
        "n_nationkey", S.markdown(F.concat("n_name", F.lit("|x"))).alias("markdown"), S.number_text(k / 7.0, 2).alias("number"),
        S.shape_text(F.array(k, F.lit(3), F.col("n_regionkey"))).alias("shape"), S.close(k / 3.0, k * 0.333333333333).alias("near"),
        S.binarise(k.cast("double"), 5.0, inclusive=False).alias("above"), (F.size(S.top_level(paths)) == 2).alias("two_tops"),
    )


@query("""SELECT strftime(o_orderdate, '%-d %b %Y') AS day, count(*) AS n, round(sum(o_totalprice), 6) AS amount FROM orders GROUP BY 1""")
def utc_days(table):
    rows = table("orders").select(
        S.utc_day("o_orderdate").alias("day"), S.require_amount(F.col("o_totalprice").cast("string"), "o_orderkey").alias("price"),
    )
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("price").alias("amount"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.deep.er') AS deep FROM events""")
def nested_fields(table):
    """A number and a path that no document has."""
    return table("events").select("event_id", S.nested("props", "k").alias("k"), F.get_json_object("props", "$.deep.er").alias("deep"))


@query(
    """SELECT p_partkey, [p_size, 10] = [p_size - p_partkey % 2, 10] AND abs(p_retailprice - (p_retailprice + (p_partkey % 3) * 0.0004)) <= 1e-3 + 1e-5 * abs(p_retailprice + (p_partkey % 3) * 0.0004) AS on_grid FROM part"""
)
def grid_guards(table):
    k = F.col("p_partkey")
    return table("part").select(
        "p_partkey",
        S.same_grid(
            F.array("p_size", F.lit(10)), F.array(F.col("p_size") - k % 2, F.lit(10)), F.array("p_retailprice"),
            F.array(F.col("p_retailprice") + (k % 3) * 0.0004),
        ).alias("on_grid"),
    )


@query(
    """SELECT lang, '{"n":' || count(*) || ',"first":"' || min(source) || '","ids":[' || string_agg(doc_id, ',' ORDER BY doc_id) || ']}' AS document FROM documents GROUP BY 1"""
)
def provenance_document(table):
    """What was checked and the list of cases, as one JSON text for each language."""
    return reports.provenance_document(table("documents"), ["lang"], "doc_id", {"n": F.count("*"), "first": F.min("source")}, "ids")
