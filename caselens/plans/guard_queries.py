"""Queries that guard: graphs against their schema, collections against a manifest, results without a description; and models over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, relational, selection, splits
from .catalog import query

_LIST = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_COMMIT = "0123456789abcdef0123456789ABCDEF01234567"
_GRAPH = f"""n AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS title, CASE c_mktsegment WHEN 'BUILDING' THEN 'artifact' WHEN 'MACHINERY' THEN 'result' ELSE c_mktsegment END AS kind, CASE c_nationkey % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'negative' END AS status,
 CASE WHEN c_nationkey = 3 THEN 'no date' ELSE '2024-01-' || (10 + c_nationkey % 15) END AS event_at, CASE c_nationkey % 4 WHEN 0 THEN ['story'] WHEN 1 THEN ['story', 'story'] WHEN 2 THEN ['plot'] ELSE ['story', 'pipeline'] END AS lenses, CASE WHEN c_nationkey % 6 > 0 THEN 'explicit' END AS confidence,
 CASE WHEN c_nationkey % 3 = 0 THEN 'a/b' END AS path, CASE WHEN c_nationkey % 6 = 0 THEN '{_COMMIT}' END AS commit, CASE WHEN c_nationkey % 2 = 1 THEN 'place' END AS url,
 CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 100 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) WHEN c_custkey > 1 AND c_custkey % 100 = 1 THEN CAST(c_custkey - 1 AS VARCHAR) ELSE CAST(c_custkey // 2 AS VARCHAR) END AS parent FROM customer),
e AS (SELECT o_custkey || '-' || o_orderpriority AS id, CAST(o_custkey AS VARCHAR) AS source, CAST(o_custkey + o_orderkey % 7 AS VARCHAR) AS target, CASE o_orderstatus WHEN 'F' THEN 'feeds' WHEN 'O' THEN 'guards' ELSE 'passes' END AS relation FROM orders),
w(id, up, k) AS (SELECT id, parent, 1 FROM n WHERE parent IS NOT NULL UNION ALL SELECT w.id, n.parent, k + 1 FROM w JOIN n ON n.id = w.up WHERE n.parent IS NOT NULL AND k < 64)"""
_FAULTS = [
    "SELECT 'node title' AS kind, id FROM n WHERE length(title) = 0",
    f"SELECT 'node kind', id FROM n WHERE kind NOT IN {_LIST(graph.KINDS)}",
    f"SELECT 'node status', id FROM n WHERE status IS NULL OR status NOT IN {_LIST(graph.STATUSES)}",
    "SELECT 'node event_at', id FROM n WHERE try_cast(event_at AS TIMESTAMP) IS NULL",
    f"SELECT 'node lenses', id FROM n WHERE len(list_distinct(lenses)) < len(lenses) OR len(list_filter(lenses, lambda x: x NOT IN {_LIST(graph.LENSES)})) > 0",
    "SELECT 'node confidence', id FROM n WHERE confidence IS NULL",
    "SELECT 'node sources', id FROM n WHERE path IS NOT NULL AND commit IS NULL OR commit IS NULL AND url IS NULL",
    f"SELECT 'edge relation', id FROM e WHERE relation NOT IN {_LIST(graph.RELATIONS)}",
    "SELECT 'too many nodes', CAST(count(*) AS VARCHAR) FROM n HAVING count(*) > 1000",
    "SELECT 'too many edges', CAST(count(*) AS VARCHAR) FROM e HAVING count(*) > 5000",
    "SELECT 'repeated edge', id FROM e GROUP BY id HAVING count(*) > 1",
    "SELECT 'no source', id FROM e WHERE source NOT IN (SELECT id FROM n)",
    "SELECT 'no target', id FROM e WHERE target NOT IN (SELECT id FROM n)",
    "SELECT 'no parent', id FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM n)",
    "SELECT 'cycle', id FROM w WHERE k = 64",
]


@query(f"WITH RECURSIVE {_GRAPH} {' UNION ALL '.join(_FAULTS)}")
def graph_schema_faults(table):
    """Customers play nodes and orders edges, with values that the schema has and others that it hasn't."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    words = lambda *w: F.array(*map(F.lit, w))
    source = F.struct(
        F.col("c_name").alias("label"), F.when(n % 3 == 0, "a/b").alias("path"), F.when(n % 6 == 0, _COMMIT).alias("commit"),
        F.when(n % 2 == 1, "place").alias("url"),
    )
    segment = F.col("c_mktsegment")
    nodes = table("customer").select(
        k.cast("string").alias("id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("title"),
        F.when(segment == "BUILDING", "artifact").when(segment == "MACHINERY", "result").otherwise(segment).alias("kind"),
        F.when(n % 3 == 0, "current").when(n % 3 == 1, "negative").alias("status"),
        F.when(n == 3, "no date").otherwise(F.concat(F.lit("2024-01-"), (n % 15 + 10).cast("string"))).alias("event_at"),
        F.when(n % 4 == 0, words("story")).when(n % 4 == 1, words("story", "story")).when(n % 4 == 2, words("plot"))
        .otherwise(words("story", "pipeline")).alias("lenses"),
        F.when(n % 6 > 0, "explicit").alias("confidence"), F.array(source).alias("sources"),
        F.when(k == 0, None).when(k % 100 == 0, k + 1).when((k > 1) & (k % 100 == 1), k - 1).otherwise(F.floor(k / 2)).cast("string").alias("parent"),
    )
    status = F.col("o_orderstatus")
    edges = table("orders").select(
        F.concat_ws("-", "o_custkey", "o_orderpriority").alias("id"), F.col("o_custkey").cast("string").alias("source"),
        (F.col("o_custkey") + F.col("o_orderkey") % 7).cast("string").alias("target"),
        F.when(status == "F", "feeds").when(status == "O", "guards").otherwise("passes").alias("relation"),
    )
    return graph.schema_faults(nodes, edges)


_COLLECTIONS = {
    "images": "SELECT DISTINCT o_custkey FROM orders", "labels": "SELECT DISTINCT user_id FROM events",
    "ground truth": "SELECT c_custkey FROM customer WHERE c_acctbal > 0", "preprocessed": "SELECT c_custkey FROM customer",
    "properties": "SELECT DISTINCT l_suppkey FROM lineitem", "splits": "SELECT o_custkey FROM orders",
}


def _collections_sql() -> str:
    sides = {"manifest": "SELECT c_custkey FROM customer", **_COLLECTIONS}
    parts = []
    for name, rows in sides.items():
        parts += [
            f"SELECT '{name}' AS collection, 'missing' AS kind, CAST(k AS VARCHAR) AS item FROM m WHERE k NOT IN (SELECT x FROM ({rows}) t(x))",
            f"SELECT DISTINCT '{name}', 'unexpected', CAST(x AS VARCHAR) FROM ({rows}) t(x) WHERE x NOT IN (SELECT k FROM m)",
            f"SELECT '{name}', 'duplicate', CAST(x AS VARCHAR) FROM ({rows}) t(x) GROUP BY x HAVING count(*) > 1",
        ]
    return f"WITH m AS (SELECT c_custkey AS k FROM customer) {' UNION ALL '.join(parts)}"


@query(_collections_sql())
def collection_faults(table):
    """Six collections of cases against their manifest."""
    keyed = lambda name, column: table(name).select(F.col(column).alias("case"))
    found = {
        "images": keyed("orders", "o_custkey").distinct(), "labels": keyed("events", "user_id").distinct(),
        "ground truth": table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("case")),
        "preprocessed": keyed("customer", "c_custkey"), "properties": keyed("lineitem", "l_suppkey").distinct(),
        "splits": keyed("orders", "o_custkey"),
    }
    return relational.verify_collections(keyed("customer", "c_custkey"), found, "case")


@query("""WITH r AS (SELECT o_custkey AS k, max(o_orderstatus <> 'F') AS ok FROM orders GROUP BY 1), m AS (SELECT user_id AS k, max(value > 400) AS ok FROM events GROUP BY 1)
SELECT c_custkey AS folder, CASE WHEN r.ok IS NULL THEN 'no report' WHEN m.ok IS NULL THEN 'undeclared' WHEN NOT m.ok THEN 'bad description' WHEN NOT r.ok THEN 'bad report' ELSE 'ok' END AS status FROM customer LEFT JOIN r ON r.k = c_custkey LEFT JOIN m ON m.k = c_custkey""")
def report_folders(table):
    """Customers play folders of results, orders their reports and events their descriptions."""
    folders = table("customer").select(F.col("c_custkey").alias("folder"))
    reports = table("orders").select(F.col("o_custkey").alias("folder"), "o_orderstatus")
    metas = table("events").select(F.col("user_id").alias("folder"), "value")
    return relational.report_status(folders, reports, metas, "folder", F.col("o_orderstatus") != "F", F.col("value") > 400)


@query("""WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) END AS days, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.0 END AS flag FROM orders),
b AS (SELECT CASE WHEN days > 0 AND days < 180 THEN 'lt180d' WHEN days > 0 THEN 'ge180d' ELSE 'unknown' END AS legacy, CASE WHEN days > 0 AND days < 180 THEN 'lt180d' WHEN days > 0 OR flag = 1 THEN 'ge180d' ELSE 'unknown' END AS bin, CASE WHEN days > 0 THEN 'days_post_stroke' WHEN flag = 1 THEN 'chronicity_flag' ELSE '' END AS source FROM o)
SELECT bin, source, legacy, count(*) AS n FROM b GROUP BY ALL""")
def chronicity_bins(table):
    """All branches: days unknown, zero, negative, early and late; the flag set, unset and unknown."""
    days = F.when(F.col("o_orderstatus") != "P", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")))
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).when(F.col("o_orderpriority") == "2-HIGH", 0.0)
    rows = table("orders").select(S.chronicity(days, flag).alias("now"), S.chronicity(days, flag, True)["bin"].alias("legacy"))
    return rows.select("now.*", "legacy").groupBy("bin", "source", "legacy").agg(F.count("*").alias("n"))


@query(
    "WITH g AS (SELECT user_id AS held, count(*) AS k, sum(count(*)) OVER () AS total FROM events GROUP BY 1) SELECT held, unnest(['val', 'train']) AS subset, CAST(unnest([k, total - k]) AS BIGINT) AS n FROM g WHERE k >= 3"
)
def group_plan_sizes(table):
    """Sizes of the folds that leave out one user each, without a row of the plan."""
    return splits.plan_sizes(table("events"), "user_id", 3)


def _brands(table) -> DataFrame:
    fold = (F.length("p_name") % 3).cast("int").alias("fold")
    return table("part").select("p_partkey", fold, F.col("p_size").cast("double").alias("size"), F.length("p_brand").cast("double").alias("brand"), "p_type", F.col("p_retailprice").alias("ml"))


@query()
def predicted_volumes(table):
    """What boosted trees fitted on the other folds say of each part's price. No SQL: see the test that they learn a curve."""
    found = selection.nested_predictions(_brands(table), "fold", lambda train: selection.fit_log_volume(train, ["size", "brand"], "ml"), ["predicted_volume"])
    return found.select("p_partkey", "fold", "ml", "predicted_volume")


@query()
def predicted_configurations(table):
    """What a forest fitted on the other folds says of each part's type. No SQL: see the test that it learns three ranges."""
    found = selection.nested_predictions(
        _brands(table), "fold", lambda train: selection.fit_configuration(train, ["size", "ml"], "p_type"), ["predicted_config"],
    )
    return found.select("p_partkey", "fold", "p_type", "predicted_config")
