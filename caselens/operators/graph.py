"""Connected components, referential checks, cycles and scoped projections of property graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stash

# What a graph's records may hold, and how much of it.
LENSES = ("story", "decisions", "pipeline")
STATUSES = ("current", "superseded", "retracted", "negative", "uncertain")
KINDS = ("question", "evidence", "decision", "result", "correction", "artifact", "pipeline-step", "input", "output", "proof", "blocker")
CONFIDENCES = ("explicit", "strongly-inferred", "speculative")
RELATIONS = (
    "motivated", "measured", "supports", "contradicts", "selects", "supersedes", "produces", "consumes", "feeds", "precedes", "guards", "blocks",
)
MOST_NODES, MOST_EDGES = 1_000, 5_000


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node that has none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the graph with edges (a, b), longs: root is the smallest node that is reachable.

    Alternates large-star and small-star steps, each round a stashed table, until only stars are left.
    Only nodes with edges appear.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(most_rounds):
        if _are_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"),
        ).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = stash(small)
    raise RuntimeError(f"components: not stable after {most_rounds} rounds")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id): edges whose source or target is no node, and nodes whose parent is none."""
    ids = nodes.select("id")
    known = nodes.select(F.col("id").alias("__node"))
    end = lambda c: edges.join(known, F.col(c) == F.col("__node"), "left_anti").select(F.lit(f"no {c}").alias("kind"), "id")
    out = end("source").unionByName(end("target"))
    if "parent" in nodes.columns:
        parents = ids.withColumnRenamed("id", "parent")
        out = out.unionByName(
            nodes.filter("parent IS NOT NULL").join(parents, "parent", "left_anti").select(F.lit("no parent").alias("kind"), "id")
        )
    return out


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(
        ids.withColumnRenamed("id", "source"), "source", "left_semi",
    ).join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def cyclic(nodes: DataFrame) -> DataFrame:
    """Ids whose chain of parents never ends, by pointer doubling: after k rounds a pointer is 2^k steps up, and only rows that have one are left.

    A chain that ends has nodes of every height up to its own, so once a round drops none, all that are left are on or below
    cycles. Joins are shuffled: stashed tables look small enough to be sent through the driver, and aren't once decoded.
    """
    up = stash(nodes.select("id", "parent").filter("parent IS NOT NULL").distinct())
    ids = lambda df: df.agg(F.count_distinct("id")).first()[0]
    left = ids(up)
    while left:
        above = up.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        up = stash(up.hint("merge").join(above, "parent").select("id", F.col("next").alias("parent")).distinct())
        before, left = left, ids(up)
        if left == before:
            break
    return up.select("id").distinct()


def scope(
    nodes: DataFrame, edges: DataFrame, parent: str | int | None, lens: str | None = None, hidden: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Nodes of one level (children of the parent, or roots) seen through a lens, with the edges among them."""
    seen = nodes.filter(F.col("parent").isNull() if parent is None else F.col("parent") == parent)
    if lens is not None:
        seen = seen.filter(F.array_contains("lenses", lens))
    if hidden:
        seen = seen.filter(~F.col("status").isin(*hidden))
    return seen, induced(seen, edges)


def best_lens(nodes: DataFrame, edges: DataFrame, candidates: Sequence[str], given: str) -> DataFrame:
    """(lens, score) of the lens under which a scope shows most: 1000 for each edge and 1 for each node that carries it.

    nodes and edges: of scope(), with ``lenses``. On a tie the given lens stays, else the first candidate.
    """
    spark, names = nodes.sparkSession, list(dict.fromkeys([given, *candidates]))
    order = spark.createDataFrame(list(enumerate(names)), "__i int, lens string")
    carried = lambda df, worth: df.select(F.explode("lenses").alias("lens"), F.lit(worth).alias("worth"))
    shown = carried(edges, 1000).unionByName(carried(nodes, 1)).groupBy("lens").agg(F.sum("worth").alias("score"))
    scored = order.join(shown, "lens", "left").select("__i", "lens", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"))
    return scored.orderBy(F.col("score").desc(), "__i").limit(1).select("lens", "score")


def bad_values(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(F.lit(f"bad {column}").alias("kind"), "id")


def text_within(column: str, most: int = 10_000, optional: bool = False) -> Column:
    """Whether a text has 1 to ``most`` characters; NULL passes only where it is optional."""
    ok = F.char_length(column).between(1, most)
    return F.coalesce(ok, F.lit(optional))


def dated(column: str, optional: bool = False) -> Column:
    """Whether a text of at most 64 characters is a timestamp."""
    return F.coalesce(text_within(column, 64) & F.try_to_timestamp(column).isNotNull(), F.lit(False)) | (F.lit(optional) & F.col(column).isNull())


def one_of(column: str, allowed: Sequence[str], optional: bool = False) -> Column:
    return F.coalesce(F.col(column).isin(*allowed), F.lit(optional))


def several_of(column: str, allowed: Sequence[str]) -> Column:
    """Whether a list has at least one value, none twice, and none that isn't allowed."""
    x = F.col(column)
    every = F.forall(x, lambda v: v.isNotNull() & v.isin(*allowed))
    return F.coalesce((F.size(x) > 0) & (F.size(F.array_distinct(x)) == F.size(x)) & every, F.lit(False))


def sourced(column: str, most: int = 50) -> Column:
    """Whether a list of (label, path, commit, url) has at most ``most`` entries, each with a label and a place: a commit or an address.

    A path needs its commit; a commit is 40 hexadecimal digits.
    """
    def valid(x: Column) -> Column:
        within = lambda c, most: c.isNull() | F.char_length(c).between(1, most)
        label = F.coalesce(F.char_length(x["label"]).between(1, 500), F.lit(False))
        commit = x["commit"].isNull() | x["commit"].rlike(r"\A[0-9a-fA-F]{40}\z")
        return (
            label & within(x["path"], 4_096) & within(x["url"], 4_096) & commit
            & (x["path"].isNull() | x["commit"].isNotNull()) & (x["commit"].isNotNull() | x["url"].isNotNull())
        )

    return F.coalesce((F.size(column) <= most) & F.forall(column, valid), F.lit(False))


def _texts(most: int = 10_000, optional: bool = False):
    return lambda c: text_within(c, most, optional)


def _dates(optional: bool = False):
    return lambda c: dated(c, optional)


def _choices(allowed: Sequence[str], optional: bool = False):
    return lambda c: one_of(c, allowed, optional)


#: column -> rule, of nodes and of edges.
NODE_RULES = {
    "id": _texts(256), "title": _texts(1_000), "summary": _texts(), "kind": _choices(KINDS), "status": _choices(STATUSES), "event_at": _dates(),
    "asserted_at": _dates(True), "lenses": lambda c: several_of(c, LENSES), "question": _texts(), "evidence": _texts(), "decision": _texts(),
    "consequence": _texts(), "confidence": _choices(CONFIDENCES), "sources": sourced, "parent": _texts(256, True),
    "drilldown_label": _texts(500, True), "drilldown_lens": _choices(LENSES, True),
}
EDGE_RULES = {
    "id": _texts(256), "source": _texts(256), "target": _texts(256), "relation": _choices(RELATIONS), "lenses": lambda c: several_of(c, LENSES),
}


def schema_faults(nodes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> DataFrame:
    """(kind, id) of all that is wrong with a graph: values by NODE_RULES and EDGE_RULES, too many rows, repeated ids, loose ends, cycles.

    Every fault is a row. Columns that a table lacks aren't looked at. ``too many`` has the number of rows in place of an id.
    """
    def values(df: DataFrame, what: str, rules: dict) -> DataFrame:
        bad = F.array_compact(F.array(*(F.when(~ok(name), F.lit(f"{what} {name}")) for name, ok in rules.items() if name in df.columns)))
        return df.select(F.explode(bad).alias("kind"), F.col("id").cast("string").alias("id"))

    def counts(df: DataFrame, what: str, most: int) -> DataFrame:
        total = df.agg(F.count("*").alias("n")).filter(F.col("n") > most)
        repeated = df.groupBy("id").count().filter("count > 1")
        return total.select(F.lit(f"too many {what}s").alias("kind"), F.col("n").cast("string").alias("id")).unionByName(
            repeated.select(F.lit(f"repeated {what}").alias("kind"), F.col("id").cast("string").alias("id"))
        )

    parts = [
        values(nodes, "node", NODE_RULES), values(edges, "edge", EDGE_RULES), counts(nodes, "node", most_nodes),
        counts(edges, "edge", most_edges), dangling(nodes, edges).withColumn("id", F.col("id").cast("string")),
    ]
    if "parent" in nodes.columns:
        parts.append(cyclic(nodes.select("id", "parent")).select(F.lit("cycle").alias("kind"), F.col("id").cast("string").alias("id")))
    return reduce(DataFrame.unionByName, parts)
