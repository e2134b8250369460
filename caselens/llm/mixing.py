"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share
the number of words of the whole table; no target exceeds MOST_REPEATS times
its source, the excess goes to the others by weight (water filling, in closed
form over the table of sources).

Every source is a stream: its documents in hashed order, again and again, until
its target is reached; the last document may be taken in part. Prefix sums over
a stream come from sums of hash buckets, of about BUCKET_ROWS documents each, so
a source with a large share of all rows is never in one task. Documents are
named by doc_id, and by a hash of the text where that is null or repeated. Each source has a weight schedule over training
progress, piecewise linear. Its integral is the source's cumulative demand;
inverting it gives each copy of a document its position, and the mix is
range-sorted by position.

Edge cases: a null text has 0 words, a null source is a source; documents
without words are never taken; rows repeated with doc_id are rows like others;
reruns agree. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import partitions, stash

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 50_000
#: Weight over progress, in knots (progress, weight): even, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def _source_key() -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def sizes(docs: DataFrame) -> DataFrame:
    """docs with: size (words), skey (source), h (place of the document in its source's stream) and tie (of documents with one doc_id)."""
    tie = F.md5(F.coalesce("text", F.lit("")))
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), tie)))
    return docs.withColumns(
        {"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"), "skey": _source_key(), "h": place, "tie": tie}
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """by_source: skey, source_size. Adds kind (0, 1, ...: which weight and schedule), weight and target."""
    number = F.row_number().over(Window.orderBy("skey")) - 1
    kinds = by_source.withColumn("kind", number)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("kind", F.lit(len(weights))).cast("int") + 1)
    full = F.col("source_size") * most
    every, upto = Window.partitionBy(), Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(upto), F.lit(0))
    ).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).cast("double")
    filled = kinds.withColumn("weight", weight.cast("bigint")).withColumn("full", full).withColumn(
        "ratio", F.col("full").cast("double") / F.col("weight"),
    ).withColumn("level", level).withColumn("stops", F.col("level") > F.col("ratio"))
    water = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    return filled.withColumn(
        "target", F.when(F.col("stops"), F.col("full").cast("double")).otherwise(water * F.col("weight")),
    ).select("skey", "source_size", "kind", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))


def _areas(knots) -> list[tuple[float, float, float, float, float]]:
    """(area before, start, end, weight at start, weight at end) of each segment, the whole area being 1."""
    parts = [(u, v, a, b) for (u, a), (v, b) in zip(knots, knots[1:])]
    whole = sum((v - u) * (a + b) / 2 for u, v, a, b in parts)
    out, done = [], 0.0
    for u, v, a, b in parts:
        out.append((done, u, v, a / whole, b / whole))
        done += (v - u) * (a + b) / 2 / whole
    return out


def invert_demand(share: Column, knots) -> Column:
    """The progress by which a source has got this share of its target."""
    result = None
    for before, u, v, a, b in _areas(knots):
        rest, slope = share - before, (b - a) / (v - u)
        step = rest / a if slope == 0 else (F.sqrt(F.greatest(a * a + 2 * slope * rest, F.lit(0.0))) - a) / slope
        at = F.lit(u) + step
        result = at if result is None else F.when(share >= before, at).otherwise(result)
    return F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0))


def _progress(share: Column, schedules) -> Column:
    kind = F.pmod("kind", F.lit(len(schedules)))
    result = invert_demand(share, schedules[0])
    for k, knots in enumerate(schedules[1:], 1):
        result = F.when(kind == k, invert_demand(share, knots)).otherwise(result)
    return result


def _streams(sized: DataFrame, weights, most: int) -> tuple[int, DataFrame]:
    """sized: of sizes(). The number of digits that name a bucket, and a row for each bucket: its source's target, and the words ahead of it."""
    n, digits = sized.count(), 3
    while n > BUCKET_ROWS << 4 * digits:
        digits += 1
    bucket = F.substring("h", 1, digits).alias("bucket")
    meta = stash(sized.groupBy("skey", bucket).agg(F.sum("size").alias("bucket_size")))
    by_source = targets(meta.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = meta.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    return digits, stash(buckets.join(by_source, "skey").drop("bucket_size"))


def plan(sized: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, streams: tuple[int, DataFrame] | None = None) -> DataFrame:
    """sized: of sizes(). Adds source_size, target, taken, quota, before (words of the source's stream ahead of the document), and its number in its bucket."""
    digits, buckets = streams or _streams(sized, weights, most)
    order = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "tie")
    own = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("bucket", F.substring("h", 1, digits)).join(buckets.hint("shuffle_hash"), ["skey", "bucket"]).withColumns(
        {"before": F.col("bucket_before") + F.coalesce(F.sum("size").over(own), F.lit(0)), "number": F.row_number().over(order)}
    )
    quota = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most).cast("bigint")
    rows = rows.withColumn("quota", quota).withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0),
    )
    rest = F.col("quota") - F.col("rounds") * F.col("source_size")
    return rows.withColumn("taken", F.col("rounds") * F.col("size") + F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size")))


def _position(copy: Column, words: Column, schedules) -> Column:
    """Progress at the middle of a copy of a document in its source's stream."""
    share = (copy * F.col("source_size") + F.col("before") + words / 2.0) / F.col("quota")
    return _progress(share, schedules)


def _ordered(planned: DataFrame, schedules) -> DataFrame:
    """planned: of plan(), with texts. The mix: a row for each copy, in order of position; the last copy of a source may be cut short."""
    rows = planned.filter("taken > 0")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    words = F.least(F.col("taken") - F.col("copy") * F.col("size"), F.col("size"))
    placed = copies.withColumn("words", words).withColumn("position", _position(F.col("copy"), F.col("words"), schedules))
    cut = F.array_join(
        F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("words").cast("int")), "",
    )
    placed = placed.withColumn("text", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")))
    return placed.repartitionByRange(
        partitions(planned.sparkSession), "position", "h", "copy",
    ).sortWithinPartitions("position", "h", "copy")


def mixture(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, position (of its first copy; null where nothing is taken).

    taken and position are read off the mix: the words of its copies' texts, and the place of the first one in its order.
    """
    core = docs.select("doc_id", "source", "text")
    sized = stash(sizes(core).drop("source", "text"))
    streams = _streams(sized, weights, most)
    key = ["skey", "bucket", "number"]
    mixed = _ordered(plan(sizes(core).drop("source"), weights, most, streams), schedules).select(
        *key, F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n"), "position", F.monotonically_increasing_id().alias("place"),
    )
    found = mixed.groupBy(*key).agg(F.sum("n").alias("found"), F.min_by("position", "place").alias("position"))
    rows = plan(sized, weights, most, streams).join(found, key, "left")
    return rows.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.coalesce("found", F.lit(0)).cast("bigint").alias("taken"),
        F.round("position", 9).alias("position"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy, in order of position; the last copy of a source may be cut short."""
    core = ("doc_id", "source", "text")
    others = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in core}  # names that no step uses
    planned = plan(sizes(docs.select(*core, *(F.col(c).alias(k) for c, k in others.items()))), weights, most)
    ordered = _ordered(planned, schedules)
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        ordered = ordered.withColumn(
            others["n_chars"], F.when(F.col("words") < F.col("size"), F.length("text").cast(kind)).otherwise(F.col(others["n_chars"])),
        )
    return ordered.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))
