"""Texts that hold other texts: candidates by hashed windows of words, each verified as a substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stash

#: Words of a window. A contained text's first and last word may be parts of words, so only those between are whole.
WINDOW = 4
#: Keys of the smaller side that are broadcast at most.
MOST_KEYS = 1_000_000


def _words(text: str) -> Column:
    return F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")


def _grams(text: str, n: int) -> Column:
    """All n successive characters of a text; none if it is shorter."""
    chars = F.split(F.col(text), "")
    gram = lambda i: F.array_join(F.slice(chars, i, n), "")
    return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))), gram)).otherwise(
        F.array().cast("array<string>")
    )


def contained(docs: DataFrame, items: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item) where the document's text holds the item's as a substring.

    Items with WINDOW whole words inside meet documents by the hash of their
    first such window; a document's windows are looked up among the items' (a
    broadcast while these are at most MOST_KEYS) before anything is exchanged.
    Shorter items meet the documents by their longest whole word; those without
    one, which may start and end inside a word, by their first three characters,
    or the first one if they have no more than two. NULL texts hold nothing, and
    an empty item is in no document.
    """
    wanted = items.filter(F.col("text").isNotNull()).select(item, F.col("text").alias("__item")).withColumn("__w", _words("__item"))
    inner = F.slice("__w", 2, F.greatest(F.size("__w") - 2, F.lit(0)))
    wanted = stash(wanted.withColumn("__inner", inner).drop("__w"))
    rows = docs.filter(F.col("text").isNotNull()).select(doc, "text")
    whole = F.col("text").contains(F.col("__item"))

    def meet(keyed: DataFrame, keys: Column) -> DataFrame:
        few = keyed.count() <= MOST_KEYS
        names = keyed.select("__key").distinct()
        exploded = rows.select(doc, F.explode(F.array_distinct(keys)).alias("__key"))
        near = exploded.join(F.broadcast(names) if few else names, "__key", "left_semi")
        pairs = near.join(F.broadcast(keyed) if few else keyed, "__key").select(doc, item, "__item").distinct()
        return pairs.join(rows, doc).filter(whole).select(doc, item)

    long = wanted.filter(F.size("__inner") >= WINDOW)
    windows = F.transform(
        F.sequence(F.lit(1), F.size("__d") - WINDOW + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.col("__d"), i, WINDOW), " ")),
    )
    of_doc = F.when(F.size("__d") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))
    rows_with_words = rows.withColumn("__d", _words("text"))

    def by_window() -> DataFrame:
        keyed = long.select(item, "__item", F.xxhash64(F.array_join(F.slice("__inner", 1, WINDOW), " ")).alias("__key"))
        few = keyed.count() <= MOST_KEYS
        side = F.broadcast(keyed) if few else keyed
        near = rows_with_words.select(
            doc, F.explode(F.array_distinct(of_doc)).alias("__key"),
        ).join(side, "__key").select(doc, item, "__item").distinct()
        return near.join(rows, doc).filter(whole).select(doc, item)

    found = by_window()
    short = wanted.filter((F.size("__inner") > 0) & (F.size("__inner") < WINDOW))
    if not short.isEmpty():
        longest = F.element_at(F.array_sort(F.transform("__inner", lambda w: F.struct(-F.length(w), w.alias("w")))), 1)["w"]
        found = found.unionByName(meet(short.select(item, "__item", longest.alias("__key")), _words("text")))
    bare = wanted.filter((F.size("__inner") == 0) & (F.char_length("__item") > 0))
    for n, part in ((3, bare.filter(F.char_length("__item") >= 3)), (1, bare.filter(F.char_length("__item") < 3))):
        if not part.isEmpty():
            found = found.unionByName(meet(part.select(item, "__item", F.get(_grams("__item", n), F.lit(0)).alias("__key")), _grams("text", n)))
    return found.distinct()
