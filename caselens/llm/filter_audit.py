"""How filters interact: what each one removes, alone and in every order, from signed parity sums.

Each document has a mask of the filters that it fails. Per part and label, 2^n
sums over documents of +1 or -1 (the parity of the mask within a subset of
filters: the Walsh-Hadamard transform of the counts of masks) are all that is
gathered; the inverse transform gives the exact number of documents of each
mask. Every figure of every order of the filters is then a sum over masks: what
is kept after some filters are the masks that meet none of them. Summed over all
n! orders, a document that fails k filters is removed n! / k times by each of
them, so Shapley values need no orders.

A text is the same as another by SHA-256 of its bytes; the groups of copies are
joined back by ``look_up()``, which broadcasts the largest. Ids join with labels;
rows without an id are spread by their text.

Edge cases: a null text counts as empty, which has no words and fails A alone; a
null lang is the part ''; a null doc_id has no label, is not smaller than any
other and has none that is smaller, so it never fails E; rows repeated with
doc_id fail E or not together; several labels of one doc_id count once, as good
(toxic) if any says so; labels without a document don't count. An empty table
has no parts and so no rows.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import look_up, stash, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask) of each document; bit k of the mask: it fails the k-th filter of text_filters(), and of COPY after them."""
    filters = text_filters(text_or_empty()).values()
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), digest.alias("digest"),
        sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters)), F.lit(0)).alias("mask"),
    ).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.hex("digest"))))
    by_doc = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        *(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))),
    )
    rows = stash(rows.join(by_doc, "key", "left").drop("key").fillna(False, ["good", "toxic"]))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    found = look_up(rows, first, "digest", "copies", rows.count())
    copy = F.when(F.col("doc_id") > F.col("first_id"), 1 << len(filters)).otherwise(0)
    return found.select("part", "good", "toxic", (F.col("mask") + copy).alias("mask"))


def _odd(value: Column) -> Column:
    return F.bit_count(value) % 2


def parity_sums(rows: DataFrame, n: int) -> DataFrame:
    """(part, kept, good, toxic): for all documents and those of each label, arrays of 2^n sums of +1 and -1, by subset of filters."""
    sums = rows.groupBy("part", "good", "toxic").agg(
        F.array(*(F.sum((1 - 2 * _odd(F.col("mask").bitwiseAND(F.lit(s)))).cast("bigint")) for s in range(1 << n))).alias("w"),
    )
    of = lambda holds: F.array(*(F.sum(F.when(holds, F.col("w")[s]).otherwise(0)) for s in range(1 << n)))
    return sums.groupBy("part").agg(
        of(F.lit(True)).alias("every"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"),
    )


def cells(sums: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The inverse transform of each column: how many documents have each mask. n steps of sums and differences, then an exact division."""
    for k in range(n):
        bit = 1 << k
        half = lambda c: F.transform(
            c, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) == 0, x + F.get(c, i + bit)).otherwise(F.get(c, i - bit) - x),
        )
        sums = sums.withColumns({c: half(F.col(c)) for c in columns})
    whole = lambda x: F.when(F.pmod(x, F.lit(1 << n)) == 0, F.shiftright(x, n)).otherwise(
        F.raise_error(F.lit("parity sums of no counts")).cast("bigint")
    )
    return sums.withColumns({c: F.transform(c, whole) for c in columns})


def _total(counts: Column, weight) -> Column:
    """The sum of counts[i] * weight(i)."""
    return F.aggregate(F.transform(counts, lambda x, i: x * weight(i)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """counts: of cells(). One row for each part, order of the filters and step."""
    n = len(letters)
    every = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    rows = counts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    mask = lambda text: sum((F.when(F.instr(text, c) > 0, 1 << k).otherwise(0) for k, c in enumerate(letters)), F.lit(0))
    rows = rows.withColumns({
        "before": mask(F.substring("filter_order", F.lit(1), F.col("step") - 1)), "own": mask(F.substring("filter_order", F.col("step"), F.lit(1))),
    })
    before, own = F.col("before"), F.col("own")
    after = before.bitwiseOR(own)
    meets = lambda i, m: i.bitwiseAND(m) != 0
    count = lambda c, holds: _total(F.col(c), lambda i: holds(i).cast("bigint"))
    removed = lambda i: meets(i, own) & ~meets(i, before)
    share = F.array(F.lit(0), *(F.lit(math.factorial(n) // k) for k in range(1, n + 1)))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), count("every", lambda i: ~meets(i, after)).alias("kept"),
        count("every", removed).alias("removed"), count("every", lambda i: meets(i, own) & meets(i, before)).alias("redundant"),
        count("every", lambda i: i == own).alias("unique_fails"), count("good", removed).alias("good_lost"), count("toxic", removed).alias("toxic_lost"),
        _total(F.col("every"), lambda i: F.when(meets(i, own), F.get(share, F.bit_count(i))).otherwise(0).cast("bigint")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every order of the filters."""
    letters = "".join(text_filters(F.lit(""))) + COPY
    sums = parity_sums(masked(docs, labels), len(letters))
    return orders(cells(sums, ["every", "good", "toxic"], len(letters)), letters)
