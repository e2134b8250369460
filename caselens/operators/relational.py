"""Joins with guards, reconciliation, set operations and violation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, on, how)


def with_fallback(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Left join in which columns of the right side take precedence over the left's."""
    renamed = right.select(*on, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = left.join(renamed, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).drop(*(f"__{c}" for c in columns))


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of the left side that the right one lacks."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """(on, status): keys that are missing or unexpected."""
    return missing(expected, actual, on).withColumn("status", F.lit("missing")).unionByName(
        missing(actual, expected, on).withColumn("status", F.lit("unexpected"))
    )


def require_empty(df: DataFrame, message: str) -> None:
    """Fails with a few examples, if a guard's table has rows."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{message}: {', '.join(str(tuple(r)) for r in rows)}")


def duplicates(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).count().filter("count > 1")


def common_subjects(df: DataFrame, subject: str, config: str) -> DataFrame:
    """Rows of the subjects that every configuration has."""
    configs = df.select(F.count_distinct(config)).first()[0]
    whole = df.groupBy(subject).agg(F.count_distinct(config).alias("k")).filter(F.col("k") == configs).select(subject)
    return df.join(whole, subject, "left_semi")


def paired(df: DataFrame, subject: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """(subject, a, b): both arms' mean value in one aggregation, for subjects that have both."""
    side = lambda name: F.avg(F.when(F.col(arm) == name, F.col(value)))
    return df.filter(F.col(arm).isin(a, b)).groupBy(subject).agg(
        side(a).alias("a"), side(b).alias("b"),
    ).filter("a IS NOT NULL AND b IS NOT NULL")


def pairs(names: DataFrame, name: str) -> DataFrame:
    """Unordered pairs of a small dimension."""
    return names.select(F.col(name).alias("first")).join(
        F.broadcast(names.select(F.col(name).alias("second"))), F.col("first") < F.col("second"),
    )


#: Rows of a key on each side that are paired in one place.
BLOCK_ROWS = 2_000


def _partitions(df: DataFrame) -> int:
    """A number of partitions that is kept as it is: by bytes alone, small rows that make many would end up in few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def any_key_matches(
    left: DataFrame, right: DataFrame, keys: list[str], id_left: str, id_right: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id_left, id_right, reason): pairs that agree in any key; a join for each key, never one with OR.

    Rows are made distinct before they are paired, so pairs are neither gathered nor exchanged, but those of ids that have
    several values of the key on both sides. Both sides of a key with many rows are cut into blocks, each pair of which is a
    key of its own: tasks hold a block, and large keys are shared out.
    """
    at = ["__key", "__l", "__r"]

    def side(df: DataFrame, k: str, i: str, name: str, several: str) -> DataFrame:
        rows = df.filter(F.col(k).isNotNull()).select(F.col(i).alias(name), F.col(k).alias("__key")).repartition(name).distinct()
        return rows.withColumn(several, F.count("*").over(Window.partitionBy(name)) > 1)

    def part(k: str) -> DataFrame:
        a, b = side(left, k, id_left, "left_id", "__s"), side(right, k, id_right, "right_id", "__t")
        both = a.select("__key", F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select("__key", F.lit(0).alias("__a"), F.lit(1).alias("__b")))
        blocks = lambda c: F.ceil(F.sum(c) / block_rows).cast("int").alias(c)
        large = F.broadcast(both.groupBy("__key").agg(blocks("__a"), blocks("__b")).filter("__a > 0 AND __b > 0 AND __a + __b > 2"))

        def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
            rows = df.join(large, "__key", "left")
            block = F.coalesce(F.pmod(F.xxhash64(df.columns[0]), F.col(own_n)).cast("int"), F.lit(0))
            every = F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1)
            return rows.select(*df.columns, block.alias(own), F.explode(every).alias(other)).repartition(_partitions(df), *at)

        def paired_up(a: DataFrame, b: DataFrame) -> DataFrame:
            return dealt(a, "__l", "__a", "__r", "__b").hint("merge").join(dealt(b, "__r", "__b", "__l", "__a"), at)

        once, often = paired_up(a, b).filter("NOT (__s AND __t)"), paired_up(a.filter("__s"), b.filter("__t"))
        columns = ["left_id", "right_id", F.lit(k).alias("reason")]
        return once.select(*columns).unionByName(often.select(*columns).distinct())

    return reduce(DataFrame.unionByName, map(part, dict.fromkeys(keys)))


def first_by_priority(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, by an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def complement(cases: DataFrame, held: DataFrame, case: str, fold: str) -> DataFrame:
    """(fold, case) of all cases outside each fold's own; folds are few."""
    every = held.agg(F.array_sort(F.collect_set(fold)).alias("__every"))  # one row
    own = held.groupBy(case).agg(F.collect_set(fold).alias("__own"))
    rows = cases.select(case).distinct().join(own, case, "left").crossJoin(F.broadcast(every))
    outside = F.array_except("__every", F.coalesce("__own", F.slice("__every", 1, 0)))
    return rows.select(F.explode(outside).alias(fold), case)


def common(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, tables)


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def split_violations(splits: DataFrame, cases: DataFrame, case: str, center: str) -> DataFrame:
    """(kind, fold, item) of everything wrong with a split: splits has fold, subset (train or val) and the case.

    Kinds: duplicate, unknown, overlap, incomplete, empty, center leak, coverage.
    """
    row = lambda df, kind, fold, item: df.select(
        F.lit(kind).alias("kind"), fold.cast("int").alias("fold"), item.cast("string").alias("item"),
    )
    fold, item = F.col("fold"), F.col(case)
    # Rows of a case are brought together first, in a fixed number of tasks, so that no task counts the cases of a whole file.
    splits, cases = (df.repartition(_partitions(df), case) for df in (splits.select("fold", "subset", case), cases.select(case, center)))
    labelled = splits.hint("merge").join(cases, case)
    sides = labelled.groupBy("fold", center).agg((F.min("subset") != F.max("subset")).alias("both")).filter("both")
    folds = splits.groupBy("fold").agg(F.count_if(F.col("subset") == "val").alias("__val"))
    every = folds.agg(F.array_sort(F.collect_set("fold")).alias("__every"))  # one row
    held = splits.groupBy(case).agg(F.collect_set("fold").alias("__held"), F.count_if(F.col("subset") == "val").alias("__val"))
    covered = cases.select(case).hint("merge").join(held, case, "left").filter(F.coalesce("__val", F.lit(0)) != 1)
    lacking = cases.select(case).distinct().hint("merge").join(held, case, "left").crossJoin(F.broadcast(every))
    lacking = lacking.select(
        F.explode(F.array_except("__every", F.coalesce("__held", F.array_except("__every", "__every")))).alias("fold"), case,
    )
    crossed = splits.groupBy("fold", case).agg(
        F.count_if(F.col("subset") == "val").alias("__val"), F.count_if(F.col("subset") == "train").alias("__train"),
    ).filter("__val > 0 AND __train > 0")
    return reduce(
        DataFrame.unionByName,
        [
            row(duplicates(splits, ["fold", "subset", case]), "duplicate", fold, item),
            row(splits.hint("merge").join(cases.select(case), case, "left_anti"), "unknown", fold, item),
            row(crossed, "overlap", fold, item),
            row(lacking, "incomplete", fold, item),
            row(folds.filter("__val = 0 OR fold IS NULL"), "empty", fold, F.lit("val")),
            row(sides, "center leak", fold, F.col(center)),
            row(covered, "coverage", F.lit(None), item),
        ],
    )


def record_violations(cases: DataFrame, case: str, center: str) -> DataFrame:
    """(kind, item): missing ids, repeated ids, blank centers."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    item = F.col(case).cast("string").alias("item")
    return (
        cases.filter(blank(case)).select(F.lit("missing id").alias("kind"), F.lit("").alias("item"))
        .unionByName(duplicates(cases.filter(~blank(case)), [case]).select(F.lit("duplicate id").alias("kind"), item))
        .unionByName(cases.filter(blank(center)).select(F.lit("blank center").alias("kind"), item))
    )


def reuse(now: DataFrame, before: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """now with ``action``: reuse where all version columns equal the previous manifest's, else convert."""
    old = before.select(key, *(F.col(v).alias(f"__{v}") for v in versions))
    joined = now.join(old, key, "left")
    same = reduce(lambda a, b: a & b, (F.col(v).eqNullSafe(F.col(f"__{v}")) for v in versions))
    return joined.withColumn("action", F.when(same, "reuse").otherwise("convert")).drop(*(f"__{v}" for v in versions))


def skip_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with ``reason``: the first rule that holds, else NULL."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return df.withColumn("reason", out)


def certificate(df: DataFrame, keys: list[str], row: list[str], size: str | None = None, digits: int = 2) -> DataFrame:
    """Inventory of each collection: number of rows, total of a size column, and a SHA-256 of its sorted rows, as a tree.

    A row's text is its columns joined by commas. Rows are dealt by the first
    digits of their own hashes; a leaf is the hash of its rows' sorted hashes, the
    root the hash of the leaves in order. The result depends on the rows alone,
    not on their order, and no task gathers a collection: with more rows take more digits.
    """
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in row))
    hashed = df.select(
        *keys, F.sha2(text, 256).alias("__h"), (F.col(size) if size else F.lit(0)).alias("__size"),
    ).withColumn("__leaf", F.substring("__h", 1, digits))
    leaves = hashed.groupBy(*keys, "__leaf").agg(
        F.count("*").alias("n"), F.sum("__size").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ""), 256).alias("__of"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__leaf", "__of"))), lambda x: x["__of"])
    return leaves.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("bytes").cast("bigint").alias("bytes"), F.sha2(F.array_join(ordered, ""), 256).alias("content_sha256"),
    )


def reconcile_values(expected: DataFrame, actual: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """(on, field, expected, actual) for every value that differs; rows that one side lacks have a NULL there. Values are compared as text."""
    named = lambda df, side: df.select(
        *on, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(side)) for c in columns))).alias("__v"),
    ).select(*on, "__v.*")
    both = named(expected, "expected").join(named(actual, "actual"), [*on, "field"], "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).select(*on, "field", "expected", "actual")


def lineage_faults(recorded: DataFrame, actual: DataFrame, lists: dict[str, tuple[DataFrame, DataFrame]], item: str) -> DataFrame:
    """(kind, item, detail): all that a run's record and its artefacts disagree in. recorded and actual: key, value.

    lists: name -> (expected, found) tables of items; every failure is a row, none stops the others.
    """
    values = reconcile_values(recorded, actual, ["key"], ["value"])
    shown = F.concat_ws(" <> ", F.coalesce("expected", F.lit("none")), F.coalesce("actual", F.lit("none")))
    out = values.select(F.lit("value").alias("kind"), F.col("key").cast("string").alias("item"), shown.alias("detail"))
    for name, (expected, found) in lists.items():
        sets = reconcile(expected, found, [item])
        out = out.unionByName(
            sets.select(F.lit(name).alias("kind"), F.col(item).cast("string").alias("item"), F.col("status").alias("detail"))
        )
    return out


def identity_conflicts(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right): ids that stand for different things in two collections."""
    a, b = left.select(key, F.col(value).alias("left")).distinct(), right.select(key, F.col(value).alias("right")).distinct()
    return a.join(b, key).filter(~F.col("left").eqNullSafe(F.col("right")))


def coverage(df: DataFrame, config: str, subject: str) -> DataFrame:
    """(config, n_subjects, uneven): uneven where configurations differ in the number of subjects."""
    counts = df.groupBy(config).agg(F.count_distinct(subject).alias("n_subjects"))
    span = counts.agg((F.max("n_subjects") != F.min("n_subjects")).alias("uneven"))
    return counts.crossJoin(F.broadcast(span))  # one row


def count_gate(files: DataFrame, splits: DataFrame) -> DataFrame:
    """One row: the number of files over all folders against the number of validation cases over all folds."""
    found, wanted = files.agg(F.count("*").alias("n_files")), splits.filter("subset = 'val'").agg(F.count("*").alias("n_cases"))
    return found.crossJoin(wanted).withColumn("ok", F.col("n_files") == F.col("n_cases"))  # one row each


def with_predictions(cases: DataFrame, predictions: DataFrame, on: list[str], counts: list[str], missing: str = "skip") -> DataFrame:
    """Cases with the counts of their predictions. missing: "skip" leaves out cases without any, "empty" counts 0, "error" fails."""
    if missing not in ("skip", "empty", "error"):
        raise ValueError(f"unknown policy: {missing}")
    if missing == "error":
        require_empty(cases.select(*on).join(predictions.select(*on), on, "left_anti"), "cases without a prediction")
    joined = cases.join(predictions.select(*on, *counts), on, "left" if missing == "empty" else "inner")
    return joined.fillna(0, counts) if missing == "empty" else joined


def manifest_status(manifest: DataFrame, tables: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """manifest with ``lacks``: the names of the tables that have no row for a case, joined by commas; empty where it is complete."""
    out = manifest
    for name, table in tables.items():
        out = out.join(table.select(*on).distinct().withColumn(f"__{name}", F.lit(True)), on, "left")
    lacks = F.array_compact(F.array(*(F.when(F.col(f"__{name}").isNull(), F.lit(name)) for name in tables)))
    return out.withColumn("lacks", F.array_join(lacks, ",")).drop(*(f"__{name}" for name in tables))


def verify_collections(manifest: DataFrame, collections: dict[str, DataFrame], on: str) -> DataFrame:
    """(collection, kind, item): where a collection isn't the manifest's set of cases; none if all of them are.

    Kinds: missing, unexpected, duplicate (also of the manifest itself, whose name is "manifest"). All collections are
    compared in one exchange; ids that are NULL are unexpected everywhere.
    """
    names = ["manifest", *collections]
    tagged = reduce(DataFrame.unionByName, (
        df.select(F.col(on).alias("__item"), F.lit(k).alias("__of")) for k, df in enumerate((manifest, *collections.values()))
    ))
    counts = tagged.groupBy("__item").agg(*(F.count_if(F.col("__of") == k).alias(f"__n{k}") for k in range(len(names))))
    known = (F.col("__n0") > 0) & F.col("__item").isNotNull()
    faults = []
    for k, name in enumerate(names):
        n, row = F.col(f"__n{k}"), lambda kind, name=name: F.struct(F.lit(name).alias("collection"), F.lit(kind).alias("kind"))
        faults += [F.when(known & (n == 0), row("missing")), F.when(~known & (n > 0), row("unexpected")), F.when(n > 1, row("duplicate"))]
    each = counts.select(F.explode(F.array_compact(F.array(*faults))).alias("__f"), F.col("__item").cast("string").alias("item"))
    return each.select("__f.*", "item")


def report_status(folders: DataFrame, reports: DataFrame, metas: DataFrame, on: str, valid_report: Column, valid_meta: Column) -> DataFrame:
    """(on, status) of every folder of results: ok, no report, undeclared (a report without a description), or what is no object.

    valid_report and valid_meta are conditions on the rows of reports and metas.
    """
    r = reports.groupBy(on).agg(F.max(F.coalesce(valid_report, F.lit(False))).alias("__report"))
    m = metas.groupBy(on).agg(F.max(F.coalesce(valid_meta, F.lit(False))).alias("__meta"))
    joined = folders.select(on).distinct().join(r, on, "left").join(m, on, "left")
    status = (
        F.when(F.col("__report").isNull(), "no report").when(F.col("__meta").isNull(), "undeclared")
        .when(~F.col("__meta"), "bad description").when(~F.col("__report"), "bad report").otherwise("ok")
    )
    return joined.select(on, status.alias("status"))


def declared_reports(status: DataFrame, on: str, allow_undeclared: bool = False) -> DataFrame:
    """The folders of a leaderboard, from report_status(); undeclared ones are an error that names them, unless they are allowed to be left out."""
    if not allow_undeclared:
        require_empty(status.filter("status = 'undeclared'").select(on), "results without a description")
    return status.filter("status = 'ok'").select(on)
