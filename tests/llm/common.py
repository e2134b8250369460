"""Small document tables with the awkward cases that every operator has to stand."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def docs(spark, texts, extra=False):
    """texts: list of texts, or of (doc_id, text)."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
    return df.selectExpr("*", "doc_id AS sid", "text AS bucket", "1 AS n", "'x' AS kind") if extra else df


def awkward(spark):
    long = "lorem ipsum dolor sit amet " * 4000
    return docs(spark, [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "null id"), (None, None), (7, long), (8, long), (9, "Ünïcode ß 漢字   x"), (10, "a b c d e f g h i j k l")], extra=True)
