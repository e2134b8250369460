"""Texts that hold other texts, against every pair."""

import random

from caselens.operators.leakage import contained


def test_equals_every_pair(spark):
    rng = random.Random(6)
    words = ["alpha", "be", "c", "delta", "épsilon", "zeta😀x", "日本", "a", "x😀"]
    docs = [(i, "  ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 30])))) for i in range(60)] + [(60, None), (61, ""), (62, "alpha be"), (62, "alpha be"), (63, "😀")]
    items = [(k, t) for k, t in enumerate(
        ["", None, "a", "😀", "ta", "lph", "a  b", "be  c  delta", "delta  a", "😀x  be", "日本", "  ", "zz", "lpha  be  c  delta  a  be  del", *(" ".join(rng.choices(words, k=2)) for _ in range(4)), *(d[3:20] for _, d in docs[:20] if d)],
    )]
    got = contained(spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(items, "item int, text string"), "doc", "item").collect()
    want = {(d, i) for d, text in docs for i, part in items if text is not None and part and part in text}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len({i for _, i in want}) > 15


def test_no_short_items_and_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc int, text string"), spark.createDataFrame([(1, "")], "item int, text string")
    assert contained(docs, items, "doc", "item").count() == 0 == contained(docs.limit(0), items.limit(0), "doc", "item").count()
