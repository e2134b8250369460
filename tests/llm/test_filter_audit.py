import random
import re
from collections import Counter
from itertools import permutations

import duckdb

from caselens.llm.filter_audit import cells, filter_audit, parity_sums
from caselens.llm.queries import ORACLES, QUERIES
from .common import DOCS, awkward, docs

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Each order applied from left to right, document by document."""
    failing = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        own = [x for x in labels if i is not None and x[0] == i]
        failing.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out = {}
    every, shapley = Counter(), Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in failing}:
            left = [x for x in failing if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                out[part, "".join(order), step] = [len(left), len(now), sum(f in x[1] for x in gone), sum(x[0] == part and x[1] == {f} for x in failing), sum(x[2] for x in now), sum(x[3] for x in now)]
                every[part, "".join(order), step] = f
                shapley[part, f] += len(now)
                gone += now
    return {k: (*v, shapley[k[0], every[k]]) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_equals_orders_applied_one_by_one(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "d#lta", "eps", "zeta", "ETA", "theta|", *(f"w{i}" for i in range(300))]
    texts = [" ".join(rng.choices(words[: rng.choice([8, 30, 308])], k=rng.choice([0, 5, 99, 100, 130]))) for _ in range(40)]
    rows = [(rng.choice([None, 3, *range(200)]), rng.choice([*texts, None, ""]), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in range(0, 220, 2)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    got = result(filter_audit(df, spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)
    assert len({v[0] for v in got.values()}) > 5 and any(v[2] for v in got.values()) and any(v[4] for v in got.values()) and any(v[5] for v in got.values())


def test_cells_are_the_counts_of_masks(spark):
    rng = random.Random(1)
    rows = [("p", rng.random() < 0.3, rng.random() < 0.3, rng.randrange(32)) for _ in range(500)]
    df = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int")
    r = cells(parity_sums(df, 5), ["every", "good", "toxic"], 5).first()
    assert r.every == [sum(x[3] == m for x in rows) for m in range(32)]
    assert r.good == [sum(x[3] == m and x[1] for x in rows) for m in range(32)]
    assert r.toxic == [sum(x[3] == m and x[2] for x in rows) for m in range(32)]


def test_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLES["op11_filter_audit"])
    got = QUERIES["op11_filter_audit"](spark, SF)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(5, 1, None), (99, 1, 1)], LABELS)
    rows = [(r.doc_id, r.text, r.lang) for r in awkward(spark).collect()]
    assert result(filter_audit(awkward(spark), labels.selectExpr("*", "1 AS part", "2 AS mask"))) == brute(rows, [(5, 1, None), (99, 1, 1)])
    assert filter_audit(docs(spark, []), labels).count() == 0
    assert filter_audit(docs(spark, ["a"]), labels.limit(0)).count() == 600
