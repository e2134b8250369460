import hashlib
import random
import re

import pytest

from caselens.llm import decontaminate as module
from caselens.llm.decontaminate import contamination, decontaminate
from .common import awkward, docs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, own = words(text), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                if (found := windows.get(tuple(w[k : k + length]))) is not None:
                    hit |= set(range(k, k + length))
                    own |= found
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "Γάμμα", "δ", "x1", "42", "é", "naïve", "the", "of"]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", " _ "]) for _ in range(n))
    items = [(k, prose(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(12, None), (13, " ... "), (3, prose(12))]
    rows = []
    for i in range(150):
        text = prose(rng.randint(0, 40))
        if rng.random() < 0.5 and (item := rng.choice(items)[1]):
            text += item.upper() if rng.random() < 0.3 else item[rng.randrange(4) :]
        rows.append((i, text + prose(rng.randint(0, 5))))
    return rows, items


@pytest.mark.parametrize("most", [200_000, 20])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(module, "MAX_WINDOWS", most)
    rows, items = corpus(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(rows, items)
    assert 20 < sum(x[5] for x in want)
    assert sorted(map(tuple, contamination(docs(spark, rows), bench).collect()), key=str) == want


def test_modes(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short one")], "item_id bigint, text string")
    rows = [(1, "A clean text."), (2, "x ONE two, three four five six seven eight nine ten; y"), (3, "short, one!"), (4, None)]
    assert sorted(r.doc_id for r in decontaminate(docs(spark, rows), bench).collect()) == [1, 4]
    cut = {r.doc_id: r.text for r in decontaminate(docs(spark, rows), bench, mode="spans").collect()}
    assert cut == {1: "A clean text.", 2: "x ; y", 3: "!", 4: None}


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward(spark).collect()]
    items = [(1, "one"), (2, "null id"), (3, ""), (4, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, contamination(awkward(spark), bench).collect()), key=str) == brute(rows, items)
    assert decontaminate(awkward(spark), bench).columns == awkward(spark).columns
    assert contamination(docs(spark, []), bench).count() == 0 and contamination(awkward(spark), bench.limit(0)).filter("contaminated").count() == 0


def test_a_window_of_very_many_items_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(module, "MAX_BYTES", 400)
    items = [(k, "one two three") for k in range(60)] + [(60, "four five " * 30)]
    rows = [(1, "zero one two three"), (2, "four five " * 12), (2, "four five " * 12), (None, None), (5, "one two")]
    table = docs(spark, rows).selectExpr("*", "1 AS __row", "2 AS __hits")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(module._blocks(bench, 10)) > module.BLOCKS_AT_ONCE
    assert sorted(map(tuple, contamination(table, bench).collect()), key=str) == brute(rows, items)
    kept = decontaminate(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5]
    assert contamination(table.limit(0), bench).count() == 0
