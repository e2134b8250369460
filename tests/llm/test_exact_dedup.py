import hashlib
import random
from collections import defaultdict

from caselens.llm.exact_dedup import exact_dedup
from .common import awkward, docs


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(0)
    rows = [(i * 7 % 1009, rng.choice(["hot"] * 40 + [None, "", "é"] + [f"t{k}" for k in range(300)])) for i in range(900)]
    assert sorted(map(tuple, exact_dedup(docs(spark, rows)).drop("in_history").collect()), key=str) == brute(rows)


def test_history_of_its_own(spark):
    old, new = [(i, f"t{i % 50}") for i in range(100)], [(100 + i, f"t{i}") for i in range(80)]
    rows = exact_dedup(docs(spark, new), docs(spark, old)).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute(old + new)
    assert {r.text_sha256 for r in rows if r.in_history} == {hashlib.sha256(f"t{i}".encode()).hexdigest() for i in range(50)}


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward(spark).collect()]
    assert sorted(map(tuple, exact_dedup(awkward(spark)).drop("in_history").collect()), key=str) == brute(rows)
    assert exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup(docs(spark, [(1, "x")]), docs(spark, [])).count() == 1
