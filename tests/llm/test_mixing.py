import math
import random
import re

import pytest

from caselens.llm.mixing import SCHEDULES, invert_demand, mix, mixture
from .common import DOCS, awkward, docs


def targets(totals):
    """Repeated resharing, as the task states it."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, fixed = {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(totals.values()) - sum(3 * totals[s] for s in fixed)
        target = {s: 3 * totals[s] if s in fixed else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = [s for s in free if target[s] > 3 * totals[s]]
        if not over:
            return target
        fixed |= set(over)


def table(spark, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), "en", rng.choice(["a"] * 30 + ["b", "B", "é", None, "c", "zz"]), 0) for i in range(400)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_targets_and_takes(spark):
    rows, df = table(spark)
    size = {i: len(re.findall(r"\S+", t)) for i, t, *_ in rows}
    totals = {}
    for i, _, _, s, _ in rows:
        totals[s] = totals.get(s, 0) + size[i]
    want = targets(totals)
    assert any(want[s] == 3 * totals[s] for s in totals) and any(want[s] < 3 * totals[s] for s in totals)
    got = {r.doc_id: r for r in mixture(df).collect()}
    assert [tuple(r) for r in sorted(mixture(df.repartition(7)).collect())] == [tuple(got[i]) for i in sorted(got)]
    taken = {s: 0 for s in totals}
    for i, _, _, s, _ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], totals[s]) and math.isclose(r.target, want[s], abs_tol=1e-5) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in totals)


def test_the_mix_holds_what_was_taken(spark):
    rows, df = table(spark, 1)
    out = mix(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixture(df).collect() if r.taken}


@pytest.mark.parametrize("knots", SCHEDULES)
def test_inverse_of_the_integral(spark, knots):
    def weight(u):
        for (a, x), (b, y) in zip(knots, knots[1:]):
            if a <= u <= b:
                return x + (y - x) * (u - a) / (b - a)

    steps = 2000
    area, want = 0.0, {}
    whole = sum(weight((k + 0.5) / steps) for k in range(steps)) / steps
    for k in range(steps):
        area += weight((k + 0.5) / steps) / steps / whole
        want[k + 1] = area
    df = spark.createDataFrame([(k, want[k]) for k in range(1, steps, 97)], "k int, share double")
    for r in df.select("k", invert_demand(df.share, knots).alias("u")).collect():
        assert abs(r.u - r.k / steps) < 1e-3


def test_awkward_rows(spark):
    got = {(r.doc_id, r.size): r.taken for r in mixture(awkward(spark)).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == 0
    assert mix(awkward(spark)).columns == awkward(spark).columns
    assert mixture(docs(spark, [])).count() == 0 and mix(docs(spark, [])).count() == 0


def test_the_query_reads_the_ordered_mix(spark):
    """taken and position come from the copies in their range-sorted order, equal rows included."""
    rows, df = table(spark, 2)
    twice = spark.createDataFrame(rows[:50] * 2 + rows[50:], DOCS)
    found = mixture(twice)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [position" in text and "Generate explode" in text and "Sort [position" in text
    words = {}
    for r in mix(twice).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    taken = {}
    for r in found.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {i: n for i, n in taken.items() if n} == words and found.count() == len(rows) + 50
