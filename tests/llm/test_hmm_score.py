import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from caselens.llm.hmm_score import CLASSES, GAIN, Model, baum_welch, begin, expect, form, forward, hmm_scores, learn, sliced
from .common import awkward, docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(rows):
    training = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            training.update([*words(t), None])
    total = sum(training.values())
    out = []
    for i, t in rows:
        own = [*words(t), None]
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(own), sum(training[w] > 0 for w in own), total, sum(math.log10((training[w] + 0.1) / (total + 0.1 * (len(training) + 1))) for w in own)))
    return out


def corpus(seed=0, n=150):
    """Two kinds of texts whose words alternate, so that order tells more than counts; rare words of all forms."""
    rng = random.Random(seed)
    kinds = [[f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)]]
    texts = []
    for _ in range(n):
        k = rng.randrange(2)
        texts.append(" ".join(rng.choice(kinds[(k + j) % 2]) if rng.random() < 0.95 else rng.choice(["Rare", "x", "9z", "éa", "--"]) + str(rng.randrange(3)) * rng.randrange(2) for j in range(rng.randint(0, 40))))
    return list(enumerate(texts))


def same(got, want):
    got, want = sorted(got, key=lambda r: str(r[:3])), sorted(want, key=lambda r: str(r[:3]))
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert all(math.isclose(r[5], w[5], abs_tol=1e-6) for r, w in zip(got, want))


def test_base_equals_brute_force(spark):
    rows = corpus()
    for symbols, hot in ((10, 15), (1000, 1000), (0, 0)):
        same(hmm_scores(docs(spark, rows), symbols=symbols, hot=hot, sweeps=1, slices=2).collect(), base(rows))


def test_model_beats_counts_on_held_out_texts(spark):
    rows = hmm_scores(docs(spark, corpus(1, 400)), symbols=30, sweeps=6, slices=4).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_awkward_rows(spark):
    same(hmm_scores(awkward(spark), sweeps=1, slices=2).collect(), base([(r[0], r[1]) for r in awkward(spark).collect()]))
    assert hmm_scores(docs(spark, []), slices=2).count() == 0
    assert all(math.isfinite(r.score) for r in hmm_scores(docs(spark, [(None, "all held out")]), slices=2).collect())


def paths(model, s):
    for p in itertools.product(range(len(model.start)), repeat=len(s)):
        yield p, model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([model.emit[x, k] for x, k in zip(s, p)])


def test_recursions_equal_the_sum_over_paths():
    rng = np.random.default_rng(2)
    model = begin(rng.integers(1, 9, 5).astype(float), 3)
    sequences = [rng.integers(0, 5, n) for n in (4, 1, 6, 2)]
    starts, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, log in zip(sequences, forward(model, sequences)):
        total = sum(w for _, w in paths(model, s))
        assert math.isclose(log, math.log10(total), rel_tol=1e-9)
        for p, w in paths(model, s):
            starts[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                moves[a, b] += w / total
            for x, k in zip(s, p):
                emissions[x, k] += w / total
    for got, want in zip(expect(model, sequences), (starts, moves, emissions)):
        assert np.allclose(got, want)


def test_a_round_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 6, rng.integers(1, 30)) for _ in range(40)]
    model, last = begin(np.ones(6), 3), -math.inf
    for _ in range(8):
        now = forward(model, sequences).sum()
        assert now >= last - 1e-9
        last = now
        s, m, e = expect(model, sequences)
        model = Model(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))
    assert [form(w) for w in ("ab", "a1", "--", "é")] == [1, 2, 3, 4] and CLASSES == 5


def test_rounds_over_all_sequences_end_when_the_gain_is_small(spark):
    rng = np.random.default_rng(4)
    sequences = [(np.arange(n) % 2 * 3 + rng.integers(0, 3, n) + rng.integers(0, 2) * 6).astype(np.uint16) for n in rng.integers(5, 40, 60)]
    table = spark.createDataFrame([(x.tobytes(),) for x in sequences], "ids binary")
    model = baum_welch(table, begin(np.bincount(np.concatenate(sequences)).astype(float), 4))
    more = baum_welch(table, model, rounds=1)
    assert forward(more, sequences).sum() - forward(model, sequences).sum() < GAIN * sum(map(len, sequences))


def test_sweeps_over_slices_learn_as_rounds_do(spark):
    rng = np.random.default_rng(6)
    sequences = [(np.arange(n) % 2 * 3 + rng.integers(0, 3, n) + rng.integers(0, 2) * 6).astype(np.uint16) for n in rng.integers(5, 40, 300)]
    table = sliced(spark.createDataFrame([(i, i * 7, x.tobytes()) for i, x in enumerate(sequences)], "doc_id bigint, text_key bigint, ids binary"), 4)
    assert table.count() == 300 and table.select("slice").distinct().count() == 4
    first = begin(np.bincount(np.concatenate(sequences)).astype(float), 4)
    tokens = sum(map(len, sequences))
    swept, rounds = (forward(m, sequences).sum() / tokens for m in (learn(table, first, slices=4), baum_welch(table, first)))
    assert swept > rounds - 0.02 and swept > forward(first, sequences).sum() / tokens + 0.1
    assert learn(table.limit(0), first, slices=4) is first


def test_long_common_words_are_known_by_digest(spark):
    rule = "-" * 60
    rows = [(i, f"{rule} word{i % 3} {'=' * (50 + i % 2)} {rule}") for i in range(40)]
    for hot in (0, 1000):
        same(hmm_scores(docs(spark, rows), symbols=4, hot=hot, sweeps=1, slices=2).collect(), base(rows))
