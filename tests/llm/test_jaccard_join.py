import random
import re

import pytest

from caselens.llm.jaccard_join import jaccard_join, keep_one
from .common import awkward, docs


def brute(rows):
    """{doc_id: (n, component)} for distinct doc_ids, by all pairs."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    """Near copies around every threshold, chains, shared passages, exact copies, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k].upper(), rng.choice(vocabulary)]])
            texts.append(" ".join(words) or "x")
        elif kind < 0.75:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
            texts.append(" ".join(own + passage))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 30, 100, 200]))))
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("max_group,common", [(4096, 16), (8, 16), (4096, 2), (8, 3)])
def test_equals_brute_force(spark, max_group, common):
    rows = corpus(3)
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 40
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs(spark, rows), max_group, common).collect()}
    assert got == want


def test_awkward_rows(spark):
    got = [tuple(r) for r in jaccard_join(awkward(spark)).collect()]
    assert len(got) == 12
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (None, 0, None) in got
    assert got.count((5, 1, 4)) == 2 and (4, 1, 4) in got and (8, 5, 7) in got and (None, 1, None) in got
    assert jaccard_join(docs(spark, [])).count() == 0


def test_keep_one(spark):
    kept = keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())[-7:] == [(True, i) for i in (1, 2, 3, 4, 7, 9, 10)]


def test_keep_one_drops_only_what_is_linked(spark):
    """Null and repeated doc_ids name no document: unlinked texts under one id all stay, near copies go whatever their id."""
    assert [r.text for r in keep_one(awkward(spark)).collect() if r.doc_id is None].count("null id") == 1
    assert len(keep_one(awkward(spark)).filter("doc_id IS NULL").collect()) == 2
    words = [f"w{k}" for k in range(80)]
    near = " ".join([*words[:79], "other"])
    rows = [(None, "a lone text without id"), (None, "and one more of them"), (None, None), (None, ""), (3, "first under three"), (3, "second under three"), (3, ""), (3, " "), (1, " ".join(words)), (2, near), (2, "kept under two"), (None, near), (7, "twice the same"), (7, "twice the same"), (None, "lost ID twice"), (None, "lost id  twice")]
    kept = [(r.doc_id, " ".join((r.text or "").lower().split())) for r in keep_one(docs(spark, rows)).collect()]
    want = [(None, "a lone text without id"), (None, "and one more of them"), (None, ""), (None, ""), (3, "first under three"), (3, "second under three"), (3, ""), (3, ""), (1, " ".join(words)), (2, "kept under two"), (7, "twice the same"), (None, "lost id twice")]
    assert sorted(kept, key=str) == sorted(want, key=str)
