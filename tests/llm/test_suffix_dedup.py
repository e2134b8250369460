import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from caselens.llm.suffix_dedup import LoserTree, anchors, cover, decode, deduplicated, front_code, shared_prefix, suffix_dedup
from .common import awkward, docs


def brute(rows, length, report=None):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[k : k + length] for _, raw in raws for k in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    if report:  # the bytes that strings of the shorter length cover, as one more column
        out = [(*x, y[2]) for x, y in zip(out, brute(rows, report))]
    return sorted(out, key=str) if report else out


def corpus(seed, length):
    """Passages around the length, shared by many, edited copies, copies, periodic texts, characters of several bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(length // 5, length // 3)) for _ in range(6)]
    texts = [None, "", "ab" * length, "a" * (3 * length), prose(30) * 4]
    for _ in range(70):
        kind = rng.random()
        if kind < 0.5:
            p = rng.choice(passages)
            a, b = rng.randrange(0, 20), rng.randrange(0, 20)
            texts.append(prose(rng.randint(0, 60)) + p[a : len(p) - b] + prose(rng.randint(0, 60)))
        elif kind < 0.8 and len(texts) > 6:
            t = list(rng.choice(texts[5:]))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        else:
            texts.append(prose(rng.randint(1, 150)))
    return list(enumerate(texts))


@pytest.mark.parametrize("length,report,k,max_group", [(60, 40, 16, 20_000), (60, 40, 16, 5), (60, 60, 16, 5), (100, 60, 40, 20_000)])
def test_equals_brute_force(spark, length, report, k, max_group):
    rows = corpus(length, length)
    want = brute(rows, length, report)
    assert sum(1 for x in want if x[2]) > 20 and sum(1 for x in want if not x[2]) > 10
    assert report == length or any(x[5] > x[2] for x in want)
    assert sorted(map(tuple, suffix_dedup(docs(spark, rows), length, k, max_group, report).collect()), key=str) == want


def test_kept_bytes_and_spans(spark):
    rows = corpus(7, 60)
    raws, seen = {i: (t or "").encode() for i, t in rows}, {x[0]: x for x in brute(rows, 60)}
    got = deduplicated(docs(spark, rows), 60, 16).collect()
    assert len(got) == len(rows)
    for r in got:
        raw, at, kept = raws[r.doc_id], 0, b""
        for a, b in r.spans:
            assert at <= a < b <= len(raw)
            kept, at = kept + raw[at:a], b
        assert bytes(r.kept) == kept + raw[at:]
        assert (len(raw), len(raw) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == seen[r.doc_id][1:]


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward(spark).collect()]
    assert sorted(map(tuple, suffix_dedup(awkward(spark)).collect()), key=str) == brute(rows, 400, 240)
    assert suffix_dedup(docs(spark, [])).count() == 0 and deduplicated(docs(spark, [])).count() == 0


def test_passages_shorter_than_the_length_are_reported(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(55)
    rows = [(i, f"{prose(90)} {passage if i < 4 else prose(55)} {prose(90)}") for i in range(12)]
    assert 240 < len(passage) < 390
    got = {r.doc_id: r for r in suffix_dedup(docs(spark, rows)).collect()}
    assert all(r.n_removed == 0 and r.kept_sha256 == hashlib.sha256(rows[i][1].encode()).hexdigest() for i, r in got.items())
    assert all((r.n_repeated >= len(passage)) == (i < 4) and (r.n_repeated > 0) == (i < 4) for i, r in got.items())


def test_loser_tree_merges_with_common_prefixes():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    for n in (1, 2, 3, 7):
        sources = [decode(front_code(sorted((w, b"", 0, 0, 0) for w in words[i::n]))) for i in range(n)]
        merged = list(LoserTree(sources))
        assert [x[1] for x in merged] == sorted(words)
        assert [x[0] for x in merged][1:] == [shared_prefix(a[1], b[1]) for a, b in zip(merged, merged[1:])]


def test_cover_finds_every_pair():
    rng = random.Random(5)
    for _ in range(300):
        items = sorted(("".join(rng.choice("ab") for _ in range(8)).encode(), "".join(rng.choice("ab") for _ in range(8)).encode()) for _ in range(rng.randint(2, 12)))
        items = sorted(set(items))
        want = [], []
        for i, (f, b) in enumerate(items):
            pairs = [(shared_prefix(b, y), shared_prefix(f, x)) for j, (x, y) in enumerate(items) if j != i]
            for least, out in zip((9, 6), want):
                good = [(a, r) for a, r in pairs if a + r >= least]
                out.append((max(a for a, _ in good), max(r for _, r in good)) if good else (0, 0))
        shares = [0, *(shared_prefix(a[0], b[0]) for a, b in zip(items, items[1:]))]
        assert cover([(s, *x) for s, x in zip(shares, items)], 9, 6) == list(want)


def test_every_long_string_has_an_anchor():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    at, _ = anchors(buf, np.array([0, 50, 1000, 1000, 3000]), 60, 16)
    for a, b in ((50, 1000), (1000, 3000)):
        for i in range(a, b - 60 + 1):
            assert ((at >= i) & (at <= i + 44)).any()
    assert not ((at < 50) | ((at > 984) & (at < 1000))).any()
