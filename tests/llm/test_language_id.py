import zlib

import numpy as np
import pytest

from caselens.llm.language_id import _cut, _forward, _gradients, _softmax, has_letter, keep_known, language_id, learn, predict, quota, start
from .common import DOCS, awkward, docs


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(labelled):
    truth = {r.doc_id: r.lang for r in labelled.select("doc_id", "lang").collect()}
    rows = language_id(labelled).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.96


def test_gradients_equal_differences():
    net = start(["x", "y", "z"], hidden=4)
    for a in net.arrays():
        a[...] = a * 0.7
    rng = np.random.default_rng(0)
    rows, mask, target = rng.integers(0, 5, (6, 7)), (rng.random((6, 7)) < 0.8).astype(np.float32), rng.integers(0, 3, 7)

    def loss():
        p = _softmax(_forward(net, rows).astype(np.float64))
        return -(np.log(p[:, target, np.arange(7)]) * mask).sum() / mask.sum()

    _, grads = _gradients(net, rows, mask, target)
    for a, g in zip(net.arrays(), grads):
        for _ in range(12):
            at = tuple(rng.integers(0, s) if i != a.ndim - 1 or s != 256 else rng.integers(0, 5) for i, s in enumerate(a.shape))
            was = a[at]
            a[at] = was + 1e-2
            up = loss()
            a[at] = was - 1e-2
            down = loss()
            a[at] = was
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_prediction_equals_a_plain_loop():
    """One byte, one unit and one direction at a time."""
    net = start(["x", "y", "z"], hidden=5)
    texts = ["", "a", "Überall wo man hinsieht, und noch weiter. " * 3, "plain"]
    raws = [t.encode() for t in texts]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(direction, raw):
        h, out = np.zeros(5), []
        for byte in raw:
            new = np.zeros(5)
            for k in range(5):
                gate = lambda g: (float(net.wx[direction, g * 5 + k, byte]), sum(float(net.wh[direction, g * 5 + k, j]) * h[j] for j in range(5)))
                z, r = sigmoid(sum(gate(0))), sigmoid(sum(gate(1)))
                c = np.tanh(gate(2)[0] + r * gate(2)[1])
                new[k] = z * h[k] + (1 - z) * c
            h = new
            out.append(h)
        return out

    buf, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    got = predict(net, buf, offsets, segment=32)
    for raw, p in zip(raws, got):
        total = np.zeros(3)
        for a in range(0, len(raw), 32):
            part = raw[a : a + 32].ljust(32, b"\0")
            for t, (f, b) in enumerate(zip(states(0, part), states(1, part[::-1])[::-1])):
                if a + t < len(raw):
                    scores = net.bias + net.wo[0] @ f + net.wo[1] @ b
                    total += np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
        assert np.allclose(p, total / max(1, len(raw)), atol=1e-4)


def test_segments_hold_every_byte():
    buf = np.arange(1, 200, dtype=np.uint8)
    rows, lengths, owner = _cut(buf, np.array([0, 0, 5, 70, 70, 199]), 16)
    assert np.concatenate([r[:n] for r, n in zip(rows, lengths)]).tolist() == buf.tolist()
    assert np.bincount(owner, weights=lengths, minlength=5).tolist() == [0, 5, 65, 0, 129]


def test_letters():
    texts = ["", "12 .", "1ß", "漢", "٣", "a"]
    raw = [t.encode() for t in texts]
    assert has_letter(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).tolist() == [False, False, True, True, False, True]


def test_awkward_rows(spark):
    rows = language_id(awkward(spark)).collect()
    assert len(rows) == 12 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and {r.lang_pred for r in rows if r.doc_id in (7, 8)} == {"en"}
    unlabelled = spark.createDataFrame([(1, "text", None, None, 4)], DOCS)
    assert [tuple(r)[2:] for r in language_id(unlabelled).collect()] == [("und", 0.0)]
    assert language_id(docs(spark, [])).count() == 0
    assert keep_known(awkward(spark)).columns == awkward(spark).columns
    clash = awkward(spark).selectExpr("*", "1 AS __Lang", "'y' AS __score")
    assert keep_known(clash).columns == clash.columns and keep_known(clash).count() == keep_known(awkward(spark)).count()


def test_every_labelled_language_is_learned(spark):
    """However rare it is, whatever its doc_ids are and wherever its letters begin."""
    rows = [(i, f"plain words {i}", "en", None, 0) for i in range(3000)] + [(9, "ett ord", "sv", None, 0)] * 2500
    rows += [(1, "un mot", "fr", None, 0), (4, "12 " * 400 + "ein Wort", "de", None, 0), (4, "12 34", "no letter", None, 0)]
    assert learn(spark.createDataFrame(rows, DOCS), train_docs=40).languages == ["de", "en", "fr", "sv"]
    assert quota([1, 5000, 30], 100) == 69 and quota([3, 4], 100) == 4 and quota([], 100) == 0
