import hashlib
import random
import re

import numpy as np

from caselens.llm.secret_scan import base_spans, calibrate, encode, secret_scan, train
from .common import awkward, docs

PATTERNS = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def texts(seed=0, n=200):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    keys = lambda k: "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(k))
    bits = [lambda: "plain words here", lambda: f"token = \"{hexes(40)}\"", lambda: f"SECRET: token: {hexes(8)}", lambda: "password=abc12", lambda: "pässword='häh'", lambda: f"AKIA{keys(rng.choice([10, 16, 20]))}", lambda: f"AKIAAKIA{keys(14)}", lambda: hexes(rng.randint(20, 30)), lambda: "ſecret=kelvinK123", lambda: f"api_key:{keys(12)}", lambda: "漢字 😀", lambda: f"id {keys(6)}-{hexes(12)}", lambda: "passwd\"  :  'x.y-z=/+_'"]
    return [None, ""] + ["".join(rng.choice([" ", "\n", ""]) + rng.choice(bits)() for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_base_equals_brute_force_and_stays(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in secret_scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if not s.startswith("model")] == want
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        assert sum(s.startswith("model") for s in spans) == got[i].n_model


def test_network_tells_keys_from_words():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("etaoinshr"), 20))
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 20))
    windows = [f"{'x' * 24}{word() if k % 2 else key()} and more" for k in range(400)]
    labels = np.array([1 - k % 2 for k in range(400)])
    chars, mask = encode(windows, [20] * 400)
    net = train(chars[:300], mask[:300], labels[:300], rounds=120)
    from caselens.llm.secret_scan import probability

    p = probability(net, chars[300:], mask[300:])
    assert ((p >= net.threshold) == labels[300:]).mean() > 0.97 and 0.5 <= net.threshold <= 1


def test_awkward_rows(spark):
    rows = secret_scan(awkward(spark)).collect()
    assert len(rows) == 12 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert secret_scan(docs(spark, [])).count() == 0
    assert base_spans("token=token=abcdefgh") == [(0, 20, "assign")]


def test_long_runs_are_read_to_their_end(spark):
    rng = random.Random(1)
    slug = lambda n: "-".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(n))
    key = lambda n: "".join(rng.choice("ABCDEFGHJKLMNP23456789") for _ in range(n))
    pad = "\0" * 24
    findings = spark.createDataFrame([(pad + (key(30) if k % 2 else slug(5) + "7") + " and", 30, k % 2) for k in range(600)], "window string, size int, label int")
    rows = [(0, slug(30) + "-" + key(40)), (1, key(40) + "-" + slug(30)), (2, slug(20) + "-" + key(40) + "-" + slug(20)), (3, slug(30) + "-7")]
    got = {r.doc_id: r.n_model for r in secret_scan(docs(spark, rows), findings).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0}


def test_negatives_have_the_shape_of_candidates():
    from caselens.llm.secret_scan import CANDIDATE, RUN, compound, is_candidate, lookalike

    runs = [compound("some plain words of a longer text here", 0, k * 7919) for k in range(200)]
    made = [r for r in runs if r]
    assert all(lookalike("some plain words of a longer text here", 5, k * 7919)[1] for k in range(200))
    assert len(made) > 150 and all(len(r) >= CANDIDATE and RUN.fullmatch(r) and is_candidate(r) and any(c.isdigit() for c in r) and any(c.isalpha() for c in r) for r in made)


def test_threshold_keeps_the_recall_even_if_it_is_low():
    from caselens.llm.secret_scan import RECALL, probability

    rng = np.random.default_rng(2)
    windows = [" " * 24 + "".join(rng.choice(list("abc123"), 20)) for _ in range(600)]
    labels = (rng.random(600) < 0.2).astype(int)  # nothing tells them apart
    chars, mask = encode(windows, [20] * 600)
    net = calibrate(train(chars, mask, labels, rounds=5), chars, mask, labels)
    assert (probability(net, chars, mask)[labels == 1] >= net.threshold).mean() >= RECALL


def test_network_finds_keys_that_no_pattern_finds(spark):
    """Labelled candidates outside the patterns: recall and precision over whole documents, learned from the patterns' findings."""
    rng = random.Random(9)
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    word = lambda: draw("etaoinshrdlu", rng.randint(2, 9))
    prose = lambda n: " ".join(word() for _ in range(n))
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    secrets = [lambda: draw(mixed, 32), lambda: draw("ABCDEFGHJKLMNPQRSTUVWXYZ234567", 26), lambda: draw(mixed + "+/", 40)]
    others = [lambda: f"{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}", lambda: draw("0123456789", 16), lambda: "/".join(word() for _ in range(4)) + "7", lambda: word() + word().capitalize() + "Handler", lambda: "2024-" + draw("012", 2) + "-11", lambda: f"uuid {draw('0123456789abcdef', 8)}-{draw('0123456789abcdef', 4)}-{draw('0123456789abcdef', 4)}"]
    rows, truth, plain = [], {}, set()
    for i in range(700):
        kind = i % 7
        if kind < 3:
            mid = f'token = "{draw("0123456789abcdef", 40)}"'
        elif kind == 3:
            key = rng.choice(secrets)()
            mid, truth[i] = f"with {key} in it", key
        else:
            mid = rng.choice(others)()
            plain.add(i)
        rows.append((i, f"{prose(rng.randint(8, 30))} {mid} {prose(20)}"))
    got = {r.doc_id: r for r in secret_scan(docs(spark, rows)).collect()}
    texts_of = dict(rows)
    added = {i: [texts_of[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "model"] for i, r in got.items()}
    caught = sum(added[i] == [key] for i, key in truth.items())
    wrong = sum(len(added[i]) for i in plain)
    assert caught >= 0.9 * len(truth), (caught, len(truth))
    assert wrong <= 0.1 * caught, [x for i in plain for x in added[i]][:20]
    assert all(got[i].top_probability is not None for i in range(700) if i % 7 < 4)
    assert all(got[i].n_assign == 1 and got[i].n_hex == 1 for i in range(700) if i % 7 < 3)


def test_every_finding_is_learned_from_or_held_out(spark, monkeypatch):
    """More findings than any sample held: all come, in several slices and tasks, and the threshold keeps the recall of all that were held out."""
    from caselens.llm import secret_scan as S

    rng = random.Random(3)
    draw = lambda letters: "".join(rng.choice(letters) for _ in range(20))
    rows = [(" " * 24 + (draw("0123456789abcdef") if k % 3 == 0 else draw("etaoinshr")) + " and", 20, int(k % 3 == 0)) for k in range(20_000)]
    df = spark.createDataFrame(rows * 2, "window string, size int, label int")
    seen, held = [], []
    learn, finish = type(df).mapInArrow, S._calibrated

    def watched(self, f, schema, *more):
        if "state" in str(schema):
            seen.append(self.count())
        return learn(self, f, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    monkeypatch.setattr(S, "_calibrated", lambda net, part: held.extend(part.collect()) or finish(net, part))
    net = S.train_on(df)
    assert sum(seen) + len(held) == len(set(rows)) and len(seen) > 1
    p = S.probability(net, *S.encode([r.window for r in held], [20] * len(held)))
    label = np.array([r.label for r in held])
    assert (p[label == 1] >= net.threshold - 1e-6).mean() >= S.RECALL and (p[label == 0] >= net.threshold).mean() < 0.02
