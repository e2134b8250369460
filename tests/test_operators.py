"""Closed-form cases of functions and operators that the registered queries do not reach."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from caselens.functions import scalars as S
from caselens.operators import ensemble, graph, metrics, ranking, relational, reports, selection, splits


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.ratio(lit(1), lit(0))) is None and one(spark, S.harmonic(lit(0.0), lit(0.0))) == 0.0
    assert [one(spark, S.parse_float(lit(x))) for x in (" 1.5 ", "N/A", "NaN", "inf", "x", "")] == [1.5, None, None, None, None, None]
    assert [one(spark, S.parse_bool(lit(x))) for x in ("Yes", "1.0", "f", "?")] == [True, True, False, None]
    assert [one(spark, S.range_bin(lit(x))) for x in (0, 9, 10, 9999, 10000, -1)] == [
        "tiny_<10", "tiny_<10", "small_10-100", "large_1k-10k", "huge_>=10k", "unknown",
    ]
    assert [
        tuple(one(spark, S.chronicity(lit(d).cast("double"), lit(f).cast("double")))) for d,
        f in ((5, None), (180, 0), (0, 1), (None, None))
    ] == [("lt180d", "days_post_stroke"), ("ge180d", "days_post_stroke"), ("ge180d", "chronicity_flag"), ("unknown", "")]
    assert one(spark, S.chronicity(lit(-4.0), lit(1.0), legacy=True)["bin"]) == "unknown"
    name = S.config_name(lit(0.35), lit(20))
    assert (one(spark, name), one(spark, S.config_threshold(name)), one(spark, S.config_least(name))) == ("thr0.35_k20", 0.35, 20)
    assert [one(spark, S.short_threshold(lit(x))) for x in (0.35, 1.0, 0.125)] == ["0.35", "1", "0.125"]
    assert one(spark, S.case_id(lit("/a/CASE_0007_x.nii.gz"))) == "CASE_0007" and one(spark, S.case_id(lit("/a/b.nii.gz"))) == "b"
    axes = F.array(F.array(lit(-1.0), lit(0.0), lit(0.0)), F.array(lit(0.0), lit(0.0), lit(2.0)), F.array(lit(0.0), lit(1.0), lit(0.1)))
    assert one(spark, S.orientation(axes)) == "LSA" and one(spark, S.determinant_sign(axes)) == 1
    assert one(spark, S.same_grid(F.array(lit(1)), F.array(lit(1)), F.array(lit(1.0)), F.array(lit(1.0005)))) is True
    assert one(spark, S.markdown(lit("a|b\nc"))) == "a\\|b c" and one(spark, S.number_text(lit(None).cast("double"))) == "—"
    for bad in (S.require_amount(lit("-1"), lit("c7")), S.require_amount(lit("x"), lit("c7")), S.binarise(lit(float("nan")))):
        with pytest.raises(Exception, match="c7|not finite"):
            one(spark, bad)


def test_overlap_of_empty_masks(spark):
    counts = spark.createDataFrame([(0, 0, 0, 8), (0, 3, 0, 5), (64, 32, 32, 0)], "tp long, fp long, fn long, tn long")
    rows = counts.select(*metrics.overlap()).collect()
    assert [(r.dice, r.iou) for r in rows] == [(1.0, 1.0), (0.0, 0.0), (128 / 192, 0.5)]
    assert rows[0].sensitivity is None and rows[1].precision == 0.0


def test_detection_with_nothing_to_find(spark):
    counts = spark.createDataFrame(
        [(0, 0, 0, 0), (0, 2, 0, 0), (2, 0, 0, 0)], "gt_count long, pred_count long, detected_gt long, tp_pred long",
    )
    assert [(r.lesion_precision, r.lesion_recall, r.lesion_f1) for r in metrics.detection(counts).collect()] == [(None, None, 1.0), (0.0, None, 0.0), (None, 0.0, 0.0)]
    assert [(r.lesion_precision, r.lesion_recall) for r in metrics.detection(counts, vacuous=True).collect()] == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]


def test_pr_auc_does_not_change_under_monotone_maps(spark):
    rows = spark.range(500).select(
        F.lit("a").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 97.0).alias("s"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0).alias("t"),
    )
    value = lambda df: metrics.pr_auc(df, ["k"], "s", F.col("t")).first().pr_auc
    assert math.isclose(value(rows), value(rows.withColumn("s", F.exp("s") * 3)))
    assert value(rows.withColumn("t", F.lit(False))) == 0.0 and value(rows.withColumn("t", F.lit(False)).withColumn("s", F.lit(0.5))) == 1.0
    assert math.isclose(value(rows.withColumn("s", F.lit(1.0))), (1 + rows.filter("t").count() / 500) / 2)


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert {tuple(r) for r in relational.reconcile(a, b, ["id"]).collect()} == {(1, "missing"), (3, "unexpected")}
    with pytest.raises(ValueError, match="rows left"):
        relational.require_empty(a, "rows left")
    relational.require_empty(a.limit(0), "rows left")
    keys = spark.createDataFrame([("p", "x", None), ("q", None, "h")], "id string, path string, sha string")
    other = spark.createDataFrame([("r", "x", "h")], "id string, path string, sha string")
    assert {tuple(r) for r in relational.any_key_matches(keys, other, ["path", "sha"], "id", "id").collect()} == {("p", "r", "path"), ("q", "r", "sha")}
    now = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert {r.id: r.action for r in relational.reuse(now, now.withColumn("v", F.lit(1)), "id", ["v"]).collect()} == {"a": "reuse", "b": "convert"}
    first, second = (relational.certificate(t, [], ["id", "v"], "v").first().content_sha256 for t in (now, now.orderBy(F.col("id").desc()).repartition(3)))
    assert first == second != relational.certificate(now.withColumn("v", F.col("v") + 1), [], ["id", "v"], "v").first().content_sha256
    cases = spark.createDataFrame([("c1", "A"), ("c1", "A"), (None, "A"), ("c2", " ")], "id string, center string")
    assert {tuple(r) for r in relational.record_violations(cases, "id", "center").collect()} == {("duplicate id", "c1"), ("missing id", ""), ("blank center", "c2")}


def test_folds_are_even_whole_and_stable(spark):
    sizes = [31, 3, 9, 14, 2, 7, 5, 11, 1, 8, 4, 4]
    cases = spark.createDataFrame(
        [(f"{g}-{k}", f"g{g:02d}", "ab"[k % 2]) for g, n in enumerate(sizes) for k in range(n)], "case string, center string, bin string",
    )
    profiles = splits.group_profiles(cases, "center", {"bin": ["a", "b"]})
    found = splits.assign_folds(profiles, "center", 5, restarts=6)
    again = splits.assign_folds(profiles.repartition(3), "center", 5, restarts=6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    placed = splits.splits(cases, found, "case", "center")
    assert relational.split_violations(placed, cases, "case", "center").count() == 0
    loads = [r["count"] for r in placed.filter("subset = 'val'").groupBy("fold").count().collect()]
    assert len(loads) == 5 and max(loads) == 31 and max(sorted(loads)[:4]) - min(loads) <= 2
    assert splits.leave_group_out(cases, "case", "center", 10).select("held").distinct().count() == 3


def test_gates_and_decisions(spark):
    pairs = spark.range(200).select("id", F.lit(0.0).alias("a"), (F.lit(0.5) + F.pmod(F.xxhash64("id"), F.lit(100)) / 1000.0).alias("b"))
    row = selection.gate(selection.bootstrap(pairs, "id", 200, 3)).first()
    assert row.deviates and 0 < row.se < 0.01 and row.ci_lo < row.effect < row.ci_hi
    same = selection.gate(selection.bootstrap(pairs.withColumn("b", F.col("a")), "id", 50, 3)).first()
    assert not same.deviates and same.effect == 0
    draws = selection.poisson_draws(pairs, "id", 50, 1).agg(F.sum("weight")).first()[0]
    assert abs(draws / (200 * 50) - 1) < 0.05
    arms = spark.createDataFrame([("x", 0.1, 3.0), ("y", 0.2, 2.0), ("z", -0.1, 1.0)], "arm string, gain double, cost double")
    rows = {r.arm: r for r in selection.decide(arms, "arm", [("no gain", F.col("gain") > 0)], "cost").collect()}
    assert rows["y"].chosen and not rows["x"].chosen and rows["z"].decision == "REJECT" and rows["z"].reasons == "no gain"
    assert one(
        spark, selection.promotion(F.lit(0.02), F.lit(0.0), F.lit(-0.005)),
    ) and not one(spark, selection.promotion(F.lit(0.5), F.lit(0.0), F.lit(-0.006)))


def test_ensembles(spark):
    with pytest.raises(ValueError):
        ensemble.check_weights({"a": 0.0})
    with pytest.raises(ValueError):
        ensemble.parse_weights(["a=1", "a=2"])
    rows = spark.createDataFrame([(1, "a", 0.0), (1, "b", 1.0), (2, "a", 0.5)], "v int, m string, p double")
    got = {r.v: (r.p, r.n_members) for r in ensemble.weighted_average(rows, ["v"], "m", "p", {"a": 1, "b": 3, "c": 0}).collect()}
    assert got == {1: (0.75, 2), 2: (0.5, 1)}
    candidates = spark.createDataFrame([("both", "a"), ("both", "b"), ("one", "a")], "candidate string, m string")
    assert {(r.candidate, r.v, r.p) for r in ensemble.candidate_scores(rows, candidates, "v", "m", "p").collect()} == {("both", 1, 0.5), ("one", 1, 0.0), ("one", 2, 0.5)}
    assert ensemble.decide_class(rows, ["v"], "m", "p").filter("v = 1").first().m == "b"


def test_ranks_and_picks(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 1, 7, 9])], "id int, v double")
    assert {r.id: r["rank"] for r in rows.withColumn("rank", ranking.average_rank([], F.col("v"))).collect()} == {0: 3.0, 1: 1.5, 2: 1.5, 3: 4.0, 4: 5.0}
    roles = ranking.representative(spark.range(10).select("id", F.col("id").cast("double").alias("v")), "v", "id").collect()
    assert sorted((r.id, r.role) for r in roles) == [
        (0, "worst"), (1, "worst"), (2, "worst"), (4, "middle"), (5, "middle"), (8, "best"), (9, "best"),
    ]
    assert {r["quantile"]: r.id for r in ranking.quantile_nearest(rows, "v", "id", (0.6, 1.0)).collect()} == {0.6: 0, 1.0: 4}
    near = ranking.nearest(spark.createDataFrame([(1, 0.4), (1, 0.6)], "k int, t double"), ["k"], "t", F.lit(0.5), "t")
    assert near.first().t == 0.4
    assert reports.markdown_table(rows.limit(1), ["id", "v"])[0] == "| id | v |"


def test_graphs(spark):
    nodes = spark.createDataFrame(
        [("a", None, ["x"], "ok"), ("b", "a", ["x", "y"], "ok"), ("c", "d", ["y"], "old"), ("d", "c", [], "ok"), ("e", "zz", ["y"], "ok")],
        "id string, parent string, lenses array<string>, status string",
    )
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "nope")], "id string, source string, target string")
    assert {tuple(r) for r in graph.dangling(nodes, edges).collect()} == {("no target", "e2"), ("no parent", "e")}
    assert {r.id for r in graph.cyclic(nodes).collect()} == {"c", "d"}
    seen, inner = graph.scope(nodes, edges, None)
    assert {r.id for r in seen.collect()} == {"a"} and inner.count() == 0
    seen_edges = spark.createDataFrame([("a", "b", ["x"]), ("a", "c", ["x", "z"])], "source string, target string, lenses array<string>")
    best = lambda e, given: tuple(graph.best_lens(nodes, e, ("y", "x", "z"), given).first())
    assert best(seen_edges, "y") == ("x", 2002) and best(seen_edges.limit(0), "z") == ("y", 3)
    assert best(seen_edges.filter("target = 'c'").withColumn("lenses", F.array(F.lit("q"))), "w") == ("y", 3)
    assert tuple(graph.best_lens(nodes.limit(0), seen_edges.limit(0), ("y", "x"), "w").first()) == ("w", 0)  # a tie leaves the given lens
    assert graph.induced(nodes, edges).count() == 1
    assert graph.bad_values(nodes, "status", ("ok",)).first().id == "c"


def test_bootstrap_of_scores_that_are_no_means(spark):
    """Against a loop over the same hashed weights."""
    import hashlib

    rng = random.Random(4)
    cases = []
    for k in range(30):
        one = {}
        for side in "ab":
            gt, pred = rng.randrange(4), rng.randrange(5)
            one |= {f"{side}_gt": gt, f"{side}_pred": pred, f"{side}_detected": rng.randint(0, gt), f"{side}_tp_pred": rng.randint(0, pred)}
            one |= {f"{side}_dice": rng.choice([None, rng.random()]), f"{side}_f1": rng.random()}
        cases.append({"id": k, **one})

    def weight(k, boot):
        u = int(hashlib.md5(f"{k}:{boot}:9".encode()).hexdigest()[:10], 16) / 2**40
        return sum(u >= c for c in selection.POISSON)

    def score(kind, side, weights):
        total = lambda c: sum(w * r[f"{side}_{c}"] for r, w in zip(cases, weights))
        mean = lambda c: sum(w * r[f"{side}_{c}"] for r, w in zip(cases, weights) if r[f"{side}_{c}"] is not None) / sum(w for r, w in zip(cases, weights) if r[f"{side}_{c}"] is not None)
        p, r = (total("tp_pred") / total("pred"), total("detected") / total("gt")) if kind == "pooled" else (mean("dice"), mean("f1"))
        return 2 * p * r / (p + r)

    df = spark.createDataFrame(cases)
    for kind, how in (("pooled", selection.pooled_f1("tp_pred", "pred", "detected", "gt")), ("hmean", selection.harmonic_mean("dice", "f1"))):
        got = selection.bootstrap_scores(df, "id", how, 60, 9).first()
        diffs = [score(kind, "b", w) - score(kind, "a", w) for w in ([weight(r["id"], boot) for r in cases] for boot in range(60))]
        assert math.isclose(got.effect, score(kind, "b", [1] * 30) - score(kind, "a", [1] * 30)) and got.n_boot == 60 and got.n_cases == 30
        assert math.isclose(got.se, statistics.stdev(diffs)) and min(diffs) <= got.ci_lo <= got.ci_hi <= max(diffs)


def test_boosted_volume(spark):
    rows = spark.range(300).select((F.col("id") % 20).cast("double").alias("x"), F.exp((F.col("id") % 20) / 5.0).alias("ml"))
    model = selection.fit_log_volume(rows, ["x"], "ml")
    worst = model.transform(rows).select(F.max(F.abs(F.log1p("predicted_volume") - F.log1p("ml")))).first()[0]
    assert worst < 0.5


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(1)
    for n, m in ((2, 1), (40, 25), (60, 200), (50, 49)):
        edges = [(k, k + 1) for k in range(n - 1)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = list(range(n))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in edges:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        ends = {x for e in edges if e[0] != e[1] for x in e}
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in ends}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("v")).repartition(5)
    got = sorted((r["__i"], r.v, r.id) for r in ranking.numbered(rows, [F.col("v").desc(), F.col("id")]).collect())
    assert [(v, i) for _, v, i in got] == sorted(
        ((v, i) for _, v, i in got), key=lambda x: (-x[0], x[1]),
    ) and [k for k, _, _ in got] == list(range(1000))
    steps = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("a", 4, float("nan")), ("b", 1, None)], "k string, step int, v double",
    )
    assert [(r.k, r.step) for r in ranking.best_so_far(steps, ["k"], "step", "v").collect()] == [("a", 2)]


def test_policies_and_guards(spark):
    cases, found = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", 3)], "id string, n int")
    with_n = lambda how: {r.id: r.n for r in relational.with_predictions(cases, found, ["id"], ["n"], how).collect()}
    assert with_n("skip") == {"a": 3} and with_n("empty") == {"a": 3, "b": 0}
    with pytest.raises(ValueError, match="without a prediction"):
        with_n("error")
    with pytest.raises(ValueError, match="unknown policy"):
        with_n("guess")
    manifest = relational.manifest_status(cases, {"pred": found, "truth": cases}, ["id"])
    assert {r.id: r.lacks for r in manifest.collect()} == {"a": "", "b": "pred"}


def test_contained_texts_equal_a_plain_search(spark):
    import random

    from caselens.operators.leakage import contained

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    texts = [rng.choice(["", " "]) + rng.choice([" ", "  "]).join(word() for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None]
    cut = lambda t: t[(a := rng.randrange(len(t))) : a + rng.randint(1, 40)]
    items = [cut(t) for t in texts if t] + ["one two three four five", "zz", " ", None]
    docs = [*enumerate(texts), (100, "one two three four five"), (101, "x one two three four fives")]
    want = {(d, i) for d, t in docs for i, x in enumerate(items) if t is not None and x is not None and x in t}
    got = contained(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string"),
        "doc_id", "item_id",
    )
    assert {tuple(r) for r in got.collect()} == want and {d for d, _ in want} >= {100, 101}


def test_models_over_folds(spark):
    rows = spark.range(240).select(
        (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 4).cast("int").alias("fold"),
        F.when(F.col("id") % 20 < 7, "low").when(F.col("id") % 20 < 14, "mid").otherwise("high").alias("config"),
    )
    found = selection.nested_predictions(
        rows, "fold", lambda train: selection.fit_configuration(train, ["x"], "config"), ["predicted_config"],
    )
    assert found.count() == 240 and found.filter("config = predicted_config").count() > 200
    cells = spark.createDataFrame(
        [(f, s, c, float(v)) for f in (0, 1) for s, c, v in ((1, "a", 3), (1, "b", 1), (9, "a", 1), (9, "b", 2))],
        "fold int, size int, config string, v double",
    )
    assert {tuple(r) for r in selection.best_below_and_above(cells, "fold", "size", 5, "config", "v").collect()} == {(0, "a", "b"), (1, "a", "b")}


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from caselens import storage

    bare = lambda master: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master, applicationId="x"),
    )
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(bare(master))
    assert storage.shared_dir(bare("local[4]")).startswith("file:///")


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(k, None if rng.random() < 0.1 else float(np.round(rng.normal(), 1))) for k in ("a", "b", None) for _ in range(int(rng.integers(1, 400)))] + [("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    at = (0.0, 0.01, 0.5, 0.95, 1.0)
    got = {r.k: tuple(r)[1:] for r in reports.quantiles(df, ["k"], "v", at, [f"q{i}" for i in range(5)]).collect()}
    want = {k: np.quantile([v for x, v in rows if x == k and v is not None], at) for k in ("a", "b", None, "one")}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert np.allclose(
        tuple(reports.quantiles(df, [], "v", at, [f"q{i}" for i in range(5)]).first()),
        np.quantile([v for _, v in rows if v is not None], at),
    )
    assert {r.k: r.n for r in reports.profile(df, ["k"], "v").collect()}["none"] == 0
