import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from caselens.llm.language_id import language_id
from caselens.llm.mixing import mixture
from .common import awkward, docs
from .test_jaccard_join import brute as near_copies

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{place}/{k}")
        tables.append(spark.read.parquet(f"{place}/{k}"))
    return tables


def test_filters_keep_columns_and_take_effect(spark, stages):
    documents = stages[0]
    assert all(t.columns == documents.columns for t in stages[:5])
    unknown = {r.doc_id for r in language_id(documents).collect() if r.lang_pred == "und" or r.score < 1.1 / 4}
    rows = {r.doc_id: r.text for r in documents.collect()}
    one = {r.doc_id: r.text for r in stages[1].collect()}
    assert set(one) == set(rows) - unknown
    groups = near_copies(list(one.items()))
    two = {r.doc_id: r.text for r in stages[2].collect()}
    assert set(two) == {c if n else i for i, (n, c) in groups.items()} and len(two) < len(one)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[k : k + 10]), set()).add(tuple(w[k : k + 10]))
    dirty = {i for i, t in two.items() if any(tuple(cut(t)[k : k + n]) in own for n, own in windows.items() for k in range(len(cut(t)) - n + 1))}
    assert {r.doc_id for r in stages[3].collect()} == set(two) - dirty and dirty


def test_mix_and_output(spark, stages):
    taken = {r.doc_id: r.taken for r in mixture(stages[3]).collect() if r.taken}
    words = Counter()
    mixed = stages[4].collect()
    for r in mixed:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == Counter(taken)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(mixed, key=lambda r: (r.doc_id, r.text.encode())):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == want


def test_run_gives_the_rows_of_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def _through(spark, table, place):
    """The tables of all stages; every stage but the last keeps the columns."""
    tables = [table]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{place}/{k}")
        tables.append(spark.read.parquet(f"{place}/{k}"))
    assert all(t.columns == table.columns for t in tables[:5])
    assert tables[5].columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return tables


def test_awkward_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, repeated ids and texts, long and empty texts, and columns named as the stages name their own."""
    clash = {"__lang": "'a'", "__Score": "1.5", "__n_words": "2", "__hits": "'b'", "__items": "'c'", "__sid": "3", "__set": "4", "__rows": "5", "size": "6", "h": "'d'", "tie": "'e'", "copy": "7"}
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()] + [(20, "other words than any"), (20, "words that share an id only"), (None, "no id and nothing like it"), (None, "no id and other words here")]
    table = docs(spark, rows, extra=True).selectExpr("*", *(f"{v} AS `{k}`" for k, v in clash.items()))
    tables = _through(spark, table, tmp_path)
    lettered = sorted(str(t) for _, t in rows if t and any(c.isalpha() for c in t))
    assert sorted(r.text for r in tables[1].collect()) == lettered  # one language is known: all with a letter stay
    want = Counter(lettered)
    want["one"] = 1
    want[next(t for t in lettered if len(t) > 10_000)] = 1
    assert Counter(r.text for r in tables[2].collect()) == want == Counter(r.text for r in tables[3].collect())
    assert {tuple(map(str, r)) for r in tables[4].select(*clash).distinct().collect()} == {tuple(map(str, table.select(*clash).first()))}
    assert tables[5].count() == tables[4].count() and tables[5].agg({"n_tokens": "min"}).first()[0] >= 1


def test_empty_table(spark, tmp_path):
    assert [t.count() for t in _through(spark, docs(spark, []), tmp_path)] == [0] * 6
