import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselens.llm import token_output
from caselens.llm._mph import build, slot
from caselens.llm.token_counts import token_counts
from .common import awkward, docs

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(seed=1, n=120):
    rng = random.Random(seed)
    bits = ["hello", "World's", " ", "  ", "\n", "\r\n", "\t", "12345", "...", "é", "é", "漢字", "ß", " ", " ", "\x85", "\x1c", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "Σ", "ΣΑΣ", "ͅ", "😀", "--", "_", "\x00", "ſ", "K", "ab<|endof", "text|>"]
    return [None, "", " ", "\n\n a"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_counts_equal_the_library(spark, hot):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs(spark, rows), BYTE, 512, hot).collect()}
    assert got == {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}


def test_counts_of_awkward_rows(spark):
    got = sorted(map(tuple, token_counts(awkward(spark), BYTE).collect()), key=str)
    assert len(got) == 12 and got.count((5, 3, 1, False)) == 2 and (None, 0, 0, False) in got
    assert [x for x in got if x[0] in (7, 8)] == [(7, 108000, got[-5][2], True), (8, 108000, got[-5][2], True)] or {x[3] for x in got if x[0] in (7, 8)} == {True}
    assert token_counts(docs(spark, []), BYTE).count() == 0


def expected(rows):
    tokenizer = Tokenizer.from_file(WORD)
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_output_equals_the_library(spark):
    rows = list(enumerate(texts(2)))
    random.Random(5).shuffle(rows)
    assert sorted(map(tuple, token_output.token_output(docs(spark, rows).repartition(3), WORD).collect()), key=str) == expected(rows)


def test_output_of_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r[0], r[1]) for r in df.collect()]
    assert sorted(map(tuple, token_output.token_output(df, WORD).collect()), key=str) == expected(rows)
    assert token_output.token_output(docs(spark, []), WORD).count() == 0


def test_keyed_access(spark):
    tokenizer = Tokenizer.from_file(WORD)
    files = token_output.write_tokens(docs(spark, [(i, f"text number {i}") for i in range(500)]), WORD)
    keys = spark.createDataFrame([(7, 0), (499, 0), (500, 0), (-3, 0), (7, 1)], "doc_id bigint, k int")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_output.read_ids(files, keys).collect()}
    assert got == {i: [*tokenizer.encode(f"text number {i}").ids, 1] for i in (7, 499)}


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 5, 100, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert sorted(slot(keys, build(keys), len(keys)).tolist()) == list(range(len(keys)))


def test_latin_pre_tokens_equal_the_library():
    """Every pair and triple of characters of each kind below U+0180."""
    from caselens.llm import _bpe

    tokenizer = Tokenizer.from_file(BYTE)
    for c in map(chr, range(0x180)):
        for text in (f"a{c}b", f" {c}{c}1", f"{c} {c}", f"'s{c}'ll{c}'", f"  {c}\n {c}"):
            assert _bpe.LATIN.findall(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], repr(text)


def test_latin_words_equal_the_library():
    tokenizer = Tokenizer.from_file(WORD)
    encode = token_output.Encoder(WORD, "<u2")
    cases = [text for c in map(chr, range(0x180)) for text in (f"a{c}b", f" {c}{c}1 ", f"{c} {c}", f"'S{c}'ll{c}'", f"X{c}\n'{c}")]
    for text, raw in zip(cases, encode(cases)):
        assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
