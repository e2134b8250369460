"""Token counts: pieces are counted once for each distinct pre-token of the corpus.

1. Tasks cut texts into the tokenizer's own pre-tokens and send each distinct
   one with its number of occurrences; the tokenizer then counts the pieces of
   every distinct pre-token, once.
2. Tasks sum the counts of the HOT most frequent pre-tokens, and of the HOT_LONG
   most frequent long ones (named by 128 bits), a broadcast of bounded size, by
   document. The other pre-tokens go, with their frequency in the document, to a
   join with the whole table of counts; so no key of that join is common.
No token ids are made for documents.

This holds for byte-level tokenizers, whose pre-tokens never reach over the
edge of a word and the blank before it. Strings of special tokens inside texts
are one token each, as the library has it by default.

Edge cases: null and empty texts have 0 tokens; rows repeated with doc_id and
text get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._spark import arrow, most_frequent, small_batches, stash
from ._text import slices

#: Pre-tokens whose counts are broadcast: of at most HOT_BYTES bytes each, and longer ones by their digests.
HOT, HOT_LONG = 300_000, 20_000
HOT_BYTES = 48

_PIECES = pa.schema([("piece", pa.string()), ("n", pa.int64())])
_COUNTED = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("tokens", pa.int64())])
_PARTS = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("tokens", pa.int64()), ("piece", pa.string()),
        ("freq", pa.int64()),
    ]
)


def _segments(text: str, special: list[str]) -> tuple[list[str], int]:
    """The parts of a text between special tokens, and the number of these."""
    parts, found = [text], 0
    for s in special:
        if s in text:
            cut = [p.split(s) for p in parts]
            found += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
    return parts, found


class PreTokens:
    """Cuts texts as the tokenizer does. Latin texts take one regular expression, other words the tokenizer itself, once each."""

    def __init__(self, path: str):
        self.tokenizer, self.path = _bpe.load(path), path
        self.special = _bpe.special_texts(self.tokenizer)
        if not _bpe.is_byte_level(self.tokenizer):
            raise ValueError(f"{path}: not a byte-level tokenizer")

    def __call__(self, text: str | None) -> tuple[list[str], int]:
        """The pre-tokens, and the number of special tokens."""
        if not text:
            return [], 0
        parts, found = _segments(text, self.special)
        out: list[str] = []
        for part in parts:
            if not _bpe.WIDE.search(part):
                out += _bpe.LATIN.findall(part)
                continue
            known = _bpe.memo(self.path, "pre-tokens")
            for chunk in _bpe.CHUNK.findall(part):
                pieces = known.get(chunk)
                if pieces is None:
                    pieces = known[chunk] = [chunk[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]
                out += pieces
        return out, found


def _send_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    cut, total = PreTokens(path), Counter()
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            total.update(cut(text)[0])
        if len(total) > _bpe.MEMO // 2:
            yield arrow(None, _PIECES, piece=list(total), n=list(total.values()))
            total.clear()
    yield arrow(None, _PIECES, piece=list(total), n=list(total.values()))


def _count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokenizer = _bpe.load(path)
    for batch in batches:
        yield arrow(
            None, _COUNTED, piece=batch.column("piece"), n=batch.column("n"),
            tokens=[len(x) for x in _bpe.ids_of(tokenizer, batch.column("piece").to_pylist())],
        )


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n, tokens): every distinct pre-token, its occurrences and its number of tokens."""
    sent = docs.select("text").mapInArrow(lambda it: _send_pieces(it, path), "piece string, n bigint")
    distinct = sent.groupBy("piece").agg(F.sum("n").alias("n"))
    return stash(distinct.mapInArrow(lambda it: _count_pieces(it, path), "piece string, n bigint, tokens bigint"))


class _Hot(dict):
    """Counts of hot pre-tokens; the others count 0 and are put down in rest."""

    def __init__(self, counts: dict[str, int], long: dict[str, int]):
        super().__init__(counts)
        self.long, self.rest = long, []

    def __missing__(self, piece: str) -> int:
        if self.long and len(raw := piece.encode()) > HOT_BYTES and (n := self.long.get(hashlib.md5(raw).hexdigest())) is not None:
            return n
        self.rest.append(piece)
        return 0


def _split_counts(batches: Iterator[pa.RecordBatch], path: str, counts: dict[str, int], long: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A row with bytes and the tokens of hot pre-tokens for each document, and rows for its other pre-tokens."""
    cut, hot = PreTokens(path), _Hot(counts, long)
    for batch in slices(batches, "text"):
        ids, keys, sizes, tokens, pieces, freqs = [], [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = (text or "").encode()
            key = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
            hot.rest = []
            own, total = cut(text)
            total += sum(map(hot.__getitem__, own))
            rest = Counter(hot.rest)
            more = len(rest)
            ids += [doc_id] * (1 + more)
            keys += [key] * (1 + more)
            sizes += [len(raw), *[None] * more]
            tokens += [total, *[None] * more]
            pieces += [None, *rest]
            freqs += [None, *rest.values()]
        yield arrow(None, _PARTS, doc_id=ids, text_key=keys, n_bytes=sizes, tokens=tokens, piece=pieces, freq=freqs)


def token_counts(docs: DataFrame, path: str, limit: int = 512, hot_pieces: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    docs = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = piece_counts(docs, path)
    top = most_frequent(counts.filter(F.octet_length("piece") <= HOT_BYTES), "n", hot_pieces)
    long = most_frequent(counts.filter(F.octet_length("piece") > HOT_BYTES), "n", min(hot_pieces, HOT_LONG))
    tables = [dict(map(tuple, t.collect())) for t in (top.select("piece", "tokens"), long.select(F.md5("piece"), "tokens"))]
    hot = docs.sparkSession.sparkContext.broadcast(tables)
    parts = docs.mapInArrow(
        lambda it: _split_counts(it, path, *hot.value),
        "doc_id bigint, text_key bigint, n_bytes bigint, tokens bigint, piece string, freq bigint",
    )
    # Rows of whole documents need no count; a key of their own keeps them from meeting in one task as nulls would.
    apart = F.concat(F.lit("\0"), F.xxhash64("doc_id", "text_key").cast("string"))
    parts = parts.withColumn("base", F.col("piece").isNull()).withColumn("piece", F.coalesce("piece", apart))
    joined = parts.join(counts.select("piece", F.col("tokens").alias("each")), "piece", "left")
    tokens = F.sum(F.when(F.col("base"), F.col("tokens")).otherwise(F.col("freq") * F.col("each")))
    sums = joined.groupBy("doc_id", "text_key").agg(
        F.count_if("base").alias("rows"), F.max("n_bytes").alias("n_bytes"), tokens.alias("tokens"),
    )
    each = sums.select(
        "doc_id", "n_bytes", F.expr("tokens div rows").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"),
    )
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
