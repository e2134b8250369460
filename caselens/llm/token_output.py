"""Token ids in binary shards, with a minimal perfect hash index over the document keys.

Format. A shard is a file of raw little-endian ids, 2 bytes each where the
vocabulary allows it and 4 otherwise; documents follow each other in ascending
doc_id (null first), each closed by the end id, without headers. Shards ascend as well. A
document's key is (doc_id, k), k counting rows that repeat a doc_id. The index
is a table with one row a bucket of keys: displacements, and in the slot of
each key a 32-bit fingerprint, the shard, the position of the first id and the
number of ids. A lookup computes one slot, compares the fingerprint, and reads
one range of one file.

Tasks write their shards themselves under names of their own attempt, so a
retried or duplicated task never touches a file that another one wrote; only
files named in the committed table of entries count.

Edge cases: null and empty texts hold the end id alone; rows repeated with a
doc_id are told apart by k, in the order of their texts; an empty table has an
empty index and no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bpe
from ._mph import build, slot
from ._spark import arrow, by_key, partitions, runs, shared_dir, small_batches, stash
from ._text import mix, slices

END = 1
BUCKET_KEYS = 2048
#: A task starts another shard beyond this size.
SHARD_BYTES = 256 << 20
_NO_ID = -(1 << 63)

_ENTRY = pa.schema(
    [
        ("doc_id", pa.int64()), ("k", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("at", pa.int64()),
        ("n", pa.int64()),
    ]
)
_ENTRY_DDL = "doc_id bigint, k int, part int, seq int, file string, at bigint, n bigint"
_INDEX = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("seeds", "prints", "shards", "at", "n"))])
_INDEX_DDL = "bucket int, seeds binary, prints binary, shards binary, at binary, n binary"


@dataclass
class TokenFiles:
    """Shards with their index. shards: shard, file, start (ids before it), n; index: a row a bucket."""

    shards: DataFrame
    index: DataFrame
    buckets: int
    width: int
    entries: DataFrame


class Encoder:
    """Raw ids of whole texts; every distinct word is encoded once for a memo.

    Texts in Latin letters are cut into the tokenizer's own pre-tokens, and new
    ones are encoded many at a time, blank between them: the piece that ends
    each word tells them apart. Other texts are cut at ASCII white space, over
    which no token reaches, and each new word is encoded by itself.
    """

    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.tokenizer = path, kind, _bpe.load(path)
        self.special = _bpe.special_texts(self.tokenizer)
        self.ends = _bpe.closing_ids(self.tokenizer) if _bpe.is_lower_word_level(self.tokenizer) else None

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        plain, other = _bpe.memo(self.path, f"{self.kind} words"), _bpe.memo(self.path, f"{self.kind} chunks")
        latin = [bool(t) and self.ends is not None and not _bpe.WIDE_OR_DOTTED.search(t) and not any(x in t for x in self.special) for t in texts]
        words = [_bpe.LATIN_WORD.findall(t.lower()) if x else _bpe.WORD.findall(t or "") for t, x in zip(texts, latin)]
        self._add(plain, list(set().union(*(w for w, x in zip(words, latin) if x)) - plain.keys()), 500)
        self._add(other, list(set().union(*(w for w, x in zip(words, latin) if not x)) - other.keys()), 1)
        return [b"".join(map((plain if x else other).__getitem__, own)) for own, x in zip(words, latin)]

    def _add(self, known: dict[str, bytes], new: list[str], at_once: int) -> None:
        blocks = [new[i : i + at_once] for i in range(0, len(new), at_once)]
        for i in range(0, len(blocks), 1000):
            part = blocks[i : i + 1000]
            for block, ids in zip(part, _bpe.ids_of(self.tokenizer, [" ".join(b) for b in part])):
                ids = np.array(ids, self.kind)
                if len(block) == 1:
                    known[block[0]] = ids.tobytes()
                    continue
                cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()]
                if len(cuts) != len(block) + 1:
                    self._add(known, block, 1)
                    continue
                raw = ids.tobytes()
                known.update(zip(block, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))


def _write_shards(batches: Iterator[pa.RecordBatch], path: str, folder: str, width: int) -> Iterator[pa.RecordBatch]:
    kind = f"<u{width}"
    encode = Encoder(path, kind)
    end = np.array([END], kind).tobytes()
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    part, seq, out, at, file = TaskContext.get().partitionId(), -1, None, 0, ""
    last, k = (None, None), 0
    try:
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            columns = {f.name: [] for f in _ENTRY}
            for doc_id, raw in zip(ids, encode(batch.column("text").to_pylist())):
                if out is None or at * width > SHARD_BYTES:
                    if out is not None:
                        out.close()
                    seq, at = seq + 1, 0
                    file = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                    out = store.open_output_stream(f"{base}/{file}")
                k = k + 1 if last == (True, doc_id) else 0
                last = (True, doc_id)
                out.write(raw + end)
                n = len(raw) // width + 1
                for name, value in zip(columns, (doc_id, k, part, seq, file, at, n)):
                    columns[name].append(value)
                at += n
            yield arrow(batch, _ENTRY, **columns)
    finally:
        if out is not None:
            out.close()


def _key(doc_id: np.ndarray, k: np.ndarray) -> np.ndarray:
    return mix(doc_id.astype(np.int64).view(np.uint64) + mix(k.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


def _keys(table: pa.Table) -> np.ndarray:
    return _key(table.column("doc_id").fill_null(_NO_ID).to_numpy(), table.column("k").to_numpy())


def _index_bucket(table: pa.Table) -> pa.Table:
    keys = _keys(table)
    seeds = build(keys)
    order = np.argsort(slot(keys, seeds, len(keys)))
    stored = {"seeds": seeds, "prints": _print(keys)[order]} | {
        c: table.column(s).to_numpy()[order].astype(np.int64) for c, s in (("shards", "shard"), ("at", "at"), ("n", "n"))
    }
    return pa.table({"bucket": table.column("bucket")[:1].combine_chunks()} | {c: [x.tobytes()] for c, x in stored.items()}, schema=_INDEX)


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k"), F.lit(buckets)).cast("int"))


def write_tokens(docs: DataFrame, path: str, folder: str | None = None) -> TokenFiles:
    """Encode every text with the tokenizer file and write shards and index to a folder that all executors share."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    width = 2 if _bpe.load(path).get_vocab_size() <= 1 << 16 else 4
    ordered = small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text",
    ).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    entries = stash(ordered.mapInArrow(lambda it: _write_shards(it, path, folder, width), _ENTRY_DDL))
    shards = entries.groupBy("part", "seq", "file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part", "seq")  # over shards, not documents
    shards = stash(
        shards.select(
            (F.row_number().over(before) - 1).cast("bigint").alias("shard"), F.concat(F.lit(f"{folder}/"), "file").alias("file"),
            (F.sum("n").over(before) - F.col("n")).alias("start"), "n",
        )
    )
    located = entries.withColumn("file", F.concat(F.lit(f"{folder}/"), "file")).join(shards.select("shard", "file"), "file")
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))
    index = stash(
        _bucketed(located.select("doc_id", "k", "shard", "at", "n"), buckets).groupBy("bucket").applyInArrow(_index_bucket, _INDEX_DDL)
    )
    return TokenFiles(shards, index, buckets, width, entries)


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    empty = not (keys.num_rows and index.num_rows)
    wanted = np.zeros(0, np.uint64) if empty else _keys(keys)
    stored = {
        c: np.zeros(0, t) if empty else np.frombuffer(index.column(c)[0].as_py(), t)
        for c, t in (("seeds", np.int64), ("prints", np.uint32), ("shards", np.int64), ("at", np.int64), ("n", np.int64))
    }
    where = slot(wanted, stored["seeds"], len(stored["n"]))
    hit = stored["prints"][where] == _print(wanted)
    at = where[hit]
    own = keys.slice(0, len(wanted)).filter(pa.array(hit))
    return pa.table(
        {"doc_id": own.column("doc_id"), "k": own.column("k"), "shard": stored["shards"][at], "at": stored["at"][at], "n": stored["n"][at]}
    )


def locate(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """(doc_id, k, shard, at, n) of the keys (doc_id, k) that the index has; one slot is read for each."""
    wanted = _bucketed(keys.select("doc_id", F.col("k").cast("int").alias("k")), files.buckets)
    return wanted.groupBy("bucket").cogroup(files.index.groupBy("bucket")).applyInArrow(
        _look_up, "doc_id bigint, k int, shard bigint, at bigint, n bigint",
    )




def _ranges(batches: Iterator[pa.RecordBatch], width: int, hold: int = 1 << 22) -> Iterator[tuple[dict, bytes]]:
    """Rows with the raw ids of their document, shard by shard in the order of the file."""
    for rows in (
        list(own) for table in runs(batches, "file", 1)
        for _, own in groupby(table.sort_by([("file", "ascending"), ("at", "ascending")]).to_pylist(), itemgetter("file"))
    ):
        store, name = fs.FileSystem.from_uri(rows[0]["file"])
        with store.open_input_file(name) as source:
            first = 0
            while first < len(rows):  # documents that lie close are read at once
                last = first
                begin = rows[first]["at"] * width
                while last + 1 < len(rows) and (rows[last + 1]["at"] + rows[last + 1]["n"]) * width - begin <= hold:
                    last += 1
                raw = source.read_at((rows[last]["at"] + rows[last]["n"]) * width - begin, begin)
                for row in rows[first : last + 1]:
                    a = row["at"] * width - begin
                    yield row, raw[a : a + row["n"] * width]
                first = last + 1


def read_tokens(files: TokenFiles, keys: DataFrame, kernel, schema: str) -> DataFrame:
    """Read the keys' documents from the shards; kernel turns (row, raw ids, width) into a row of the schema."""
    width = files.width
    placed = locate(files, keys).join(files.shards.select("shard", "file", F.col("start").alias("base")), "shard").select(
        "doc_id", "k", "file", "at", "n", (F.col("base") + F.col("at")).alias("start"),
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        rows = []
        for row, raw in _ranges(batches, width):
            rows.append(kernel(row, raw, width))
            if len(rows) == 5000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=target)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=target)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return by_key(placed, "file").mapInArrow(read, schema)


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, k) of all rows."""
    counts = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").cast("int").alias("rows"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("k"))


def _checksum(row: dict, raw: bytes, width: int) -> tuple:
    ids = np.frombuffer(raw, f"<u{width}")
    return row["doc_id"], row["start"], row["n"], zlib.crc32(ids.astype("<u4").tobytes())


def _ids(row: dict, raw: bytes, width: int) -> tuple:
    return row["doc_id"], row["k"], np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()


def read_ids(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """(doc_id, k, ids): the ids as little-endian unsigned 32-bit integers."""
    return read_tokens(files, keys, _ids, "doc_id bigint, k int, ids binary")


def token_output(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back by key: doc_id, start, n_tokens, ids_crc32."""
    files = write_tokens(docs, path, folder)
    return read_tokens(files, document_keys(docs), _checksum, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


