"""Product codes of vectors: each part of a vector is named by the nearest entry of its position's codebook.

Components become integers, so all distances, sums and ties are exact. The
nearest entry is found with a vector-approximation file: the entries'
coordinates are quantised to a few bits, that is to cells of their range; for
each part looked up, a table per coordinate gives the least and the greatest
squared distance to each cell. Sums of these bound the distance to each entry
from both sides, and only entries whose lower bound is no more than the least
upper bound get their integer distance.

A round is one pass over a stashed table; tasks send counts and sums of each
entry, the codebooks alone come back to the driver (8 x 16 entries, whatever
the number of rows).

Edge cases: rows whose vector is null or empty, or holds null or non-finite
components, are left out, as are vectors of another length than the first kept
one's; a length that 8 does not divide is filled up with zeros. A null vec_id
comes after all others, equal vec_ids are ordered by their components, and rows
repeated with vec_id are rows like others. With fewer than 16 rows there are as
many entries. A component of 65,536 or more in size is an error, since errors
would not fit 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import look_up, stash

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a coordinate in the approximation.
BITS = 3
#: Components from here on are refused.
TOO_LARGE = 1 << 16
#: Vectors looked up at a time; the tables of bounds take some 10 MB for 128 components.
CHUNK = 1024


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _integer(x: Column) -> Column:
    fits = F.abs(x) < TOO_LARGE
    return F.when(fits, F.floor(x.cast("double") * SCALE).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("vector_codes: a component is too large: "), x.cast("string"))).cast("int")
    )


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that are kept, v as whole numbers and of a length that PARTS divides."""
    rows = vectors.filter(finite(F.col("embedding"))).select("vec_id", "label", F.transform("embedding", _integer).alias("v"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    length = first[0] if first else 0
    fill = F.array_repeat(F.lit(0), -length % PARTS)
    return stash(rows.filter(F.size("v") == length).withColumn("v", F.concat("v", fill)))


def first_codebooks(rows: DataFrame) -> np.ndarray:
    """The parts of the first vectors, (PARTS, entries, length of a part)."""
    first = [r[0] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    return np.array(first, np.int64).reshape(len(first), PARTS, len(first[0]) // PARTS if first else 0).transpose(1, 0, 2)


# --- the approximation ------------------------------------------------------------------------


def approximate(entries: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each entry and coordinate; the least and the greatest whole number of each coordinate's cells)."""
    low, high = entries.min(axis=0), entries.max(axis=0)
    width = (high - low) // (1 << bits) + 1
    begin = low[:, None] + np.arange(1 << bits) * width[:, None]
    return (entries - low) // width, begin, begin + width[:, None] - 1


def nearest(points: np.ndarray, entries: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry of each point, ties to the lower one; its squared distance; how many distances were computed)."""
    cells, begin, end = approximate(entries, bits)
    below, above = begin[None] - points[:, :, None], points[:, :, None] - end[None]
    least = np.maximum(np.maximum(below, above), 0) ** 2
    most = np.maximum(-below, -above) ** 2
    at = np.arange(points.shape[1])
    lower, upper = least[:, at, cells].sum(axis=2), most[:, at, cells].sum(axis=2)
    row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    exact[row, entry] = ((points[row] - entries[entry]) ** 2).sum(axis=1)
    best = exact.argmin(axis=1)
    return best, exact[np.arange(len(points)), best], len(row)


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, one column a part; squared distances summed over parts) of whole-number vectors."""
    parts = vectors.reshape(len(vectors), PARTS, -1)
    codes, errors = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
    for a in range(0, len(vectors), CHUNK):
        own = slice(a, a + CHUNK)
        for p in range(PARTS):
            codes[own, p], distance, _ = nearest(parts[own, p], books[p])
            errors[own] += distance
    return codes, errors


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


# --- rounds -----------------------------------------------------------------------------------


def _sums(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, sums of components) of the parts that are nearest to it."""
    size, length = books.shape[1:]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, size), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0))
                codes, _ = assign(vectors, books)
                for p in range(PARTS):
                    own = vectors[:, p * length : (p + 1) * length]
                    for e in range(size):
                        member = codes[:, p] == e
                        counts[p, e] += member.sum()
                        sums[p, e] += own[member].sum(axis=0)
        used = [(p, e) for p in range(PARTS) for e in range(size) if counts[p, e]]
        yield pa.RecordBatch.from_pydict(
            {"part": [p for p, _ in used], "entry": [e for _, e in used], "n": [counts[x] for x in used], "sums": [sums[x].tolist() for x in used]},
            schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]),
        )

    found = rows.select("v").mapInArrow(partial, "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry").agg(
        F.sum("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(length))),
    )
    return {(p, e): (n, sums) for p, e, n, sums in found.collect()}


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after some rounds over all rows of integers(); unused entries stay."""
    books = first_codebooks(rows)
    for _ in range(rounds if books.size else 0):
        new = books.copy()
        for at, (n, sums) in _sums(rows, books).items():
            new[at] = [s // n for s in sums]
        books = new
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the squared distance to what the code stands for."""
    kind = dict(rows.dtypes)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, errors = assign(_matrix(batch.column("v")), books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes().hex() for x in found]), pa.array(errors)],
                    names=["vec_id", "label", "code", "error"],
                )

    return rows.mapInArrow(codes, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row that is kept."""
    rows = integers(vectors)
    books = train(rows)
    label = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = stash(encode(rows, books).withColumn("key", label))
    by_label = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    found = look_up(coded, by_label, "key", "n", coded.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
