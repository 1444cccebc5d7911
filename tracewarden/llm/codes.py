"""Vector code compression: product codebooks over integers, by exact matrix products.

Components become integers and vectors are cut into equal parts, each with a codebook of its own.
Distances need dot products of integers. They are taken from float64 products of limbs, so small
that no sum reaches 2^53, and put together in int64: every bit is right whatever the order in
which a library adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are held against the codebooks in one go.
STEP = 4096


@dataclass(frozen=True)
class Codebooks:
    """Entries (part, entry, place) as int64; as large as so many vectors."""

    entries: np.ndarray

    def digest(self) -> str:
        """Lower-case hex sha256 of all components, decimal, comma-joined, by part, entry, place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def exact_product(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``one @ other`` of two int64 matrices, modulo 2^64: exact if the result fits int64.

    Both are cut into limbs of b bits, the highest one signed, such that a sum over the inner
    dimension stays below 2^53 in float64.
    """
    inner = max(one.shape[1], 1)
    bits = (53 - int(inner).bit_length()) // 2

    def limbs(x: np.ndarray) -> list[np.ndarray]:
        largest = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
        count = max(1, -(-largest.bit_length() // bits))
        low = [((x >> (bits * i)) & ((1 << bits) - 1)).astype(np.float64) for i in range(count - 1)]
        return [*low, (x >> (bits * (count - 1))).astype(np.float64)]

    total = np.zeros((one.shape[0], other.shape[1]), dtype=np.int64)
    right = limbs(other)
    with np.errstate(over="ignore"):
        for i, x in enumerate(limbs(one)):
            for j, y in enumerate(right):
                if bits * (i + j) < 64:
                    total += (x @ y).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors (n, dims): index of each part's nearest entry, ties to the lower one, and the
    squared distances, both (n, parts)."""
    parts, _, width = books.shape
    n = len(vectors)
    largest = 0
    for x in (vectors, books):
        largest += max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if width * parts * largest * largest >= 1 << 63:
        raise ValueError("components are too large: a squared distance would not fit 64 bits")
    code = np.zeros((n, parts), dtype=np.int64)
    error = np.zeros((n, parts), dtype=np.int64)
    for p in range(parts):
        mine, book = vectors[:, p * width : (p + 1) * width], books[p]
        squares = (mine * mine).sum(axis=1)[:, None] + (book * book).sum(axis=1)
        distance = squares - 2 * exact_product(mine, np.ascontiguousarray(book.T))
        code[:, p] = distance.argmin(axis=1)
        error[:, p] = distance[np.arange(n), code[:, p]]
    return code, error


def integer_vectors(table: DataFrame, vector: Column, scale: int = SCALE) -> DataFrame:
    """``table`` with a column ``v`` of integers floor(scale * x), without rows whose vector is
    null or holds null, infinite or undefined components."""
    wide = vector.cast("array<double>")
    sound = F.forall(
        wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    return table.filter(wide.isNotNull() & sound).withColumn(
        "v", F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))))
    )


def _matrices(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, STEP):
        part = batch.slice(at, STEP)
        flat = part[column].flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(part[column].offsets.to_numpy())
        if (sizes != width).any():
            raise ValueError(f"all vectors must have {width} components, as the first ones have")
        yield part, flat.reshape(len(part), width)


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. What reaches the driver is as large as the codebooks."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for _, x in _matrices(batch, "v", parts * width):
                code, _ = nearest(x, books)
                for p in range(parts):
                    chosen = (code[:, p] == np.arange(entries)[:, None]).astype(np.int64)
                    sums[p] += exact_product(chosen, x[:, p * width : (p + 1) * width])
                    counts[p] += chosen.sum(axis=1)
        p, e = (x.ravel() for x in np.indices((parts, entries)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(counts.ravel()), pa.array(list(sums.reshape(-1, width)), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    local = vectors.select("v").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    rows = (
        local.filter("n > 0")
        .select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        .collect()
    )
    moved = books.copy()
    for r in rows:
        moved[r["part"], r["entry"], r["place"]] = int(r["s"]) // r["n"]
    return moved


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the integer vectors ``v`` (stored; read once a round).

    Each starts as the parts of the vectors with the smallest vec_ids, as many as there are
    ``entries`` (all, if there are fewer; ties by the vectors, null ids last). A round assigns
    every part and moves each entry to the floor of the mean of its parts; unused ones stay.
    """
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    rows = [r["v"] for r in first]
    width = len(rows[0]) if rows else 0
    if width % parts or any(len(r) != width for r in rows):
        raise ValueError(f"all vectors must have the same number of components, a multiple of {parts}")
    start = np.array(rows, dtype=np.int64).reshape(len(rows), parts, width // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds if rows and width else 0):
        books = _moved(vectors, books)
    return Codebooks(books)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (an entry per part), error (squared distances, summed); one row a vector."""
    entries = books.entries
    parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch, "v", parts * width):
                code, error = nearest(x, entries)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["label"], pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), pa.array(error.sum(axis=1))],
                    names=["vec_id", "label", "codes", "error"],
                )

    plain = vectors.select("vec_id", "label", "v")
    label = plain.schema["label"].dataType.simpleString()
    return plain.mapInArrow(run, f"vec_id long, label {label}, codes array<int>, error long")


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with a column ``vector``: what the entries stand for, as doubles."""
    table = [[[x / scale for x in entry] for entry in part] for part in books.entries.tolist()]
    parts = [F.lit(part)[F.col("codes")[i]] for i, part in enumerate(table)]
    return codes.withColumn("vector", F.concat(*parts))


def vector_codes(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """One row per sound vector: vec_id, code, error, label_error, codebooks_sha256.

    ``table`` has vec_id, embedding and label; other columns are not read. Rows whose vector is
    null or holds null or non-finite components are dropped; null ids and labels stay, null
    labels together; repeated rows count each; an empty table, or one without sound vectors, gives
    an empty one. Vectors of different lengths, of a length that is no multiple of ``parts``, or
    with components so large that a distance would not fit 64 bits raise ValueError.

    The integers are written once and read by every round. Sums are combined in the tasks: a
    label that holds a third of all rows is a row per task.
    """
    plain = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    vectors = stored(integer_vectors(plain, F.col("embedding"), scale).select("vec_id", "label", "v"), "vectors")
    books = train(vectors, parts, entries, rounds)
    if not books.entries.size:
        codes = vectors.select(
            "vec_id", "label", F.array_repeat(F.lit(0), parts).alias("codes"), F.lit(0).cast("long").alias("error")
        )
    else:
        codes = encode(vectors, books)
    coded = stored(codes, "codes")
    sums = stored(
        coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "sums"
    )
    digits = F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )
