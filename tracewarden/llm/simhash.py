"""Near duplicates by SimHash: fingerprints, and all pairs within a radius by tiles.

Different fingerprints are compared exactly, tile against tile, by exclusive or and bit counts.
Bit counts of two fingerprints differ by no more than their distance, so tiles are sorted by bit
count and a pair of tiles is skipped if its counts are further apart than the radius.

So that the work stays far from the square of the table, tiles are cut inside of buckets: a
fingerprint is cut into radius + a blocks, and two within the radius agree in a blocks at least;
there is a bucket for each choice of a blocks and their bits. That loses no pair. ``a`` grows with
the number of fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import stored
from tracewarden.llm.components import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile, and of the strips in which a tile is held against another.
TILE, STRIP = 8192, 128
#: Small buckets are compared together until they have so many rows.
TOGETHER = 512
#: Shingles whose bits are counted in one go.
STEP = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """A bit is set if it is set in over half of the hashes of all shingles, repeats included.

    A-Z are lower-cased; words lie between ASCII white space; a shorter text is one shingle, and
    one without words has the fingerprint zero.
    """
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * counts > n, bitorder="little")
    return int(set_.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, print (64 bits, as a long); one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                prints = [fingerprint(t, words) for t in part["text"].cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "print"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, print long"
    )


def masks(radius: int, agree: int) -> list[int]:
    """Masks of all choices of ``agree`` of radius + agree blocks of the 64 bits, as signed longs."""
    blocks = radius + agree
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    out = [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def agreeing(count: int, radius: int, tile: int) -> int:
    """The least number of blocks whose buckets hold a tile on average; 4 at most."""
    return next((a for a in (1, 2, 3) if count >> (64 * a // (radius + a)) <= tile), 4)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hooks the trees of the pairs (a, b) together; every root points at a smaller one or itself."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def tile_links(prints: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is within ``radius``: a tile against itself or against ``right``.

    A spanning forest of all links between the tiles, so never more edges than fingerprints.
    """
    with_self = right is None
    one = prints[np.argsort(np.bitwise_count(prints), kind="stable")]
    other = one if with_self else right[np.argsort(np.bitwise_count(right), kind="stable")]
    ones, others = (np.bitwise_count(x).astype(np.int64) for x in (one, other))
    first = 0 if with_self else len(one)
    root = np.arange(first + len(other))
    for low in range(0, len(one), STRIP):
        high = min(low + STRIP, len(one))
        # Strips whose bit counts are further apart than the radius are never compared.
        start = low if with_self else int(np.searchsorted(others, ones[low] - radius))
        end = int(np.searchsorted(others, ones[high - 1] + radius, "right"))
        for at in range(start, end, 4096):
            stop = min(at + 4096, end)
            near = np.bitwise_count(one[low:high, None] ^ other[None, at:stop]) <= radius
            a, b = np.nonzero(near)
            _joined(root, a + low, b + (first + at))
    every = one if with_self else np.concatenate([one, other])
    tied = np.flatnonzero(root != np.arange(len(root)))
    return every[tied], every[root[tied]]


def _compared(members: DataFrame, radius: int, parts: int) -> DataFrame:
    """Links (a, b) within the groups (which, part, i, j) of ``members``; ``side`` 1 is held against 0."""

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        other = a != b
        pairs = [pa.array(x[other].view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(pairs, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One group after another; small ones of one tile are compared together, which finds no
        # less, and whatever it finds is a link.
        held: list[np.ndarray] = []
        sides: list[np.ndarray] = []
        small: list[np.ndarray] = []
        mark, waiting = None, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if not held:
                return
            prints, side = np.concatenate(held), np.concatenate(sides)
            held.clear()
            sides.clear()
            if side.any():
                yield batch_of(*tile_links(prints[side == 0], prints[side == 1], radius))
            elif len(prints) >= TOGETHER:
                yield batch_of(*tile_links(prints, None, radius))
            elif len(prints) > 1:
                small.append(prints)
                waiting += len(prints)
                if waiting >= TOGETHER:
                    yield from flush()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if small:
                yield batch_of(*tile_links(np.unique(np.concatenate(small)), None, radius))
            small.clear()
            waiting = 0

        for batch in batches:
            marks = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("which", "part", "i", "j")])
            prints, side = batch["print"].to_numpy().view(np.uint64), batch["side"].to_numpy()
            inner = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            cuts = [0, *inner.tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high == low:
                    continue
                this = tuple(marks[:, low].tolist())
                if this != mark:
                    yield from close()
                mark = this
                held.append(prints[low:high].copy())
                sides.append(side[low:high].copy())
        yield from close()
        yield from flush()

    keys = ("which", "part", "i", "j")
    return (
        members.select(*keys, "side", "print")
        .repartition(parts, *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(run, "a long, b long")
    )


def print_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect all that are within ``radius``.

    ``prints`` has each fingerprint once, in ``print``, and is read several times: pass a stored
    table. Buckets of more than ``tile`` fingerprints are cut into tiles along their bit counts;
    pairs of tiles whose counts lie within the radius meet, each in a group of its own.
    """
    spark = prints.sparkSession
    agree = agreeing(prints.count(), radius, tile)
    choices = [F.struct(F.lit(i).alias("which"), F.col("print").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks(radius, agree))]
    rows = prints.select("print", F.bit_count("print").alias("ones"), F.explode(F.array(*choices)).alias("k")).select(
        "k.which", "k.part", "print", "ones"
    )
    key = ["which", "part"]
    large = stored(rows.groupBy(*key).agg(F.count("*").alias("total")).filter(F.col("total") > tile), "large")
    cells = rows.join(large, key, "left_semi").groupBy(*key, "ones").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("ones").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    reach = F.sequence(F.floor(F.col("before") / tile), F.floor((F.col("before") + F.col("n") - 1) / tile))
    tiles = (
        cells.select(*key, "ones", F.explode(reach).alias("tile"))
        .groupBy(*key, "tile")
        .agg(F.min("ones").alias("low"), F.max("ones").alias("high"))
    )
    later = tiles.select(*key, F.col("tile").alias("j"), F.col("low").alias("next"))
    pairs = stored(
        tiles.withColumnRenamed("tile", "i")
        .join(later, key)
        .filter((F.col("j") >= F.col("i")) & (F.col("next") - F.col("high") <= radius))
        .select(*key, "i", "j"),
        "tiles",
    )
    spot = F.col("before") + F.pmod(F.xxhash64("print"), F.col("n"))
    placed = rows.join(cells, [*key, "ones"]).select(*key, "print", F.floor(spot / tile).alias("tile"))
    whole = rows.join(large, key, "left_anti").select(
        *key, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "print"
    )
    lefts = placed.withColumnRenamed("tile", "i").join(pairs, [*key, "i"]).select(
        *key, "i", "j", F.lit(0).alias("side"), "print"
    )
    rights = placed.withColumnRenamed("tile", "j").join(pairs.filter("i <> j"), [*key, "j"]).select(
        *key, "i", "j", F.lit(1).alias("side"), "print"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _compared(whole.union(lefts).union(rights), radius, parts).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in ``radius`` bits or fewer are linked; ``component_id`` is the
    smallest doc_id that is reached over links, itself included. Copies share one fingerprint,
    which is compared once.

    Null and empty texts and texts without words have the fingerprint zero and are linked like
    any other. Repeated rows give a row each; rows with one doc_id and different texts are rows
    of their own, each under its fingerprint. A null doc_id is never the smallest; a group of
    null ids alone has a null component_id. Other columns are not read; an empty table gives an
    empty one.
    """
    signed = stored(fingerprints(docs, words), "fingerprints")
    prints = stored(signed.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    links = stored(print_links(prints, radius, tile), "links")
    found = components(links).withColumnRenamed("node", "print")
    placed = stored(
        prints.join(found, "print", "left").select("print", "least", F.coalesce("component", "print").alias("component")),
        "placed",
    )
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = stored(placed.join(smallest, "component").select("print", "component_id"), "labels")
    return signed.join(labels, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
