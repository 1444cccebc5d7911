"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band. A document is
reduced to its distinct lexicon terms, sorted; every randomised subset of the lexicon hashes
those of them that it holds. Two documents agree in a subset unless a term that only one of
them has fell into it, so the share of subsets that agree follows their likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.common import LONG_MIN, boundaries, slice_of
from tracewarden.llm.decontaminate import words_of

#: A term belongs to the lexicon if this share of all documents has it, ends included. The lower
#: end bounds the lexicon: mean distinct terms of a document / LOW, whatever the table's size.
LOW, HIGH = 1 / 1000, 1 / 10
SUBSETS = 32
#: Terms that a task keeps with their hashes before it starts anew.
CACHE = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, summed over the task's rows before they are shuffled."""
    hashes: dict[bytes, int] = {}
    terms, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def listed():
        return pa.RecordBatch.from_arrays(
            [pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "n"]
        )

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            seen: list[int] = []
            for text in batch.column(0).slice(at, 1000).cast(pa.binary()).to_pylist():
                for word in set(words_of(text)):
                    known = hashes.get(word)
                    if known is None:
                        known = hashes[word] = xxhash.xxh3_64_intdigest(word)
                    seen.append(known)
            if len(hashes) > CACHE:
                hashes.clear()
            all_terms = np.concatenate([terms, np.array(seen, dtype=np.uint64)])
            weights = np.concatenate([counts, np.ones(len(seen), np.int64)])
            terms, inverse = np.unique(all_terms, return_inverse=True)
            counts = np.bincount(inverse, weights, len(terms)).astype(np.int64)
            if len(terms) > 2 * CACHE:
                yield listed()
                terms, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    yield listed()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms within the band, counted over all documents."""
    total = docs.count()
    counts = docs.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term")
    band = F.col("n").between(low * total, high * total)
    rows = counts.agg(F.sum("n").alias("n")).filter(band).select("term").toArrow()
    return rows["term"].to_numpy().view(np.uint64).tolist()


class Printer:
    """Fingerprints of texts under one lexicon."""

    def __init__(self, terms: list[int], subsets: int):
        self.lexicon = frozenset(terms)
        self.seeds = _mix(np.arange(1, subsets + 1, dtype=np.uint64) << np.uint64(32))
        self.known: dict[bytes, int] = {}

    def terms(self, text: str) -> np.ndarray:
        """The distinct lexicon terms of a text, sorted."""
        found = []
        for word in set(words_of(text.encode())):
            known = self.known.get(word)
            if known is None:
                known = xxhash.xxh3_64_intdigest(word)
                known = self.known[word] = known if known in self.lexicon else -1
            if known >= 0:
                found.append(known)
        if len(self.known) > CACHE:
            self.known.clear()
        return np.sort(np.array(found, dtype=np.uint64))

    def print_of(self, text: str) -> str:
        """Two levels of subset hashes, as text.

        At level n a subset keeps a term with probability 2**-n; the level is chosen so that
        about one of the document's terms falls into each. A level has four hex digits per
        subset, zeros for an empty one. A text without lexicon terms is hashed as a whole.
        """
        terms = self.terms(text)
        if not len(terms):
            return "text:" + hashlib.sha256(text.encode()).hexdigest()[:32]
        level = int(len(terms) - 1).bit_length()
        drawn = _mix(terms[:, None] ^ self.seeds[None, :])
        parts = []
        for n in (level, level + 1):
            kept = drawn >> np.uint64(64 - n) == 0 if n else np.ones(drawn.shape, bool)
            place = np.cumsum(kept, axis=0).astype(np.uint64)
            with np.errstate(over="ignore"):
                spread = _mix(drawn + place * np.uint64(0x9E3779B97F4A7C15))
                total = np.where(kept, spread, np.uint64(0)).sum(axis=0)
            codes = total % np.uint64(65535) + np.uint64(1)
            codes[~kept.any(axis=0)] = 0
            parts.append(f"{n}:" + "".join(f"{c:04x}" for c in codes.tolist()))
        return ";".join(parts)


def likeness(one: str, other: str) -> float:
    """The share of subsets, not empty in both, that agree, over the levels both prints have."""
    if one == other:
        return 1.0
    left, right = (dict(p.split(":") for p in x.split(";")) for x in (one, other))
    if "text" in left or "text" in right:
        return 0.0
    same = filled = 0
    for level in left.keys() & right.keys():
        a, b = left[level], right[level]
        for i in range(0, len(a), 4):
            x, y = a[i : i + 4], b[i : i + 4]
            if x != "0000" or y != "0000":
                filled += 1
                same += x == y
    return same / filled if filled else 0.0


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) sliced by descending doc_id, each slice with its follower.

    Columns _slice, _last, _key, doc_id, text, _ghost. Within a slice, sorted by _last and
    descending _key, every row that is no ghost is followed by the next document; the last
    document of all is followed by the first. Only ids are read to cut the slices.
    """
    spark: SparkSession = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(LONG_MIN))
    ids = docs.select(key.alias("_key"))
    cuts = boundaries(ids, "_key", parts)
    tops = ids.groupBy(slice_of(F.col("_key"), cuts).alias("s")).agg(F.max("_key").alias("top")).collect()
    tops = sorted((r["s"], r["top"]) for r in tops)
    following = [tops[(i + 1) % len(tops)][0] for i in range(len(tops))]
    ghosts = spark.createDataFrame(
        [(top, to, i + 1 == len(tops)) for i, ((_, top), to) in enumerate(zip(tops, following, strict=True))],
        "_top long, _to int, _wrap boolean",
    )
    own = F.struct(F.col("_slice"), F.lit(False).alias("_last"), F.lit(False).alias("_ghost"))
    copy = F.struct(F.col("_to").alias("_slice"), F.col("_wrap").alias("_last"), F.lit(True).alias("_ghost"))
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"))
        .withColumn("_slice", slice_of(F.col("_key"), cuts))
        .join(F.broadcast(ghosts), F.col("_key") == F.col("_top"), "left")
        .withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .select("_at.*", "_key", "doc_id", "text")
        .repartition(max(1, len(cuts) + 1), "_slice")
        .sortWithinPartitions("_slice", "_last", F.col("_key").desc(), F.col("_ghost"), F.xxhash64("text"))
    )


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprints(
    docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS, parts: int | None = None
) -> DataFrame:
    """One row per document: its print, that of an edited text, and two likenesses.

    The edited text has its last third replaced by the start of the next document, in descending
    doc_id. Equal texts have equal prints. Null texts count as empty; a null doc_id comes last;
    rows with one doc_id follow each other in the order of a hash of their texts; a single
    document is its own successor; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", "text")
    if plain.isEmpty():
        return spark.createDataFrame([], OUT)
    table = spark.sparkContext.broadcast(lexicon(plain, low, high))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(table.value, subsets)
        held = None
        out: list[tuple] = []

        def row(one, text, fingerprint, after):
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[0][:cut]
            changed = printer.print_of(edited)
            digest = hashlib.sha256(edited.encode()).hexdigest()
            return (
                one, len(text), digest, fingerprint, changed,
                likeness(fingerprint, changed), likeness(fingerprint, after[1]),
            )

        names = [x.split()[0] for x in OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def listed():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

        for batch in batches:
            for part, ghost, doc_id, text in zip(
                *(batch[c].to_pylist() for c in ("_slice", "_ghost", "doc_id", "text")), strict=True
            ):
                mark = printer.print_of(text)
                if held is not None and held[0] == part:
                    out.append(row(*held[1:], (text, mark)))
                held = None if ghost else (part, doc_id, text, mark)
                if len(out) >= 1000:
                    yield listed()
                    out = []
        if out:
            yield listed()

    return neighbours(plain, parts).mapInArrow(run, OUT)
