"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewarden.llm.common import lean

WINDOW = 10
#: Bytes that hold a word together once A-Z are lower-cased: digits, a-z, everything beyond ASCII.
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
#: Benchmark text, in bytes, of one broadcast, which holds nothing else; a larger benchmark is scanned for
#: in several passes. A task's index of it takes some thirty times as much if no word occurs twice.
BROADCAST_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Ngrams:
    """The windows of some benchmark items: per length their hashes, and where their words stand."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        number: dict[str, int] = {}
        who = np.array([number.setdefault(name, len(number)) for name in self.names], dtype=np.int64)
        ids: list[int] = []
        places: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, (_, text) in enumerate(items):
            words = words_of(text)
            n = min(window, len(words))
            if n:
                count = len(words) - n + 1
                places.setdefault(n, []).append(len(ids) + np.arange(count))
                owners.setdefault(n, []).append(np.full(count, item))
                ids.extend([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.ids = np.array(ids, dtype=np.int64)
        self.tables = []
        for n in sorted(places):
            place, owner = np.concatenate(places[n]), np.concatenate(owners[n])
            hashes = self.hashed([self.ids[place + i] for i in range(n)])
            order = np.lexsort((place, who[owner], hashes))
            hashes, place, owner = hashes[order], place[order], owner[order]
            # An item that says a window more than once counts once.
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (who[owner[1:]] == who[owner[:-1]])) + 1
            same = np.ones(len(again), dtype=bool)
            for i in range(n):
                same &= self.ids[place[again] + i] == self.ids[place[again - 1] + i]
            keep = np.ones(len(hashes), dtype=bool)
            keep[again[same]] = False
            self.tables.append((n, hashes[keep], place[keep], owner[keep]))

    @staticmethod
    def hashed(columns) -> np.ndarray:
        """A polynomial of the word numbers, one column per place in the window."""
        with np.errstate(over="ignore"):
            total = np.zeros(len(columns[0]), dtype=np.uint64)
            for c in columns:
                total = (total + c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
            return total

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per window length: starts of verified hits and the items that hold them.

        ``ids`` are word numbers of texts one after another, 0 for foreign words and between texts.
        """
        broken = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, hashes, places, owners in self.tables:
            if len(ids) < n:
                continue
            starts = np.flatnonzero(broken[n:] == broken[: len(broken) - n])
            if not len(starts):
                continue
            wanted = self.hashed([ids[starts + i] for i in range(n)])
            # Windows that share a hash stand side by side; each is compared word by word.
            low = np.searchsorted(hashes, wanted, "left")
            high = np.searchsorted(hashes, wanted, "right")
            while (alive := low < high).any():
                starts, low, high = starts[alive], low[alive], high[alive]
                span = np.arange(n)
                same = (ids[starts[:, None] + span] == self.ids[places[low][:, None] + span]).all(axis=1)
                if same.any():
                    yield n, starts[same], owners[low[same]]
                low = low + 1


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan(items, window: int, place: int, schema: pa.Schema):
    """The pass over the texts for one broadcast part; adds to what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Ngrams(items.value, window)
        number = grams.vocabulary.get
        for batch in batches:
            texts = batch["_d"].flatten()[place].cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, sizes = [], []
                for text in texts.slice(at, 512).to_pylist():
                    words = words_of(text)
                    sizes.append(len(words))
                    ids.extend([number(w, 0) for w in words])
                    ids.append(0)
                flat = np.array(ids, dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)])
                spans: list[list[tuple[int, int]]] = [[tuple(s.values()) for s in x] for x in part["_spans"].to_pylist()]
                names: list[set[str]] = [set(x) for x in part["_items"].to_pylist()]
                for n, starts, owners in grams.hits(flat):
                    doc = np.searchsorted(first, starts, "right") - 1
                    for d in np.unique(doc):
                        mine = doc == d
                        spans[d] += [(a, a + n) for a in (starts[mine] - first[d]).tolist()]
                        names[d].update(grams.names[i] for i in np.unique(owners[mine]).tolist())
                spans = [
                    [{"word_from": a, "word_to": b} for a, b in _merged(*np.array(x).T)] if x else []
                    for x in spans
                ]
                out = [
                    part["_d"],
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, schema.field("_spans").type),
                    pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def benchmark_parts(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in parts of about ``limit`` bytes of text, brought to the driver one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").filter(
        F.col("name").isNotNull() & F.col("text").isNotNull()
    )
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // limit))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(parts))
    for i in range(parts):
        yield sorted((r["name"], r["text"].encode()) for r in items.filter(part == i).collect())


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """_d (a struct of all columns of ``docs``), _n_words, _spans and _items.

    ``_spans`` are the hit words, merged, from and to; ``_items`` the ids of the items. A document
    word is hit if it lies in any occurrence of ``window`` consecutive words of an item; an item
    of fewer words counts as a whole. Null and empty texts have no words. Items without words,
    text or id are skipped; rows with the same item_id are one item. Repeated rows are scanned
    each. No shuffle: each part of the benchmark is one pass over the scan.
    """
    spark: SparkSession = docs.sparkSession
    spans = "array<struct<word_from:long,word_to:long>>"
    out = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_d"),
        F.lit(0).cast("long").alias("_n_words"),
        F.array().cast(spans).alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    arrow = to_arrow_schema(schema)
    for part in benchmark_parts(benchmark, limit):
        items = spark.sparkContext.broadcast(part)
        out = out.mapInArrow(lean(_scan(items, window, docs.columns.index("text"), arrow)), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: words, hit words, items with a window in it, and their digest."""
    found = scan_documents(docs.select("doc_id", "text"), benchmark, **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["word_to"] - s["word_from"])
    return found.select(
        "_d.doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, as they are."""
    return (
        scan_documents(docs, benchmark, **options)
        .filter(F.size("_spans") == 0)
        .select("_d.*")
    )
