"""Near duplicates by MinHash: banded candidates, odd sketches, confirmation on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import lean, stored
from tracewarden.llm.components import components

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A pair at the threshold shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS = 5e-8.
ROWS, BANDS = 4, 32
#: MinHash samples of one permutation, one for each of so many bins, and the bits they fold into.
BINS, SKETCH_LONGS = 1024, 32
#: A pair is dropped if its sketches differ by so many standard deviations more than expected.
SIGMAS = 4
#: Members of a bucket that meet in one go.
BLOCK = 1024
#: Bits of a filter per node that it lets through; it lets one in so many others through as well.
SPARE = 16
#: Words that a task keeps with their hashes before it starts anew: some 30 MB.
CACHE = 200_000


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def set_of(self, text: bytes | None) -> np.ndarray:
        """A-Z lower-cased, words between ASCII white space; a shorter text is one shingle."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known, hashes = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        n = min(self.words, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                total = (total ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(32)
        return np.unique(total)


class Signer:
    """Band keys of a set, from MinHash values, and its odd sketch."""

    def __init__(self, rows: int, bands: int):
        rng = np.random.Generator(np.random.PCG64(4))
        k = rows * bands
        self.rows, self.bands = rows, bands
        self.flip = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.factor = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
        self.powers = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        small = (shingles >> np.uint64(16)).astype(np.uint32)[:, None]
        least = np.full(len(self.flip), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(small), 512):
            seen = small[at : at + 512] ^ self.flip
            seen *= self.factor
            np.minimum(least, seen.min(axis=0), out=least)
        total = self.powers.copy()
        for row in least.astype(np.uint64).reshape(self.bands, self.rows).T:
            total = self._mix(total ^ row) + row
        return total.view(np.int64)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of each bin of the hash range flips one bit, chosen by its value."""
        bins = shingles // np.uint64((1 << 64) // BINS)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        bit = self._mix(shingles[first]) % np.uint64(64 * SKETCH_LONGS)
        odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def signatures(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, whole (digest of the set), bands, s (the sketch); one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(rows, bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, digests, keys, sketches = [], [], [], []
                for text in part["text"].cast(pa.binary()).to_pylist():
                    found = shingler.set_of(text)
                    sizes.append(len(found))
                    if not len(found):
                        digests.append(None)
                        keys.append(None)
                        sketches.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(signer.keys(found))
                    sketches.append(signer.sketch(found).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "whole", "bands", "s"],
                )

    schema = "doc_id long, n_shingles long, whole binary, bands array<long>, s binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


def most_bits(one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Different bits that sketches of sets of these sizes may have; -1 if their sizes rule a link out.

    Were the pair just at the threshold t, its union would have u elements and fill so many
    bins; 1 - t of these would hold different least hashes, one or two. That gives the mean and
    the spread of the number of different bits.
    """
    t, size = percent / 100, 64 * SKETCH_LONGS
    u = (one + other) / (1 + t)
    filled = BINS * (1 - np.exp(-u / BINS))
    second = 1 - np.exp(-u * (1 + t) / 2 / BINS)
    mean = (1 - t) * filled * (1 + second)
    spread = filled * t * (1 - t) * np.maximum(1 - filled / u, 0) * (1 + second) ** 2
    spread += (1 - t) * filled * second * (1 - second) + 2 * mean * mean / size
    expected = size / 2 * (1 - np.exp(-2 * mean / size))
    possible = 100 * np.minimum(one, other) >= percent * np.maximum(one, other)
    return np.where(possible, expected + SIGMAS * np.sqrt(spread) + 3, -1)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, an, bn, as, bs) that can be linked, by their sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.bitwise_count(_sketches(batch["as"]) ^ _sketches(batch["bs"])).sum(axis=1)
            sizes = (batch[c].to_numpy().astype(np.float64) for c in ("an", "bn"))
            yield batch.select(["a", "b"]).filter(pa.array(bits <= most_bits(*sizes, percent)))

    return pairs.select("a", "b", "an", "bn", "as", "bs").mapInArrow(run, "a long, b long")


def block_of() -> Column:
    """The block of a member (node) in its bucket (size)."""
    return F.pmod(F.xxhash64("node"), (F.col("size") / BLOCK).cast("int") + 1).cast("int")


def _crossing(open_: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs of members of a bucket (key) in different components that can be linked.

    ``open_`` has key, size, main (the largest component), outs (the blocks that hold someone
    outside of it), node, component, n, s, bands. Everyone outside the main component meets
    everyone. Buckets are cut into blocks of ``BLOCK`` members; two blocks, one of them with
    someone outside, meet in a task, which compares their sketches and gives out the few pairs
    that pass, each only in the first band that both have in common.
    """
    every = F.sequence(F.lit(0), (F.col("size") / BLOCK).cast("int"))
    own = block_of()
    columns = ["key", "main", "component", "node", "n", "s", "bands"]
    outside = open_.filter(F.col("component") != F.col("main"))
    met = outside.select(*columns, own.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("one")).union(
        open_.select(*columns, F.explode("outs").alias("i"), own.alias("j"), F.lit(False).alias("one"))
    )

    def pairs_of(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        one = group["one"].to_numpy(zero_copy_only=False)
        node, component, size = (group[c].to_numpy() for c in ("node", "component", "n"))
        sketch = _sketches(group["s"])
        key, main = group["key"][0].as_py(), group["main"][0].as_py()
        bands = group["bands"].flatten().to_numpy().reshape(len(group), -1)
        right, found = np.flatnonzero(~one), []
        left = np.flatnonzero(one)
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            bits = np.zeros((len(some), len(right)), dtype=np.uint16)
            for x, y in zip(sketch[some].T, sketch[right].T, strict=True):
                bits += np.bitwise_count(x[:, None] ^ y)
            limit = most_bits(size[some][:, None].astype(np.float64), size[right].astype(np.float64), percent)
            # Two members outside the main component meet twice; once is enough.
            once = (component[right] == main) | (node[some][:, None] < node[right])
            a, b = np.nonzero((bits <= limit) & (component[some][:, None] != component[right]) & once)
            for low in range(0, len(a), 8192):
                x, y = some[a[low : low + 8192]], right[b[low : low + 8192]]
                first = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == key
                found.append((node[x[first]], node[y[first]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (node[:0], node[:0])
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark = None

        def compared() -> pa.RecordBatch:
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            a, b = pairs_of(group)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            marks = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high == low:
                    continue
                this = tuple(marks[:, low].tolist())
                if held and this != mark:
                    yield compared()
                    held = []
                mark = this
                held.append(batch.slice(low, high - low))
        if held:
            yield compared()

    return (
        met.repartition(parts, "key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(lean(run), "a long, b long")
        .distinct()
    )


def _among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` (node) that ``wanted`` (node) may hold: all that it holds, and one in ``SPARE`` others.

    A filter of two bytes per wanted node goes to the rows, so that rows with texts need not be
    shuffled to be found. It is made of bitmaps of 4 KB, each by one group.
    """
    slots = (wanted.count() * SPARE // (1 << 15) + 1) << 15

    def placed(rows: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64("node"), F.lit(slots))
        return rows.withColumns({"_map": F.bitmap_bucket_number(slot), "_place": F.bitmap_bit_position(slot)})

    maps = placed(wanted).repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(_place div 8 as int) + 1, 1)), 16, 10) as int)"
    return (
        placed(docs)
        .join(F.broadcast(maps), "_map")
        .filter(f"shiftright({byte}, cast(_place % 8 as int)) % 2 = 1")
        .drop("_map", "_place", "_bits")
    )


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets are alike; sets are made from the texts.

    Sets are made where the texts are read; only sets are shuffled, not texts.
    """
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingler.set_of(t).tobytes() for t in part["text"].cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["node"], pa.array(sets, pa.binary())], names=["node", "shingles"]
                )

    texts = _among(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), wanted).select("node", "text")
    sets = stored(texts.mapInArrow(lean(build), "node long, shingles binary"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                one, other = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([one, other])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of word shingles are alike; ``component_id`` is the
    smallest doc_id that is reached over links, and ``kept`` marks its document. Documents with
    equal sets count once. Every document is first held against the most central
    one that it shares a band's bucket with; then only members of a bucket that are still in
    different components meet, so that a large group of copies costs a comparison each. Sketches
    drop hopeless pairs while they are joined; the rest is confirmed on whole sets.

    Null and empty texts and texts without words are linked with nothing, as are rows with a null
    doc_id, which are kept. Repeated rows are rows of one document; rows with one doc_id and
    different texts are linked through it. Other columns are not read.
    """
    signed = stored(signatures(docs, words, rows, bands), "signatures")
    nodes = stored(
        signed.filter(F.col("whole").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("whole")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("s").alias("s"),
        ),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = stored(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # Members with the sizes of all their buckets: the centre of a group meets most of it.
    central = (
        members.join(buckets, "key")
        .groupBy("node")
        .agg(F.collect_list("key").alias("keys"), F.sum("n").alias("met"))
        .select("node", F.explode("keys").alias("key"), F.struct("met", (-F.col("node")).alias("minus")).alias("rank"))
    )
    shared = stored(central, "members")
    leaders = stored(
        shared.groupBy("key").agg(F.max("rank").alias("lead")), "leaders"
    )
    led = shared.select("key", "node").join(leaders, "key").filter(F.col("node") != -F.col("lead.minus"))
    stars = led.groupBy("node").agg(F.max("lead").alias("lead")).select(
        (-F.col("lead.minus")).alias("a"), F.col("node").alias("b")
    )

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}n"), F.col("s").alias(f"{name}s"))

    stars = stored(
        _alike(stored(stars, "led").join(side("b"), "b").join(side("a"), "a"), percent).distinct(),
        "stars",
    )
    links = stored(_confirmed(stars, docs, words, percent), "links")
    found = stored(components(links), "components")

    # Buckets whose members are still apart: everyone outside the largest component meets all.
    placed = stored(
        shared.select("key", "node")
        .join(found, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    apart = stored(
        placed.groupBy("key", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.count("*").alias("parts"), F.max_by("component", "n").alias("main"), F.sum("n").alias("size"))
        .filter("parts > 1")
        .select("key", "main", "size"),
        "apart",
    )
    outs = (
        placed.join(apart, "key")
        .filter("component <> main")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(block_of())).alias("outs"))
    )
    apart = stored(apart.join(outs, "key"), "apart")
    open_ = placed.join(apart, "key").join(nodes.select("node", "n", "s", "bands"), "node")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crossing = _crossing(open_, percent, parts)
    crossing = stored(crossing, "crossing")
    more = stored(_confirmed(crossing, docs, words, percent), "links")
    if not more.isEmpty():
        found = stored(
            components(more.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))),
            "components",
        )
    labels = stored(
        nodes.select("whole", "node")
        .join(found, "node", "left")
        .select("whole", F.coalesce("component", "node").alias("component")),
        "labels",
    )
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return signed.select("doc_id", "n_shingles", "whole").join(labels, "whole", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest doc_id.

    Repeated rows of a kept document all stay, as they are one document, and so do rows with a
    null doc_id.
    """
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
