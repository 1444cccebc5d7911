"""Exact removal of repeated byte strings, by suffix arrays over shards of candidate segments.

Two equal windows of ``LENGTH`` bytes have the same minimiser: the k-gram with the least hash,
the leftmost one on a tie. So windows are dealt out by minimiser, each document as segments of
consecutive windows that share one. Minimisers that occur once are dropped; segments that are
equal as a whole are settled by their digest; for what is left every task sorts the suffixes of
its shards, and shards that had to be split are merged by binary search over sorted windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import stored

LENGTH = 100
GRAM = 32
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 17
#: Bytes of a suffix array's text; a shard is closed at the end of a group beyond that.
SHARD = 1 << 20
#: Distinct segments of one minimiser that one shard may hold; larger groups are split.
GROUP = 2000
LANE = 256
LAST = (1 << 63) - 1


# ---- segments


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on; ``gram`` is a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, step = 0x9E3779B97F4A7C15, 1
    with np.errstate(over="ignore"):
        while step < gram:
            h = h[:-step] * np.uint64(factor) + h[step:]
            factor = factor * factor & 0xFFFFFFFFFFFFFFFF
            step *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def leftmost_least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of the least of ``width`` neighbours from each place on, by doubling."""
    value, place = h, np.arange(len(h), dtype=np.int32)
    step = 1

    def joined(value, place, by):
        right = value[by:] < value[:-by]
        return np.where(right, value[by:], value[:-by]), np.where(right, place[by:], place[:-by])

    while 2 * step <= width:
        value, place = joined(value, place, step)
        step *= 2
    return joined(value, place, width - step) if width > step else (value, place)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours from each place on, by minima from both ends of blocks."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    full = np.full(blocks * width, np.iinfo(h.dtype).max, dtype=h.dtype)
    full[: len(h)] = h
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts that lie one after another in ``data``, each up to its end.

    Returns, per segment: minimiser hash, first window's place in ``data``, number of windows.
    """
    if len(data) < length:
        return (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    width = length - gram + 1
    h = gram_hashes(data, gram)
    value = least_of(h, width)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    inside = np.cumsum(inside[: len(value)], dtype=np.int8) > 0
    first = inside.copy()
    first[1:] &= (value[1:] != value[:-1]) | ~inside[:-1]
    first[starts[long & (starts < len(value))]] = True
    at = np.flatnonzero(first)
    total = np.concatenate([[0], np.cumsum(inside)])
    until = np.append(at[1:], len(value))
    count = total[until] - total[at]
    # Windows of one value share its leftmost place, unless they run past it: then the value
    # comes again, and the stretch is cut where its leftmost place changes.
    owner = at + np.lib.stride_tricks.sliding_window_view(h, width)[at].argmin(axis=1)
    late = np.flatnonzero(at + count - 1 > owner)
    if len(late):
        more = [at]
        for i in late.tolist():
            low, n = int(at[i]), int(count[i])
            place = leftmost_least(h[low : low + n + width - 1], width)[1]
            more.append(low + 1 + np.flatnonzero(place[1:n] != place[: n - 1]))
        at = np.sort(np.concatenate(more))
        until = np.append(at[1:], len(value))
        count = total[until] - total[at]
    return value[at], at, count


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts and where each ends."""
    values = part["text"].cast(pa.large_binary()).to_pylist()
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(values), dtype=np.uint8), ends


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of a batch: first row, rows, and of a single long text the bytes from and to."""
    sizes = np.array([len(v) for v in batch["text"].cast(pa.large_binary()).to_pylist()], dtype=np.int64)
    at = 0
    while at < len(sizes):
        if sizes[at] > CHUNK:
            for low in range(0, int(sizes[at]) - LENGTH + 1, CHUNK):
                yield at, 1, low, low + CHUNK + LENGTH - 1
            at += 1
            continue
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
        yield at, n, 0, 0
        at += n


def minimisers(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, doc, tie, first, windows: the segments of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, low, high in _chunks(batch):
                part = batch.slice(at, n)
                data, ends = _texts(part)
                if high:
                    data = data[low:high]
                    ends = np.array([len(data)])
                hashes, begin, count = segments(data, ends, length, gram)
                owner = np.searchsorted(ends, begin, "right")
                offset = np.concatenate([[0], ends[:-1]])[owner] - low
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        part["doc"].take(pa.array(owner)),
                        part["tie"].take(pa.array(owner)),
                        pa.array((begin - offset).astype(np.int64)),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["gram", "doc", "tie", "first", "windows"],
                )

    return docs.mapInArrow(run, "gram long, doc long, tie long, first long, windows int")


# ---- suffix arrays


def refined(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the rank of each place in it.

    Larsson and Sadakane: order by eight bytes, then double; only places whose group is not
    yet alone are sorted again, by the rank of the place ``h`` further on.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : n + i].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    h = 8
    while True:
        alone = new & np.append(new[1:], True)
        spots = np.flatnonzero(~alone)
        if not len(spots):
            break
        places = order[spots]
        further = np.where(places + h < n, rank[np.minimum(places + h, n - 1)] + 1, 0)
        keys = rank[places] * (n + 1) + further
        by = np.argsort(keys, kind="stable")
        order[spots] = places[by]
        keys = keys[by]
        changed = np.concatenate([[True], keys[1:] != keys[:-1]])
        new[spots] = changed
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Per place in ``order``: bytes shared with the suffix before it, up to ``most``.

    Kasai: going through the text, the common prefix shrinks by one byte at most per step. The
    text is cut into lanes that go in step, so that numpy does one byte of every lane at once.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    wide = np.concatenate([text.astype(np.int16), np.full(most + 1, -1, np.int16)])
    out = np.zeros(n, dtype=np.int64)
    at = np.arange(0, n, LANE)
    end = np.minimum(at + LANE, n)
    size = np.zeros(len(at), dtype=np.int64)
    while len(at):
        other = before[at]
        more = (other >= 0) & (size < most)
        x, y = at + size, np.maximum(other, 0) + size
        more &= (wide[x] == wide[y]) & (x < n) & (y < n)
        out[at[~more]] = size[~more]
        size = np.where(more, size + 1, np.maximum(size - 1, 0))
        at = at + ~more
        alive = at < end
        if not alive.all():
            at, end, size = at[alive], end[alive], size[alive]
    return out[order]


def repeated_windows(text: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows at ``starts`` equal one with a smaller ``place``.

    Returns a mask over ``starts``, and their order as suffixes.
    """
    order, rank = refined(text)
    runs = np.cumsum(common_prefixes(text, order, length) < length)
    position = np.empty(len(text), dtype=np.int64)
    position[order] = np.arange(len(text))
    run = runs[position[starts]]
    by = np.lexsort((place, run))
    first = np.concatenate([[True], run[by][1:] != run[by][:-1]])
    mask = np.empty(len(starts), dtype=bool)
    mask[by] = ~first
    return mask, np.argsort(position[starts], kind="stable")


FOUND = "gram long, shard int, doc long, tie long, start long, stop long, window binary"


def _flat(rows: dict[str, list], length: int):
    """Segments laid out one after another: text, window places, their segment and offset."""
    text = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
    counts = np.array(rows["windows"], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(counts + length - 1)[:-1]])
    segment = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, begin[segment] + offset, segment, offset


def shard_repeats(rows: dict[str, list], length: int) -> pa.RecordBatch:
    """Removed stretches of windows in one shard; of split groups also the windows left, sorted."""
    text, starts, segment, offset = _flat(rows, length)
    doc, tie, first = (np.array(rows[c], dtype=np.int64) for c in ("doc", "tie", "first"))
    by = np.lexsort((first, tie, doc))
    place = np.empty(len(doc), dtype=np.int64)
    place[by] = np.arange(len(doc))
    gone, order = repeated_windows(text, starts, place[segment] * LANE + offset, length)
    out: list[tuple] = []
    hit = np.flatnonzero(gone)
    if len(hit):
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(segment[hit]) != 0)) + 1
        for run in np.split(hit, cut):
            s, start = segment[run[0]], offset[run[0]]
            out.append((None, None, doc[s], tie[s], first[s] + start, first[s] + start + len(run) + length - 1, None))
    split = np.array(rows["split"], dtype=bool)
    if split.any():
        for i in order[~gone[order] & split[segment[order]]]:
            s = segment[i]
            start = first[s] + offset[i]
            window = text[starts[i] : starts[i] + length].tobytes()
            out.append((rows["gram"][s], rows["salt"][s], doc[s], tie[s], start, start + length, window))
    return _found(out)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    names = ["gram", "shard", "doc", "tie", "start", "stop", "window"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def sorted_shards(rows: DataFrame, length: int) -> DataFrame:
    """Suffix arrays over the segments of each partition, closed at ``SHARD`` bytes."""
    columns = ["gram", "salt", "split", "doc", "tie", "first", "windows", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}
        size, group = 0, None
        for batch in batches:
            values = [batch[c].to_pylist() for c in columns]
            for row in zip(*values, strict=True):
                if size >= SHARD and row[:2] != group:
                    yield shard_repeats(held, length)
                    held, size = {c: [] for c in columns}, 0
                group = row[:2]
                size += len(row[-1])
                for c, v in zip(columns, row, strict=True):
                    held[c].append(v)
        if size:
            yield shard_repeats(held, length)

    return rows.select(*columns).mapInArrow(run, FOUND)


def merged_shards(heads: DataFrame, length: int) -> DataFrame:
    """Windows of split groups that another shard has earlier; equal windows share a task.

    The sorted windows of each shard are looked up in those merged so far by binary search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shard = None
        best = np.empty(0, dtype=f"S{length}")
        owner: list[tuple] = []
        held: list[tuple] = []

        def merge() -> list[tuple]:
            nonlocal best, owner, held
            gone = []
            mine = np.array([r[-1] for r in held], dtype=f"S{length}")
            spot = np.searchsorted(best, mine)
            fresh = []
            for i, (row, at) in enumerate(zip(held, spot.tolist(), strict=True)):
                if at < len(best) and best[at] == mine[i]:
                    one, other = sorted((owner[at], row[:-1]))
                    owner[at] = one
                    gone.append(other)
                else:
                    fresh.append(i)
            if fresh:
                best = np.insert(best, spot[fresh], mine[fresh])
                known = owner
                owner, at = [], 0
                for i in fresh:
                    owner += known[at : spot[i]]
                    owner.append(held[i][:-1])
                    at = spot[i]
                owner += known[at:]
            held = []
            return gone

        for batch in batches:
            gone: list[tuple] = []
            for g, s, doc, tie, start, window in zip(
                *(batch[c].to_pylist() for c in ("gram", "shard", "doc", "tie", "start", "window")), strict=True
            ):
                if (g, s) != (group, shard):
                    gone += merge()
                    if g != group:
                        best, owner = np.empty(0, dtype=f"S{length}"), []
                    group, shard = g, s
                held.append((doc, tie, start, window))
            yield _found([(None, None, d, t, a, a + length, None) for d, t, a in gone])
        yield _found([(None, None, d, t, a, a + length, None) for d, t, a in merge()])

    return heads.mapInArrow(run, FOUND)


# ---- the operator


def _identified(docs: DataFrame) -> DataFrame:
    """doc, tie, text: documents in order; a null doc_id comes last, a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text")
    )


def _digests(marked: DataFrame, length: int) -> DataFrame:
    """gram, digest, doc, tie, first, windows: the marked segments with a hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "digest", "doc", "tie", "first", "windows"]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                marks = part["marks"].flatten()
                sizes = part["marks"].value_lengths().to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                gram, first, windows = (marks.field(c) for c in ("gram", "first", "windows"))
                texts = part["text"].cast(pa.large_binary()).to_pylist()
                digests = [
                    xxhash.xxh3_64_intdigest(texts[o][a : a + n + length - 1]) - (1 << 63)
                    for o, a, n in zip(owner.tolist(), first.to_pylist(), windows.to_pylist(), strict=True)
                ]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [gram, pa.array(digests, pa.int64()), part["doc"].take(rows), part["tie"].take(rows), first, windows],
                    names=names,
                )

    return marked.mapInArrow(run, "gram long, digest long, doc long, tie long, first long, windows int")


def _with_bytes(rows: DataFrame, length: int) -> DataFrame:
    """The wanted segments of each text, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                marks = part["marks"].flatten()
                sizes = part["marks"].value_lengths().to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                gram, salt, split, first, windows = (marks.field(c) for c in ("gram", "salt", "split", "first", "windows"))
                texts = part["text"].cast(pa.large_binary()).to_pylist()
                data = [
                    texts[o][a : a + n + length - 1]
                    for o, a, n in zip(owner.tolist(), first.to_pylist(), windows.to_pylist(), strict=True)
                ]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [gram, salt, split, part["doc"].take(rows), part["tie"].take(rows), first, windows, pa.array(data, pa.binary())],
                    names=["gram", "salt", "split", "doc", "tie", "first", "windows", "bytes"],
                )

    schema = "gram long, salt int, split boolean, doc long, tie long, first long, windows int, bytes binary"
    return rows.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): doc, tie, start, stop of repeated bytes; and doc, tie, text of all rows."""
    plain = _identified(docs)
    found = minimisers(plain, length, gram)
    several = stored(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    marks = (
        found.join(several.hint("shuffle_hash"), "gram")
        .groupBy("doc", "tie")
        .agg(F.collect_set(F.struct("gram", "first", "windows")).alias("marks"))
    )
    # Texts come from the input each time: most of them share some gram, and a copy is no smaller.
    marked = plain.join(marks, ["doc", "tie"]).dropDuplicates(["doc", "tie"])

    # What a segment says, without its bytes: they follow only where they are needed.
    pieces = stored(_digests(marked, length), "pieces")
    place = F.struct("doc", "tie", "first")
    distinct = stored(
        pieces.groupBy("gram", "digest").agg(F.min(F.struct("doc", "tie", "first", "windows")).alias("e")).select("gram", "digest", "e.*"),
        "segments",
    )
    # A segment that is equal to an earlier one as a whole goes as a whole.
    earliest = distinct.select("gram", "digest", place.alias("_earliest"))
    copies = (
        pieces.join(earliest, ["gram", "digest"])
        .filter(place != F.col("_earliest"))
        .select("doc", "tie", F.col("first").alias("start"), (F.col("first") + F.col("windows") + length - 1).alias("stop"))
    )
    shards = (F.col("n") / GROUP).cast("long") + 1
    several = stored(
        distinct.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram", shards.alias("shards")), "groups"
    )
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = (
        distinct.join(several, "gram")
        .withColumn("salt", F.pmod(F.col("digest"), F.col("shards")).cast("int"))
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("gram", "salt", (F.col("shards") > 1).alias("split"), "first", "windows")).alias("marks"))
    )
    dealt = (
        _with_bytes(plain.join(wanted, ["doc", "tie"]).dropDuplicates(["doc", "tie"]), length)
        .repartition(parts, "gram", "salt")
        .sortWithinPartitions("gram", "salt")
    )
    sorted_ = stored(sorted_shards(dealt, length), "shards")
    heads = (
        sorted_.filter(F.col("window").isNotNull())
        .repartition(parts, "window")
        .sortWithinPartitions("gram", "shard", "window")
    )
    columns = ["doc", "tie", "start", "stop"]
    spans = (
        copies.union(sorted_.filter(F.col("window").isNull()).select(columns))
        .union(merged_shards(heads, length).select(columns))
    )
    return spans, plain


def _cut_texts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].cast(pa.large_binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
                kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
                for start, stop in joined_spans(spans):
                    kept.update(text[at:start])
                    at, removed, runs = stop, removed + stop - start, runs + 1
                kept.update(text[at:])
                out.append((removed, runs, kept.hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], batch["tie"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["doc", "tie", "n_removed", "n_spans", "kept"],
            )

    return rows.select("doc", "tie", "text", "spans").mapInArrow(
        run, "doc long, tie long, n_removed long, n_spans long, kept string"
    )


def joined_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes around it also starts earlier, in a smaller
    doc_id or earlier in the same text. Null texts are empty; a null doc_id comes last; rows with
    one doc_id and one text are one document, with one result each; rows with one doc_id and
    different texts follow in the order of a hash of the text. Other columns are not read.
    """
    spans, texts = repeated_spans(docs, length, gram)
    gathered = spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = stored(_cut_texts(texts.join(gathered, ["doc", "tie"]).dropDuplicates(["doc", "tie"])), "cut")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text).alias("tie"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("_whole"),
    )

    def or_none(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    return whole.join(cut, ["doc", "tie"], "left").select(
        "doc_id", "n_bytes", or_none("n_removed"), or_none("n_spans"), F.coalesce("kept", "_whole").alias("kept_sha256")
    )
