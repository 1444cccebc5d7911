"""Token ids as binary files: canonical, length-limited Huffman codes in independent blocks.

A file set is a Spark table of frames, one binary column: a frame is a block of whole documents
that can be read alone. Its layout, all little-endian:

    0   4   magic "HUF1"
    4   4   documents in the block (m)
    8   4   ids per checkpoint (step)
    12  8   place of the block's first id among those of its slice
    20  8m  per document: doc_id
    ..  m   per document: 1 where the doc_id is null
    ..  4m  per document: number of its ids
    ..  4m  per document: bytes of its codes
    ..  4k  per document, for every step-th id from the first: bit offset from the document's start
    ..      the codes, each document from a new byte on, most significant bit first; 8 bytes of padding

The code is canonical: lengths per id are all that a reader needs, and they are stored once.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, compress, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.common import LONG_MIN, boundaries, lean, scratch_path, slice_of, stored

MAGIC = b"HUF1"
LIMIT = 16
STEP = 256
#: Ids that are coded at a time.
RUN = 1 << 18
#: A block is closed once it holds so many ids: some 200 KB, which the JVM moves about with ease.
BLOCK = 1 << 17
END_ID = 0
#: Words that a task keeps with their ids before it starts anew: some 100 MB.
CACHE = 500_000
#: Signs that are cut into words at a time; a sign takes some 50 bytes.
CHARS = 500_000
#: Bytes of text that are encoded at a time, so that a word is looked up once in all of them.
LUMP = 8_000_000
#: New words that are encoded at a time; the library's own results are large.
LEARNT = 16_384
#: Words that go through the library's merges in one call.
MERGED = 32


def cut_at_words(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` signs, cut where a single space stands between two words.

    The pattern starts a word there, so the ids of the parts are those of the whole.
    """
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while 0 <= end < len(text) - 1 and (text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.find(" ", end + 1)
        if not 0 <= end < len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


LETTER, NUMBER, SPACE, LINE, OTHER, ODD, UNSEEN = range(7)


#: The first sign beyond the Latin ones, on whose kinds all engines agree.
LATIN = "\u0250"


def byte_signs() -> np.ndarray:
    """The sign that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs = np.arange(256, dtype="<u2")
    others = [b for b in range(256) if b not in shown]
    signs[others] = 256 + np.arange(len(others))
    return signs


def free_sign(vocabulary: dict[str, int], signs: np.ndarray) -> str | None:
    """The sign of a control byte other than a new line that no merge takes up, if there is one."""
    longer = "".join(t for t in vocabulary if len(t) > 1)
    controls = (chr(signs[b]) for b in range(32) if b != 10)
    return next((c for c in controls if c in vocabulary and c not in longer), None)


class Grown:
    """An array that is filled in place and moved only when it doubles."""

    def __init__(self, kind: type):
        self.values, self.size = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.values):
            wider = np.empty(2 * size, self.values.dtype)
            wider[: self.size] = self.values[: self.size]
            self.values = wider
        self.values[self.size : size] = more
        self.size = size


class Encoder:
    """Ids of texts by a tokenizer file, remembering the words that its pattern cuts.

    The vocabulary's pattern makes words of letters, of numbers, or of anything else, each with
    the space before it, and merges stay inside words. So each different word is encoded once by
    the library, and texts are put together from the results. Latin words go to its merges without
    the pattern, many in a call: a sign that is in no merge stands after each. Texts with
    apostrophes, runs of white space, special tokens, or signs on which engines may differ are
    encoded whole.
    """

    LONGEST = 64

    def __init__(self, path: str):
        # Tasks are the threads here; a pool of the library's own would keep memory per thread.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.signs = self.tokenizer.model.tokenize, byte_signs()
        vocabulary = self.tokenizer.get_vocab()
        self.stop = free_sign(vocabulary, self.signs)
        if self.stop:
            self.stop_id = vocabulary[self.stop]
            self.signs[0] = ord(self.stop)
        self.classes = np.full(0x110000, UNSEEN, dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.sizes, self.starts, self.flat = (Grown(t) for t in (np.int32, np.int32, np.uint32))

    def _classes_of(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        if (out == UNSEEN).any():
            for point in np.unique(points[out == UNSEEN]).tolist():
                sign, kind = chr(point), unicodedata.category(chr(point))
                if sign == " ":
                    value = SPACE
                elif sign == "\n":
                    value = LINE
                elif sign.isspace() or sign == "'" or kind[0] == "C":
                    value = ODD
                else:
                    value = {"L": LETTER, "N": NUMBER}.get(kind[0], ODD if kind[0] == "Z" else OTHER)
                self.classes[point] = value
            out = self.classes[points]
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the library's merges alone, and how many each word has."""
        raw = np.frombuffer("\0".join(words).encode(), np.uint8)
        signs = self.signs[raw].tobytes().decode("utf-16-le").split(self.stop)
        ids: list[int] = []
        for at in range(0, len(words), MERGED):
            ids += [t.id for t in self.merges(self.stop.join(signs[at : at + MERGED]) + self.stop)]
        flat = np.array(ids, dtype=np.uint32)
        stops = flat == self.stop_id
        return flat[~stops], np.diff(np.flatnonzero(stops), prepend=-1) - 1

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library's whole way."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes

    def _learn(self, words: list[str]) -> None:
        # What is Latin is one word of the pattern on every engine, and needs the library's merges alone.
        latin = np.array([bool(self.stop) and (w.isascii() or max(w) < LATIN) for w in words], dtype=bool)
        starts, sizes = np.empty((2, len(words)), dtype=np.int64)
        for mine, way in ((latin, self._merged), (~latin, self._coded)):
            if mine.any():
                ids, size = way(list(compress(words, mine)))
                starts[mine], sizes[mine] = self.flat.size + np.cumsum(size) - size, size
                self.flat.add(ids)
        self.starts.add(starts)
        self.sizes.add(sizes)

    def _numbers(self, words: list[pa.DictionaryArray]) -> list[np.ndarray]:
        """The places of words among those that are known; new ones are learnt."""
        # A common dictionary begins with that of the first chunk, so known words keep their places.
        known = pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), self.words)
        _, *words = pa.chunked_array([known, *words]).unify_dictionaries().chunks
        for at in range(len(self.words), len(words[0].dictionary), LEARNT):
            self._learn(words[0].dictionary[at : at + LEARNT].to_numpy(zero_copy_only=False).tolist())
        self.words = words[0].dictionary
        return [w.indices.to_numpy() for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id; so many signs at a time that arrays stay small."""
        if len(self.words) > CACHE:
            self._forget()
        groups: list[list[str]] = [[]]
        parts_of, size = [], 0
        for text in texts:
            parts = list(cut_at_words(text, CHARS))
            parts_of.append(len(parts))
            for part in parts:
                if size + len(part) > CHARS and groups[-1]:
                    groups.append([])
                    size = 0
                groups[-1].append(part)
                size += len(part)
        plain, counts, words = zip(*map(self._cut, groups), strict=True)
        coded = chain.from_iterable(map(self._put, groups, plain, counts, self._numbers(list(words))))
        end = np.array([END_ID], dtype=np.uint32)
        return [np.concatenate([*islice(coded, n), end]) for n in parts_of]

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Per text whether it is made of its words, and the number of these; then the words."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        plain = np.array(["<|" not in t for t in texts], dtype=bool)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(points):
            return plain, sizes, pa.array([], pa.string()).dictionary_encode()
        last = np.cumsum(sizes)
        first = last - sizes
        kinds = self._classes_of(points)
        blank = (kinds == SPACE) | (kinds == LINE)
        starts = np.empty(len(points), dtype=bool)
        starts[0] = True
        starts[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != SPACE) | (kinds[1:] == LINE)
        bad = kinds == ODD
        bad[1:] |= blank[1:] & blank[:-1]
        starts[first[sizes > 0]] = True
        at = np.flatnonzero(starts)
        bad[at[np.diff(at, append=len(points)) > self.LONGEST]] = True
        # White space may be counted over the seam of two texts; that only sends one of them whole.
        plain[np.searchsorted(last, np.flatnonzero(bad), side="right")] = False
        counts = np.searchsorted(at, last) - np.searchsorted(at, first)
        data = joined.encode("utf-8", "surrogatepass")
        if len(data) > len(points):
            # From places of signs to those of their first bytes; other bytes are below -64.
            at = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)[at]
        cuts = np.append(at, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(data))
        if not plain.all():
            words = words.filter(pa.array(np.repeat(plain, counts)))
        return plain, counts * plain, words.dictionary_encode()

    def _put(self, texts: list[str], plain: np.ndarray, counts: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, without the end id, from the numbers of the words."""
        size = self.sizes.values[number].astype(np.int64)
        begin = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.flat.values[np.repeat(self.starts.values[number] - begin, size) + np.arange(total)]
        words = np.cumsum(counts)
        begin = np.append(begin, total)
        spans = zip(begin[words - counts].tolist(), begin[words].tolist(), strict=True)
        return [ids[a:b] if x else self._whole(t) for t, x, (a, b) in zip(texts, plain.tolist(), spans, strict=True)]


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into codes of {limit} bits")
    leaves = np.sort(counts[used].astype(np.float64), kind="stable")
    by_weight = used[np.argsort(counts[used], kind="stable")]
    # Per level: is a place of the merged list a leaf? From the longest codes to the shortest.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        order = np.argsort(weights, kind="stable")
        levels.append(order < len(leaves))
        merged = weights[order]
        pairs = len(merged) // 2
        packages = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    take = 2 * (len(used) - 1)
    for is_leaf in reversed(levels):
        chosen = is_leaf[:take]
        n = int(chosen.sum())
        lengths[by_weight[:n]] += 1
        take = 2 * (take - n)
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then id, counting up."""
    out = np.zeros(len(lengths), dtype=np.uint32)
    code = before = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for n in np.unique(lengths[lengths > 0]).tolist():
        mine = order[lengths[order] == n]
        code <<= n - before
        out[mine] = code + np.arange(len(mine))
        code, before = code + len(mine), n
    return out


def decoding_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every possible next ``limit`` bits."""
    ids = np.zeros(1 << limit, dtype=np.uint32)
    sizes = np.zeros(1 << limit, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    widths = 1 << (limit - lengths[order].astype(np.int64))
    filled = int(widths.sum())
    ids[:filled] = np.repeat(order, widths)
    sizes[:filled] = np.repeat(lengths[order], widths)
    return ids, sizes


def packed(docs: list[np.ndarray], code: np.ndarray, lengths: np.ndarray, step: int) -> list[tuple[bytes, bytes]]:
    """Per document the codes as bytes, and the bit offsets of every ``step``-th id."""
    ids = np.concatenate(docs)
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    first = np.cumsum(counts) - counts
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    bits = ends[first + counts - 1] - starts[first]
    sizes = (bits + 7) >> 3
    begin = np.cumsum(sizes) - sizes
    inside = starts - np.repeat(starts[first], counts)
    place = inside + np.repeat(begin * 8, counts)
    # A code is at most 25 bits long: it lies in one word of 32 bits, or runs over into the next.
    # The codes that begin in a word do not overlap, so their sum is their union, and only the
    # last of them runs over.
    word = place >> 5
    moved = code[ids].astype(np.uint64) << (64 - (place & 31) - size).astype(np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    tails = np.append(heads[1:], len(word)) - 1
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    out[word[heads]] = np.add.reduceat(moved >> np.uint64(32), heads)
    out[word[heads] + 1] += moved[tails] & np.uint64(0xFFFFFFFF)
    out = out.astype(">u4")
    data, offsets = out.tobytes(), inside.astype("<u4")
    return [
        (data[b : b + n], offsets[f : f + c : step].tobytes())
        for b, n, f, c in zip(begin.tolist(), sizes.tolist(), first.tolist(), counts.tolist(), strict=True)
    ]


def unpacked(data: np.ndarray, at: np.ndarray, counts: np.ndarray, table) -> np.ndarray:
    """The ids from each of the bit places ``at`` on, so many each; all are read in step."""
    ids, sizes = table
    limit = int(len(ids)).bit_length() - 1
    most = int(counts.max(initial=0))
    out = np.empty((most, len(at)), dtype=np.uint32)
    last = len(data) - 4
    wide = data.astype(np.uint32)
    wide = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    at = at.astype(np.int64)
    for i in range(most):
        look = (wide[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[i] = ids[look]
        at += sizes[look]
    return out.T[np.arange(most) < counts[:, None]]


def frame(first: int, docs: list[tuple[int | None, int, bytes, bytes]], step: int) -> bytes:
    """A block of whole documents: doc_id, number of ids, codes, bit offsets."""
    names, counts, data, offsets = zip(*docs, strict=True)
    return b"".join(
        [
            struct.pack("<4sIIq", MAGIC, len(docs), step, first),
            np.array([d or 0 for d in names], dtype="<i8").tobytes(),
            np.array([d is None for d in names], dtype=np.uint8).tobytes(),
            np.array(counts, dtype="<u4").tobytes(),
            np.array([len(d) for d in data], dtype="<u4").tobytes(),
            *offsets,
            *data,
            bytes(8),
        ]
    )


def read_frame(data: bytes | pa.Buffer, table) -> tuple[int, list[int | None], list[np.ndarray]]:
    """Place of the first id, the doc_ids, and the ids of each document."""
    magic, m, step, first = struct.unpack_from("<4sIIq", data)
    if magic != MAGIC:
        raise ValueError("no frame of token ids")
    at = 20
    names = np.frombuffer(data, "<i8", m, at).tolist()
    null = np.frombuffer(data, np.uint8, m, at + 8 * m).tolist()
    counts = np.frombuffer(data, "<u4", m, at + 9 * m).astype(np.int64)
    sizes = np.frombuffer(data, "<u4", m, at + 13 * m).astype(np.int64)
    at += 17 * m
    lanes = -(-counts // step)
    offsets = np.frombuffer(data, "<u4", int(lanes.sum()), at).astype(np.int64)
    begin = np.repeat((np.cumsum(sizes) - sizes) * 8, lanes)
    inside = np.arange(len(offsets)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    read = np.minimum(step, np.repeat(counts, lanes) - inside * step)
    codes = np.frombuffer(data, np.uint8, -1, at + 4 * len(offsets))
    ids = unpacked(codes, begin + offsets, read, table)
    docs = np.split(ids, np.cumsum(counts)[:-1])
    return first, [None if z else d for d, z in zip(names, null, strict=True)], docs


def lumps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``LUMP`` bytes of text; a larger text may make one larger."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // LUMP)) + 1).tolist(), batch.num_rows]
    for at, end in pairwise(cuts):
        if at < end:
            yield batch.slice(at, end - at)


DRAFT = "doc_id long, tie long, n long, wide boolean, ids binary"


def drafted(docs: DataFrame, path: str) -> DataFrame:
    """All texts as ids of two bytes, or of four if the vocabulary needs them; one row each.

    Texts are encoded once, here. ``tie`` is a hash of the text, to order equal doc_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        for batch in batches:
            for some in lumps(batch):
                coded = encoder.encode(some["text"].to_pylist())
                data = [x.astype("<u4" if wide else "<u2").tobytes() for x in coded]
                yield pa.RecordBatch.from_arrays(
                    [
                        some["doc_id"], some["tie"], pa.array([len(x) for x in coded], pa.int64()),
                        pa.array([wide] * len(coded)), pa.array(data, pa.binary()),
                    ],
                    names=["doc_id", "tie", "n", "wide", "ids"],
                )

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")).mapInArrow(lean(run), DRAFT)


def _ids_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The ids of a batch's documents, in runs of a bounded number of ids, with the first row."""
    held: list[np.ndarray] = []
    first = size = 0
    for row, (wide, data) in enumerate(zip(batch["wide"], batch["ids"], strict=True)):
        held.append(np.frombuffer(data.as_buffer(), dtype="<u4" if wide.as_py() else "<u2"))
        size += len(held[-1])
        if size >= RUN:
            yield first, held
            held, first, size = [], row + 1, 0
    if held:
        yield first, held


def count_ids(draft: DataFrame) -> np.ndarray:
    """How often each id occurs in all texts; one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for _, docs in _ids_of(batch):
                more = np.bincount(np.concatenate(docs), minlength=len(total))
                more[: len(total)] += total
                total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = draft.select("wide", "ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(max(rows["id"].to_pylist(), default=0) + 1, dtype=np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


CODED = "doc_id long, tie long, n long, data binary, offsets binary"


def recoded(draft: DataFrame, shared, step: int) -> DataFrame:
    """The documents of a draft in the common code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, code = shared.value
        for batch in batches:
            for first, docs in _ids_of(batch):
                some = batch.slice(first, len(docs))
                payload, offsets = zip(*packed(docs, code, lengths, step), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], some["tie"], some["n"], pa.array(payload, pa.binary()), pa.array(offsets, pa.binary())],
                    names=["doc_id", "tie", "n", "data", "offsets"],
                )

    return draft.mapInArrow(lean(run), CODED)


def write_ids(
    docs: DataFrame, path: str, target: str, parts: int | None = None, step: int = STEP, block: int = BLOCK
) -> None:
    """Writes all texts as frames below ``target``, in ascending doc_id.

    ``target/frames`` has (slice, block, ids, frame), ``target/code`` the code lengths, and
    ``target/slices`` the ids per slice. Texts are encoded once, into plain ids; once the counts
    over all of them are known, they are coded and put in order.
    """
    spark = docs.sparkSession
    draft = stored(drafted(docs, path), "token-drafts")
    counts = count_ids(draft)
    # More ids than codes of the usual limit get the least one at which they fit.
    lengths = code_lengths(counts, max(LIMIT, int(np.count_nonzero(counts) - 1).bit_length()))
    spark.createDataFrame(
        [(i, int(n)) for i, n in enumerate(lengths.tolist()) if n], "id int, bits int"
    ).coalesce(1).write.parquet(f"{target}/code")
    shared = spark.sparkContext.broadcast((lengths, codes(lengths)))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MIN))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = boundaries(docs.select(key.alias("_key")), "_key", parts)
    rows = (
        recoded(draft, shared, step)
        .withColumn("slice", slice_of(key, cuts))
        .repartition(len(cuts) + 1, "slice")
        .sortWithinPartitions("slice", F.col("doc_id").asc_nulls_first(), "tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, number, size = None, 0, 0, 0
        held: list[tuple[int | None, int, bytes, bytes]] = []

        def flushed():
            nonlocal first, number, size, held
            if held:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([number], pa.int64()),
                        pa.array([size], pa.int64()), pa.array([frame(first, held, step)], pa.binary()),
                    ],
                    names=["slice", "block", "ids", "frame"],
                )
                first, number, size, held = first + size, number + 1, 0, []

        for batch in batches:
            for p, *doc in zip(*(batch[c].to_pylist() for c in ("slice", "doc_id", "n", "data", "offsets")), strict=True):
                if p != part:
                    yield from flushed()
                    part, first, number = p, 0, 0
                held.append(tuple(doc))
                size += doc[1]
                if size >= block:
                    yield from flushed()
        yield from flushed()

    rows.mapInArrow(lean(run), "slice int, block long, ids long, frame binary").write.parquet(f"{target}/frames")
    spark.read.parquet(f"{target}/frames").groupBy("slice").agg(F.sum("ids").alias("ids")).write.parquet(
        f"{target}/slices"
    )


LISTING = "slice int, doc_id long, at long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """One row per document, decoded from the frames: doc_id, start, n_tokens, ids_crc32."""
    code = spark.read.parquet(f"{target}/code").toArrow()  # one row per id of the vocabulary
    lengths = np.zeros(max(code["id"].to_pylist(), default=0) + 1, dtype=np.uint8)
    lengths[code["id"].to_numpy()] = code["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        table = decoding_table(lengths, max(LIMIT, int(lengths.max(initial=0))))
        for batch in batches:
            for part, data in zip(batch["slice"].to_pylist(), batch["frame"], strict=True):
                first, names, docs = read_frame(data.as_buffer(), table)
                sizes = np.array([len(d) for d in docs], dtype=np.int64)
                crcs = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(docs), pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(first + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["slice", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # As many rows as the writer had slices, whatever the size of the table.
    totals = sorted((r["slice"], r["ids"]) for r in spark.read.parquet(f"{target}/slices").collect())
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    known = spark.createDataFrame(offsets, "_part int, _before long")
    listed = spark.read.parquet(f"{target}/frames").select("slice", "frame").mapInArrow(lean(run), LISTING)
    return listed.join(F.broadcast(known), F.col("slice") == F.col("_part")).select(
        "doc_id", (F.col("at") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes all texts as token ids and lists the documents from the files.

    Null texts count as empty and hold the end id alone. A null doc_id comes first; rows with one
    doc_id follow each other in the order of a hash of their texts. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    target = scratch_path(spark, "token-ids")
    write_ids(docs.select("doc_id", "text"), path, target, **options)
    return read_ids(spark, target)
