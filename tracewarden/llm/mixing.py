"""Mixing sources to target weights, by blocks of words and pseudorandom index permutations.

Every source is a stream of words, its documents in a fixed order, cut into blocks of equal
length. The mix is a set of output shards. A source's share of slots is dealt to the shards by
multinomial draws; slot j of a source reads block perm(j mod blocks) of pass j div blocks, so a
block is read once before any is read twice. Slots and blocks meet in a join on their index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import SPACED_WORD, lean, running_total, stored

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 20_240_601

SLOTS = "shard long, slot long, sid int, pass int, block long, take int"


@dataclass(frozen=True)
class Source:
    """One source of a mix; ``sid`` is its place in code point order, null last.

    All slots take their whole block, but for the last one, which takes ``rest`` words.
    """

    sid: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    rest: int


def targets(sizes: list[int], weights: tuple[int, ...], share: Fraction, most: int) -> list[Fraction]:
    """Words to take from each source: by weight, at most ``most`` times its size.

    What a source cannot give is shared again by weight among those below their limit.
    """
    out = [Fraction(0)] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while open_ and left:
        total = sum(weights[i % len(weights)] for i in open_)
        part = {i: left * weights[i % len(weights)] / total for i in open_}
        full = [i for i in open_ if part[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = part[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
        return x ^ (x >> np.uint64(29))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to ``size - 1``, applied to ``index``.

    A Feistel network over the next even power of two; values beyond the range walk on along
    their cycle until they come back into it.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for turn in range(4):
            left, right = right, left ^ (mixed(right, key * 4 + turn) & mask)
        x = (left << shift) | right
        out[walking] = x
        walking = walking[x >= np.uint64(size)]
    return out.astype(np.int64)


def place_of(value: int, size: int, key: int) -> int:
    """The index that ``permuted`` sends to ``value``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    x = value
    while True:
        left, right = x >> half, x & mask
        for turn in reversed(range(4)):
            before = left
            left, right = right ^ (int(mixed(np.array([before]), key * 4 + turn)[0]) & mask), before
        x = left << half | right
        if x < size:
            return x


def pass_key(sid: int, turn: int) -> int:
    return SEED + 1000 * sid + turn


def slots_for(words: int, size: int, block_words: int, sid: int) -> tuple[int, int]:
    """Slots of a source from which exactly ``words`` words come, and the words of the last one.

    Whole passes take the source's whole size. In the pass that is cut the short last block
    counts with its own words, at the place where the permutation has put it.
    """
    if not words or not size:
        return 0, 0
    blocks = -(-size // block_words)
    turns, left = divmod(words, size)
    if not left:
        turns, left = turns - 1, size
    gap = blocks * block_words - size
    short = place_of(blocks - 1, blocks, pass_key(sid, turns))
    count = -(-left // block_words)
    if count > short:
        count = max(short + 1, -(-(left + gap) // block_words))
    before = (count - 1) * block_words - (gap if count - 1 > short else 0)
    return turns * blocks + count, left - before


def dealt(total: int, shard: int, shards: int, key: int) -> tuple[int, int]:
    """First slot and number of slots that a source has in a shard.

    One multinomial draw of ``total`` over all shards, split in halves: each node of the tree
    draws from its own seed, so that a shard finds its numbers along one path, alone.
    """
    low, high, first = 0, shards, 0
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([SEED, key, low, high]))
        left = int(rng.binomial(total, (middle - low) / (high - low)))
        if shard < middle:
            total, high = left, middle
        else:
            first, total, low = first + left, total - left, middle
    return first, total


def mix_plan(sizes: DataFrame, block_words: int, weights: tuple[int, ...], share: Fraction, most: int) -> list[Source]:
    """The sources with targets. One row per source reaches the driver: a mix names its sources."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["size"] for r in rows], weights, share, most)
    out = []
    for sid, (row, target) in enumerate(zip(rows, wanted, strict=True)):
        blocks = -(-row["size"] // block_words)
        slots, rest = slots_for(int(target + Fraction(1, 2)), row["size"], block_words, sid)
        out.append(Source(sid, row["source"], row["size"], float(target), blocks, slots, rest))
    return out


def slot_table(spark: SparkSession, plan: list[Source], block_words: int, shard_slots: int) -> DataFrame:
    """Every slot of every output shard with the block that it reads; made shard by shard.

    ``take`` is the number of words that the slot may take of its block.
    """
    total = sum(s.slots for s in plan)
    shards = max(1, -(-total // shard_slots))
    sources = [s for s in plan if s.slots]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                sid, turn, block, take = [], [], [], []
                for s in sources:
                    first, count = dealt(s.slots, shard, shards, s.sid)
                    j = np.arange(first, first + count)
                    for t in np.unique(j // s.blocks):
                        k = j[j // s.blocks == t] % s.blocks
                        sid.append(np.full(len(k), s.sid, dtype=np.int32))
                        turn.append(np.full(len(k), t, dtype=np.int32))
                        block.append(permuted(k, s.blocks, pass_key(s.sid, int(t))))
                    take.append(np.where(j == s.slots - 1, s.rest, block_words).astype(np.int32))
                if not sid:
                    continue
                n = sum(map(len, sid))
                slot = permuted(np.arange(n), n, SEED - 1 - shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(slot)]
                    + [pa.array(np.concatenate(x)) for x in (sid, turn, block, take)],
                    names=["shard", "slot", "sid", "pass", "block", "take"],
                )

    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, shards, 1, tasks).mapInArrow(lean(fill), SLOTS)


def mix_documents(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    most: int = MOST,
    shard_slots: int = SHARD_SLOTS,
    slices: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents that it was made of.

    A source gives its target, rounded to whole words: the last of its slots takes a part of its
    block. The mix has a row per slot and document piece: shard, slot, sid, pass, block, doc_at (the
    document's first word in its source's stream), word_from, word_to (words of the document,
    the end left out). The documents come with sid, doc_at, source_size and target. Words are
    runs between ASCII white space. Null and empty texts have none and are never taken; a null
    source is a source, the last one; repeated rows are documents of their own, told apart by
    doc_at; empty tables give empty results. Other columns are not looked at.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    sizes = stored(
        docs.select(
            "doc_id", "source", words.alias("size"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text")
        ),
        "mixing",
    )
    plan = mix_plan(sizes, block_words, weights, share, most)
    names = spark.createDataFrame(
        [(s.name, s.sid, s.size, s.target) for s in plan],
        "_name string, sid int, source_size long, target double",
    )
    known = stored(
        running_total(
            sizes.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_name"))).drop("_name"),
            ["sid"],
            [F.col("doc_id"), F.col("size"), F.col("_text")],
            F.pmod(F.xxhash64("doc_id"), F.lit(slices)),
            "size",
            "doc_at",
        ),
        "mixing-known",
    )
    end = F.col("doc_at") + F.col("size")
    block = F.explode(
        F.sequence(F.floor(F.col("doc_at") / block_words), F.floor((end - 1) / block_words))
    )
    pieces = (
        known.filter(F.col("size") > 0)
        .select("sid", block.alias("block"), "doc_at", end.alias("_end"))
        .select(
            "sid",
            "block",
            "doc_at",
            (F.greatest(F.col("doc_at"), F.col("block") * block_words) - F.col("doc_at")).alias("word_from"),
            (F.least("_end", (F.col("block") + 1) * block_words) - F.col("doc_at")).alias("word_to"),
        )
    )
    # Both sides grow with the data. The planner only sees the few rows that slots are made from,
    # so it is told not to broadcast them.
    slots = slot_table(spark, plan, block_words, shard_slots).hint("merge")
    limit = F.col("block") * block_words + F.col("take") - F.col("doc_at")
    mix = slots.join(pieces, ["sid", "block"]).withColumn("word_to", F.least("word_to", limit)).drop("take")
    return mix.filter("word_from < word_to"), known


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes."""
    mix, known = mix_documents(docs, **options)
    taken = mix.groupBy("sid", "doc_at").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    listed = known.join(taken, ["sid", "doc_at"], "left")
    own = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0))
    return listed.select("doc_id", "size", "source_size", "target", own.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row per document and pass that took some of it.

    The text of a row is made of the document's words that were taken in that pass, in their
    order: stretches of taken blocks with the white space inside them, joined by line breaks. A
    document that a pass took as a whole keeps its text as it is. ``n_chars``, if there, is
    counted anew; documents that the mix takes nothing of, and those without words, are left out.
    """
    mix, known = mix_documents(docs, **options)
    text = F.coalesce(F.col("text"), F.lit(""))
    taken = (
        mix.groupBy("sid", "doc_at", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("_taken"))
        .groupBy("sid", "doc_at")
        .agg(F.collect_list("_taken").alias("_passes"))
        .join(known.filter("size > 0"), ["sid", "doc_at"])
    )
    # Rows are told apart by what they hold; equal rows stand for each other, in any order.
    again = Window.partitionBy("_row").orderBy(F.lit(0))
    nth = F.row_number().over(again)
    mine = taken.select(F.xxhash64("doc_id", "source", "_text").alias("_row"), "size", "_passes").withColumn("_nth", nth)
    columns = docs.columns
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in columns]).alias("_d"),
        F.xxhash64("doc_id", "source", F.xxhash64(text)).alias("_row"),
    ).withColumn("_nth", nth)
    met = rows.join(mine, ["_row", "_nth"]).select("_d", "size", F.explode("_passes").alias("_taken"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(SPACED_WORD)
        for batch in batches:
            out = dict(zip(columns, batch["_d"].flatten(), strict=True))
            texts = []
            for value, size, stretches in zip(
                out["text"].to_pylist(), batch["size"].to_pylist(), batch["_taken"].to_pylist(), strict=True
            ):
                joined: list[list[int]] = []
                for piece in stretches:
                    if joined and joined[-1][1] == piece["word_from"]:
                        joined[-1][1] = piece["word_to"]
                    else:
                        joined.append([piece["word_from"], piece["word_to"]])
                if joined != [[0, size]]:
                    spans = [m.span() for m in word.finditer(value)]
                    value = "\n".join(value[spans[a][0] : spans[b - 1][1]] for a, b in joined)
                texts.append(value)
            out["text"] = pa.array(texts, pa.string())
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) for t in texts], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=columns)

    return met.mapInArrow(lean(cut), docs.schema)
