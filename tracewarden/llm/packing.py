"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import SPACED_WORD, stored
from tracewarden.operators.ranking import numbered

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: A group above this share of a shard's capacity, in any of the three, is placed by itself.
OWN_SHARE = 1 / 64
#: A group above this share is split into pieces of half of it.
SPLIT_SHARE = 1 / 2
#: Small groups are gathered into cells, by their hash. Per level: share of the hash space in
#: parts of 100, cells per shard. The first level fills the shards, the last ones level them.
LEVELS = ((90, 32), (9, 32), (1, 32))


@dataclass(frozen=True)
class Placement:
    """Where groups go. Both tables are bounded by the number of shards, not by the data."""

    large: DataFrame  # _group, _pieces
    items: DataFrame  # _item, _piece, shard


def measured(docs: DataFrame) -> dict[str, Column]:
    """Group, and the three measures of a row; a null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "_group": F.xxhash64(text),
        "_bytes": (F.octet_length(text) + ROW_BYTES).cast("long"),
        "_tokens": F.regexp_count(text, F.lit(SPACED_WORD)).cast("long"),
        "_rows": F.lit(1).cast("long"),
        "_split": F.xxhash64(F.col("doc_id"), F.lit("piece")),
    }


def _located(rows: DataFrame, large: DataFrame, shards: int) -> DataFrame:
    """Adds _item and _piece: a large group's own id and piece, or the cell of a small group."""
    joined = rows.join(F.broadcast(large), "_group", "left")
    spot = F.pmod(F.shiftrightunsigned(F.col("_group"), 20), F.lit(100))
    cell, floor, first = F.lit(0), 0, 0
    for share, per_shard in LEVELS:
        cells = shards * per_shard
        inside = F.pmod(F.xxhash64("_group"), F.lit(cells)) + first
        cell = F.when(spot >= floor, inside).otherwise(cell)
        floor, first = floor + share, first + cells
    own = F.col("_pieces").isNotNull()
    return joined.withColumn("_item", F.when(own, F.col("_group")).otherwise(cell)).withColumn(
        "_piece",
        F.when(own, F.pmod(F.col("_split"), F.col("_pieces"))).otherwise(F.lit(-1)).cast("long"),
    ).drop("_pieces")


def place(weights: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each item (rows: bytes, tokens, rows), largest first.

    An item goes where the dot product of its vector with the residual capacity is highest.
    Small items look at the bytes above all, so that they level what the large ones left.
    """
    total = weights.sum(axis=0)
    capacity = np.maximum(total / shards, 1e-9)
    share = weights / capacity
    residual = np.ones((shards, 3))
    out = np.zeros(len(weights), dtype=np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        joint = min(1.0, 8 * share[i].max()) / 2
        look = share[i] * np.array([1.0, joint, joint])
        best = int(np.argmax(residual @ look))
        out[i] = best
        residual[best] -= share[i]
    return out


def plan_shards(docs: DataFrame, shards: int) -> Placement:
    """Decides the shard of every group of equal texts.

    Two passes over three numbers a row: groups are summed, the few large ones come back one by
    one, all others as sums over cells. At most ``3 * shards / OWN_SHARE`` large groups, their
    pieces, and ``shards * 96`` cells reach the driver, whatever the size of the table.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(*[c.alias(n) for n, c in measured(docs).items()]), "packing")
    sums = [F.sum(c).alias(c) for c in ("_bytes", "_tokens", "_rows")]
    total = rows.agg(*sums).first()
    capacity = {c: max((total[c] or 0) / shards, 1.0) for c in ("_bytes", "_tokens", "_rows")}
    share = F.greatest(*[F.col(c) / capacity[c] for c in capacity])
    groups = rows.groupBy("_group").agg(*sums).withColumn("_share", share)
    large = [
        (r["_group"], 1 if r["_share"] <= SPLIT_SHARE else int(-(-r["_share"] // (SPLIT_SHARE / 2))))
        for r in groups.filter(F.col("_share") > OWN_SHARE).select("_group", "_share").collect()
    ]
    large_table = spark.createDataFrame(sorted(large), "_group long, _pieces long")
    cells = (
        _located(rows, large_table, shards).groupBy("_item", "_piece").agg(*sums).orderBy("_item", "_piece")
    ).collect()
    weights = np.array([[r["_bytes"], r["_tokens"], r["_rows"]] for r in cells], dtype=float)
    where = place(weights.reshape(-1, 3), shards)
    items = spark.createDataFrame(
        [(r["_item"], r["_piece"], int(s)) for r, s in zip(cells, where, strict=True)],
        "_item long, _piece long, shard int",
    )
    return Placement(large_table, items)


def with_shards(docs: DataFrame, shards: int, placement: Placement | None = None) -> DataFrame:
    """``docs`` with a column ``shard``, 0 to ``shards - 1``. No row of text is shuffled.

    Rows of equal text share a shard, unless their group is larger than half a shard. Null and
    empty texts are one group. An existing column ``shard`` is replaced. Repeated rows count
    each; an empty table stays empty.
    """
    placement = placement or plan_shards(docs, shards)
    plain = [c for c in docs.columns if c != "shard"]
    own = [measured(docs)[n].alias(n) for n in ("_group", "_split")]
    return (
        _located(docs.select(F.struct(*[docs[f"`{c}`"] for c in plain]).alias("_d"), *own), placement.large, shards)
        .join(F.broadcast(placement.items), ["_item", "_piece"])
        .select("_d.*", "shard")
    )


def shard_listing(docs: DataFrame, shards: int, slices: int = 64) -> DataFrame:
    """One row per document: its shard and its place there, gapless from 0.

    A shard is numbered in ``slices`` parts with carried counts, so that no task holds a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = with_shards(docs.select("doc_id", "text"), shards).select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        "shard",
    )
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(slices))
    return numbered(stored(placed, "shards"), ["shard"], order, part, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
