"""Numbering rows within a key without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "n"
) -> DataFrame:
    """``row_number`` over ``keys`` ordered by ``order``, computed in two levels.

    ``bucket`` is a non-decreasing function of the order, such as a time slice. Rows are
    numbered inside their (key, bucket) cell, and the cells, far fewer than the rows,
    carry the running count of the cells before them. A key that holds a large share
    of the table is thereby spread over as many tasks as it has buckets.
    """
    cells = df.withColumn("_bucket", bucket)
    group = [*keys, "_bucket"]
    sizes = cells.groupBy(*group).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    if not keys:
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    joined = cells.withColumn("_inside", inside).join(offsets, same)
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop(
        "_bucket", "_inside", "_b", "_before", *[f"_k{i}" for i in range(len(keys))]
    )


def order_slices(df: DataFrame, first: str, second: str, slices: int) -> Column:
    """A bucket for ``numbered``: even slices of the order by two long columns.

    Slices are cut at quantiles of ``first``. Values of ``first`` that many rows share, so that
    several cuts fall on them, are cut once more by quantiles of ``second``. Two passes over the
    two columns; only the cuts reach the driver.
    """

    def cuts_of(rows: DataFrame, column: str) -> list[int]:
        steps = [i / slices for i in range(1, slices)]
        return rows.agg(F.percentile_approx(column, steps, 10_000).alias("c")).first()["c"] or []

    def slice_of(column: Column, cuts: list[int]) -> Column:
        """The number of cuts that are not above the value, by binary search."""
        if not cuts:
            return F.lit(0)
        middle = len(cuts) // 2
        return F.when(column < F.lit(cuts[middle]), slice_of(column, cuts[:middle])).otherwise(
            slice_of(column, cuts[middle + 1 :]) + (middle + 1)
        )

    if slices < 2:
        return F.lit(0)
    cuts = cuts_of(df, first)
    shared = sorted({c for c in cuts if cuts.count(c) > 1})
    bucket = slice_of(F.col(first), sorted(set(cuts))) * (slices + 1)
    if not shared:
        return bucket
    hot = F.col(first).isin(shared)
    inner = slice_of(F.col(second), sorted(set(cuts_of(df.filter(hot), second))))
    # A cut is the least value of its slice, so the rest of the slice comes after it.
    return bucket + F.when(hot, inner).otherwise(F.lit(slices))
