"""Helpers that several operators share: written intermediates, slices, running totals."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.session import checkpoint_root

#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
LONG_MIN = -(1 << 63)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/tracewarden/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back.

    Cuts the lineage: a lost executor costs a second read, and every branch above
    sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """``run``, as mapInArrow calls it, which gives its memory back once a partition is done.

    Workers live on between tasks, beside the executor's heap; what they keep of one task is lost
    to all stages that follow.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def boundaries(ids: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut values of a long column, for range slices."""
    if parts <= 1:
        return []
    steps = [i / parts for i in range(1, parts)]
    row = ids.agg(F.percentile_approx(column, steps, 10_000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def slice_of(column: Column, cuts: list[int]) -> Column:
    """The number of cuts that are not above ``column``: 0 to len(cuts)."""
    if not cuts:
        return F.lit(0)
    # Binary search as a nest of comparisons, log2(cuts) deep at run time.
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(cuts[middle]), search(low, middle)).otherwise(
            search(middle + 1, high)
        )

    return search(0, len(cuts))


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], slices: Column, value: str, out: str
) -> DataFrame:
    """The sum of ``value`` over the rows before, within ``keys``, in two levels.

    ``slices`` cuts a key into pieces of any even size; the order is that of the slices, then
    ``order``. A key that holds a third of all rows is spread over all its slices.
    ``df`` is read twice: pass a stored one.
    """
    cells = df.withColumn("_slice", slices)
    group = [*keys, "_slice"]
    sizes = cells.groupBy(*group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, group)
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_slice", "_inside", "_before")
    )
