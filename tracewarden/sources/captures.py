"""Capture files: scan, live source, keys, and atomic sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewarden.operators.headers import scrub_headers
from tracewarden.operators.ranking import numbered, order_slices
from tracewarden.schemas import CAPTURE, CAPTURE_COLUMNS, TIMINGS


def _flat(raw: DataFrame) -> DataFrame:
    """Engine-side column names, the file name as order key and its session tag."""
    renamed = [F.col(name).alias(as_) for name, as_ in CAPTURE_COLUMNS.items()]
    return raw.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        *renamed,
        F.when(
            F.col("requestBody").isNotNull() & ~F.is_variant_null("requestBody"),
            F.to_json("requestBody"),
        ).alias("request_body"),
        *[F.col(f"timings.{t}").alias(t) for t in TIMINGS],
    ).withColumn("file_session", file_session(F.col("file")))


def scan_captures(spark: SparkSession, directory: str, lines: bool = False) -> DataFrame:
    """All readable capture files of a directory; unreadable ones are skipped.

    A file holds one capture, or with ``lines`` one per line, as ``write_capture_json`` writes them.
    """
    raw = (
        spark.read.schema(CAPTURE)
        .option("pathGlobFilter", "*.json")
        .option("multiLine", not lines)
        .option("mode", "DROPMALFORMED")
        .json(directory)
    )
    return _flat(raw)


def stream_captures(
    spark: SparkSession, directory: str, files_per_trigger: int = 1000, lines: bool = False
) -> DataFrame:
    """New capture files as they appear; the file source remembers what it has read."""
    raw = (
        spark.readStream.schema(CAPTURE)
        .option("pathGlobFilter", "*.json")
        .option("multiLine", not lines)
        .option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(directory)
    )
    return _flat(raw)


def file_session(name: Column) -> Column:
    """The session tag in a file name: the second ``_`` part, if it is 8 hex digits.

    A source with an underscore in it shifts the parts, and the tag is not found.
    """
    parts = F.split(F.regexp_replace(name, r"\.json$", ""), "_")
    second = F.get(parts, F.lit(1))
    return F.when((F.size(parts) >= 3) & second.rlike(r"^[a-f0-9]{8}\z"), second)


def with_file_keys(
    captures: DataFrame, written_ms: str = "written_ms", order: str = "capture_id", slices: int | None = None
) -> DataFrame:
    """Adds the file name of every capture: source, session, write time and a running number.

    The running number counts all captures in write order. It is computed per slice of that
    order with carried offsets. Slices are even whatever the times are, so no task ever sorts
    the whole table, not even if all captures were written at once.
    """
    parts = slices or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = numbered(
        captures,
        keys=[],
        order=[F.col(written_ms), F.col(order)],
        bucket=order_slices(captures, written_ms, order, parts),
        out="_n",
    )
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    session = F.coalesce(
        F.concat(F.lit("_"), F.nullif(F.col("session_id"), F.lit(""))), F.lit("")
    )
    serial = (F.col("_n") - 1).cast("string")
    return counted.withColumn(
        "file",
        F.concat(
            F.regexp_replace(source, "[^a-zA-Z0-9_-]", "_"),
            session,
            F.lit("_"),
            F.col(written_ms).cast("string"),
            F.lit("-"),
            F.when(F.length(serial) >= 6, serial).otherwise(F.lpad(serial, 6, "0")),
            F.lit(".json"),
        ),
    ).drop("_n")


def to_records(captures: DataFrame) -> DataFrame:
    """Back to the persisted record, with sensitive headers gone."""
    scrubbed = captures.withColumns(
        {c: scrub_headers(F.col(c)) for c in ("request_headers", "response_headers")}
    )
    columns = [F.col(as_).alias(name) for name, as_ in CAPTURE_COLUMNS.items()]
    return scrubbed.select(
        *columns,
        F.try_parse_json("request_body").alias("requestBody"),
        F.struct(*[F.col(t) for t in TIMINGS]).alias("timings"),
    )


def write_captures(captures: DataFrame, directory: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append captures as a Parquet table; the commit protocol makes the write atomic."""
    writer = captures.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(directory)


def write_capture_json(captures: DataFrame, directory: str) -> None:
    """Append captures as JSON lines in the persisted record form."""
    to_records(captures).write.mode("append").option("ignoreNullFields", False).json(directory)


def start_capture_sink(captures: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    """Continuous form of ``write_captures`` over whatever has arrived."""
    return (
        captures.writeStream.format("parquet")
        .option("path", directory)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
