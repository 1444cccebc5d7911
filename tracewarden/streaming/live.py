"""Live reports over a capture stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators.sessions import matching, request_ledger


def live_ledger(
    captures: DataFrame, keys: list[str], session: str | None = None, source: str | None = None
) -> DataFrame:
    """Display rows of arriving captures; stateless, so it appends."""
    return request_ledger(matching(captures, session, source), keys)


def live_totals(ledger: DataFrame) -> DataFrame:
    """Running requests, tokens and cost per session; for complete or update mode.

    Streams have no exact distinct count: the number of sessions is the number of rows,
    and the global line is one more sum over this small table.
    """
    shown = F.when(F.col("cost") != "$?", F.substring("cost", 2, 64).cast("decimal(18,3)"))
    return ledger.groupBy(F.coalesce("session_id", F.lit("")).alias("session_id")).agg(
        F.count("*").alias("requests"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost_usd"),
        F.sum(shown).cast("double").alias("cost_shown"),
    )


def totals_line(per_session: DataFrame) -> DataFrame:
    """The one-line summary from the running per-session table."""
    return per_session.agg(
        F.count_if(F.col("session_id") != "").alias("sessions"),
        F.sum("requests").alias("requests"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("cost_shown").alias("cost_shown"),
    )


def live_windows(ledger: DataFrame, at: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Requests, tokens and cost per source and event-time window; a window comes once, when it is over.

    For append mode. State holds the windows that the watermark has not passed; rows that are
    later than ``lateness`` are dropped.
    """
    return (
        ledger.withWatermark(at, lateness)
        .groupBy(F.window(at, window).alias("_w"), "source")
        .agg(
            F.count("*").alias("requests"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost_usd"),
        )
        .select(F.col("_w.start").alias("window_start"), "source", "requests", "tokens_in", "tokens_out", "cost_usd")
    )


class ChangeTable:
    """A keyed table below a shared folder that a stream in update mode keeps current.

    Every batch writes the keys that changed in it, and nothing else, to a folder of its own; a
    batch that runs again replaces its folder. ``compact`` folds all folders so far into one, so
    that what a reader has to look through stays near the size of the table.
    """

    def __init__(self, folder: str, keys: list[str], schema: T.StructType):
        self.folder, self.keys = folder, keys
        self.schema = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch`` in update mode."""
        path = f"{self.folder}/changes/{batch_id}"
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(path)

    def _files(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _written(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the finished folders of one kind, ascending."""
        path, files = self._files(spark)
        root = path(f"{self.folder}/{kind}")
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return sorted(int(n) for n in names if files.exists(path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _read(self, spark: SparkSession) -> DataFrame:
        """The last state of every key with the batch that it comes from: the newest fold, and what came after."""
        folds = self._written(spark, "folded")[-1:]
        later = [n for n in self._written(spark, "changes") if not folds or n > folds[0]]
        folders = [f"{self.folder}/folded/{n}" for n in folds] + [f"{self.folder}/changes/{n}" for n in later]
        rows = spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)
        plain = [c for c in self.schema.names if c not in self.keys]
        return (
            rows.groupBy(*self.keys)
            .agg(F.max_by(F.struct(*plain), "_batch").alias("_now"))
            .select(*self.keys, "_now.*")
        )

    def current(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).drop("_batch")

    def compact(self, spark: SparkSession) -> None:
        """All finished batches so far as one folder; call it between batches.

        The fold counts from the moment when it is complete; what it replaces goes afterwards.
        """
        changes, folds = self._written(spark, "changes"), self._written(spark, "folded")
        if not changes or (folds and changes[-1] <= folds[-1]):
            return
        self._read(spark).write.mode("overwrite").parquet(f"{self.folder}/folded/{changes[-1]}")
        path, files = self._files(spark)
        for kind, old in (("changes", changes), ("folded", folds)):
            for n in old:
                files.delete(path(f"{self.folder}/{kind}/{n}"), True)


def run_changes(df: DataFrame, table: ChangeTable) -> None:
    """Process all available input of a running aggregate, and keep its table current."""
    query = (
        df.writeStream.foreachBatch(table.upsert)
        .outputMode("update")
        .option("checkpointLocation", f"{table.folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(df: DataFrame, folder: str) -> DataFrame:
    """Process all available input in complete mode and return the last state of the result.

    Every batch writes its state below ``folder``, a folder that all executors share; no row of
    it passes the driver.
    """
    written: list[str] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/state/{batch_id}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    query = (
        df.writeStream.foreachBatch(keep)
        .outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(written[-1]) if written else spark.createDataFrame([], df.schema)
