"""Parquet tables: texts, and captures laid out by day and session."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.sessions import newest_sessions
from tracewarden.session import checkpoint_root

#: Session setting: tables are dealt to so many partitions when they are read. Unset, files decide.
#: For small tables in one file, whose rules cost far more time than their reading.
READ_PARTITIONS = "spark.tracewarden.readPartitions"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    parts = spark.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


# --- captures -----------------------------------------------------------------


def bucket_key(session: Column, key: Column) -> Column:
    """What captures are bucketed by: their session, or their own key where there is none.

    Captures without a session would all lie in one bucket.
    """
    return F.coalesce(F.nullif(session, F.lit("")), F.concat(F.lit("-"), key.cast("string")))


class CaptureTable:
    """Captures in a catalog table, partitioned by ``day`` and bucketed by ``bucket_key``.

    Reports on a span of time read only its days, look-ups of a session only its bucket, and
    tables that are bucketed alike join without a shuffle.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, key: str = "file", buckets: int = 64):
        self.spark, self.name, self.folder, self.key, self.buckets = spark, name, folder, key, buckets

    def append(self, captures: DataFrame) -> None:
        """Adds captures; a day and bucket get one file per task that has rows of them."""
        rows = captures.withColumns(
            {
                "bucket_key": bucket_key(F.col("session_id"), F.col(self.key)),
                "day": F.to_date(F.to_timestamp("ts")),
            }
        )
        (
            rows.write.mode("append")
            .format("parquet")
            .partitionBy("day")
            .bucketBy(self.buckets, "bucket_key")
            .sortBy("bucket_key")
            .option("path", self.folder)
            .saveAsTable(self.name)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def since(self, moment: str) -> DataFrame:
        """Captures from a moment on; earlier days are not read."""
        start = F.to_timestamp(F.lit(moment))
        return self.rows().filter((F.col("day") >= F.to_date(start)) & (F.to_timestamp("ts") >= start))

    def of_session(self, session: str) -> DataFrame:
        """Captures of one session; other buckets are not read."""
        return self.rows().filter(F.col("bucket_key") == session)

    def retain(self, max_sessions: int) -> list[str | None]:
        """Drops all but the newest sessions, and returns the days that were written anew.

        Only days that hold a dropped capture are rewritten, all in one write; each one is swapped
        in as a whole when the new files are complete, and the files of all other days stay as
        they are. What comes to the driver is a row per such day. The day of captures without a
        time is null.
        """
        if max_sessions <= 0:
            return []
        kept = newest_sessions(self.rows(), max_sessions).select(F.col("file_session").alias("_kept")).persist()
        try:
            return self._retain(kept)
        finally:
            kept.unpersist()

    def _retain(self, kept: DataFrame) -> list[str | None]:
        judged = self.rows().join(kept, F.col("file_session") == F.col("_kept"), "left").withColumn(
            "_stays", F.col("file_session").isNull() | F.col("_kept").isNotNull()
        )
        days = (
            judged.groupBy("day")
            .agg(F.bool_and("_stays").alias("whole"), F.bool_or("_stays").alias("some"))
            .filter("NOT whole")
            .orderBy("day")
            .collect()
        )
        if not days:
            return []
        partial = [r["day"] for r in days if r["some"]]
        if partial:
            self._rewrite(judged.filter("_stays").filter(_on_days(partial)))
        self._drop([r["day"] for r in days if not r["some"]])
        self.spark.catalog.refreshTable(self.name)
        return [_iso(r["day"]) for r in days]

    def _rewrite(self, stays: DataFrame) -> None:
        """Swaps in the days of these rows."""
        # The table cannot be read while it is written: what stays is written aside first.
        aside = f"{checkpoint_root(self.spark).rstrip('/')}/retained-{uuid.uuid4().hex}"
        layout = self.rows().schema
        stays.select(*layout.names).write.parquet(aside)
        # A session of its own: no setting of another one can widen what is overwritten.
        own = self.spark.newSession()
        own.catalog.setCurrentDatabase(self.spark.catalog.currentDatabase())
        own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        own.read.schema(layout).parquet(aside).write.mode("overwrite").insertInto(self.name)

    def _drop(self, days: list) -> None:
        """Drops whole days; the table is external, so their files do not go by themselves."""
        for i in range(0, len(days), _DROPPED_AT_ONCE):
            named = [f"PARTITION (day = {f"DATE'{_iso(d)}'" if d else 'null'})" for d in days[i : i + _DROPPED_AT_ONCE]]
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {', '.join(named)}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for d in days:
            files.delete(path(f"{self.folder}/day={_iso(d) or '__HIVE_DEFAULT_PARTITION__'}"), True)


_DROPPED_AT_ONCE = 500


def _iso(day: date | None) -> str | None:
    return day.isoformat() if day else None


def _on_days(days: list) -> Column:
    named = F.col("day").isin([d for d in days if d])
    return named | F.col("day").isNull() if None in days else named
