"""Streaming form of the calendar trend (A7/F3) over an event stream.

The batch operators need the whole span to choose a period; a stream fixes
the period up front and closes windows with a watermark.  Works on any
streaming source with an event-time column.  Results go to Parquet in the
shared checkpoint folder, never to the driver's memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablight.session import checkpoint_dir


def windowed_means(stream: DataFrame, ts: str, metric: str, period: str = "1 day",
                   by: list[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """Mean, count and sum of ``metric`` per event-time window (and keys),
    with a watermark so state for closed windows is dropped."""
    by = by or []
    if dict(stream.dtypes)[ts] == "timestamp_ntz":
        # event time must be a zoned timestamp; wall-clock kept via the session zone
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (stream.withWatermark(ts, delay)
            .groupBy(F.window(F.col(ts), period).alias("w"), *[F.col(b) for b in by])
            .agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n"), F.sum(metric).alias("total"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("period_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("period_end"), *by,
                    "mean", "n", "total"))


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (a folder, or one file by its name) as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    # a file stream watches a folder; a single-file table is picked by name
    return (reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path))


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether all files of the table are the path itself."""
    files = spark.read.parquet(path).inputFiles()
    return len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rstrip("/").rsplit("/", 1)[-1]


def _late(query) -> int:
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def closed_windows(windows: DataFrame, checkpoint: str | None = None) -> tuple[DataFrame, int]:
    """Drive ``windowed_means`` over what its source holds now, in append mode:
    each window is written once, when the watermark has passed its end, and its
    state is dropped.  Returns the written table and the number of rows that
    came too late for any window.  The run goes on from ``checkpoint`` if given
    (its folder also holds the table)."""
    spark = windows.sparkSession
    home = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (windows.writeStream.outputMode("append").format("parquet").option("path", f"{home}/table")
         .option("checkpointLocation", f"{home}/progress").start())
    q.processAllAvailable()
    q.stop()
    return spark.read.schema(windows.schema).parquet(f"{home}/table"), _late(q)


def current_windows(windows: DataFrame, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """All windows as they stand, closed or not, in update mode: each batch
    appends the windows it has changed to a Parquet table, and the newest
    version of each is read back."""
    spark = windows.sparkSession
    home = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(changed: DataFrame, batch: int) -> None:
        # a batch that is run again after a failure writes the same folder again
        changed.write.mode("overwrite").parquet(f"{home}/table/batch={batch}")

    write(spark.createDataFrame([], windows.schema), -1)  # a table even if nothing arrives
    q = (windows.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{home}/progress").start())
    q.processAllAvailable()
    q.stop()
    written = spark.read.schema(windows.schema.add("batch", "long")).parquet(f"{home}/table")
    w = Window.partitionBy("period_start", "period_end", *(keys or [])).orderBy(F.col("batch").desc())
    return written.withColumn("_newest", F.row_number().over(w) == 1).where("_newest").drop("_newest", "batch")


def run_to_table(spark, sf_dir: str, table: str, ts: str, metric: str, period: str = "1 day",
                 by: list[str] | None = None) -> DataFrame:
    """The windows of a Parquet table read as a stream in one batch, so that no
    row is late: every window, closed or not."""
    src = file_stream(spark, f"{sf_dir}/{table}.parquet")
    return current_windows(windowed_means(src, ts, metric, period, by), by)
