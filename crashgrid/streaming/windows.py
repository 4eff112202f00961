"""Event-time window counts over a stream of files, with late rows accounted for."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in the order in which they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_trigger)).parquet(path)


def window_counts(events: DataFrame, time_col: str, window: str, slide: str | None = None, delay: str = "1 day",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Rows per event-time window and keys: window_start, window_end, keys, events.

    Works on a stream and, without a watermark's effect, on a batch table.
    State is one count per open window and key; rows are combined inside each
    task before the shuffle, so a hot key is one row per task.
    """
    source = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    source = source.withWatermark(time_col, delay) if events.isStreaming else source
    frame = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return source.groupBy(frame.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events")


def replay_windows(stream: DataFrame, time_col: str, window: str, slide: str | None = None, delay: str = "1 day",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Run ``window_counts`` over all files that are there now (available-now trigger): its last state, and ``closed``.

    Each micro-batch writes the windows it changed, with its number, as
    Parquet under the shared checkpoint folder; the latest row of a window is
    its count. A batch that is run again after a failure overwrites its own
    folder, so the result is the same. Rows whose window the watermark had
    closed one batch before theirs are not counted (``late_rows``); Spark holds
    rows against the watermark of the batch before, never an earlier one.
    ``closed`` tells the windows that the last watermark has passed.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-windows"), scratch_path(spark, "stream-state")
    counts = window_counts(stream, time_col, window, slide, delay, keys)

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(int(number)).cast("bigint")).write.mode("overwrite").parquet(f"{out}/n={number}")

    query = (counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    last = query.lastProgress
    schema = StructType([*counts.schema.fields]).add("batch", "long")
    if last is None:
        return spark.createDataFrame([], schema).drop("batch").withColumn("closed", F.lit(False))
    mark = (last.eventTime if hasattr(last, "eventTime") else last["eventTime"]).get("watermark")
    written = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    newest = Window.partitionBy("window_start", "window_end", *keys).orderBy(F.desc("batch"))
    latest = written.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "batch")
    return latest.withColumn("closed", F.col("window_end") <= F.lit(mark).cast("timestamp") if mark else F.lit(False))


def late_rows(windows: DataFrame, replayed: DataFrame) -> DataFrame:
    """One row: input_rows, counted_rows and late_rows of a replay in tumbling windows; ``replayed`` is its input."""
    counted = windows.agg(F.coalesce(F.sum("events"), F.lit(0)).cast("bigint")).scalar()
    return replayed.agg(F.count(F.lit(1)).alias("input_rows"), counted.alias("counted_rows")).withColumn(
        "late_rows", F.col("input_rows") - F.col("counted_rows"))
