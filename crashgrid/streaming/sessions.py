"""Gap sessions per key, over a table or a stream."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def sessions(events: DataFrame, time_col: str, keys: Sequence[str], gap: str) -> DataFrame:
    """(keys, session_start, session_end, events): runs of a key's rows with at most ``gap`` between neighbours.

    ``session_end`` is the last row's time plus the gap. Rows without a time
    belong to none. Each task merges its own rows to sessions before the
    shuffle, so a hot key is moved as sessions, and its merge walks them in
    order without holding them.
    """
    return events.filter(F.col(time_col).isNotNull()).groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events")).select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def replay_sessions(stream: DataFrame, time_col: str, keys: Sequence[str], gap: str, delay: str) -> DataFrame:
    """``sessions`` of a stream, run over all files that are there now: the sessions that the watermark has closed.

    The state holds a key's open sessions and drops them when the watermark
    (latest time less ``delay``) passes their end, which is when they are
    written, once, by the file sink's commit log.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream-sessions"), scratch_path(spark, "stream-state")
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    found = sessions(timed, time_col, keys, gap)
    query = (found.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(StructType(found.schema.fields)).parquet(out)
