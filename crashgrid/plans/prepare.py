"""The preparation job (raw CSV -> cleaned, derived, Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import clean
from ..operators.derive import derive
from ..session import shuffle_partitions_for
from ..sources.csv import load_dataset
from ..sources.parquet import write_prepared

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def prepare_frame(raw: DataFrame) -> DataFrame:
    """Cleaned and derived rows as one lazy plan (one shuffle: the dedupe)."""
    return derive(clean(raw))


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files that ``path`` (a file, folder or glob) names, from file-system metadata."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(int(fs.getContentSummary(found.getPath()).getLength()) for found in fs.globStatus(hpath) or ())


def child_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session on the same context with the parent's settings and some of its own."""
    child = spark.newSession()
    for row in spark.sql("SET").collect():
        if row["key"].startswith("spark.sql.") and spark.conf.isModifiable(row["key"]):
            child.conf.set(row["key"], row["value"])
    for key, value in settings.items():
        child.conf.set(key, value)
    return child


def prepare_dataset(spark: SparkSession, raw_path: str, output_path: str,
                    shuffle_partitions: int | None = None) -> str:
    """Read the raw CSV, clean, derive, write the prepared Parquet; returns its path.

    ``raw_path`` may be a file, a folder or a glob; a missing one raises
    ``FileNotFoundError``. The dedupe shuffle moves the whole input, so its
    partition count is sized from the input's bytes
    (``shuffle_partitions_for``: ~256 MiB each, never below the session's
    setting) unless given; AQE coalesces partitions that turn out small. The
    count is set in a child session, so jobs beside this one do not see it.
    """
    load_dataset(spark, raw_path)  # the path and header checks come before anything is sized
    wanted = int(shuffle_partitions) if shuffle_partitions else shuffle_partitions_for(
        input_bytes(spark, raw_path), minimum=int(spark.conf.get(SHUFFLE_PARTITIONS)))
    own = child_session(spark, **{SHUFFLE_PARTITIONS: str(wanted)})
    return write_prepared(prepare_frame(load_dataset(own, raw_path)), output_path)
