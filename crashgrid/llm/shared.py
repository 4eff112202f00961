"""Tables written to the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import re
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize  # noqa: F401  (used by the operators from here)


BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def byte_size(setting: str) -> int:
    """Bytes of a Spark size setting such as ``64m``, ``1g``, ``67108864b`` or ``-1``; a bare number is bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to Python workers at a few MB, whatever the texts' lengths.

    Spark's default is 10,000 rows or 64 MB; buffers of that size, doubled as
    they grow, in the JVM and in every worker are most of what a text stage
    holds. Smaller settings of the session stay.
    """
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = byte_size(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through its Hadoop file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def broadcast_plain(spark: SparkSession, value: Any):
    """Broadcast built-in types (workers need no class of this package to read them)."""
    return spark.sparkContext.broadcast({"value": value})


def per_worker(shared, build: Callable[[Any], Any]) -> Any:
    """``build(value)`` of a ``broadcast_plain``, kept in the Python worker for its later tasks."""
    held = shared.value
    if "built" not in held:
        held["built"] = build(held["value"])
    return held["built"]
