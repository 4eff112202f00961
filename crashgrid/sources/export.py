"""CSV export of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_results(df: DataFrame, output_path: str, single_file: bool = False) -> str:
    """Write ``df`` as CSV with a header row; returns ``output_path``.

    Values are written verbatim (no trimming) and quotes are escaped by
    doubling. ``single_file`` coalesces to one task and is meant for small,
    already-aggregated results only; large exports stay parallel.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(output_path))
    return output_path


def export_summary(summary: DataFrame, output_path: str, single_file: bool = False) -> str:
    """Contribution summary to CSV (one row per roster member).

    Written by as many tasks as hold the roster; ``single_file`` asks for one
    file and one task, for rosters known to be small.
    """
    return export_results(summary, output_path, single_file=single_file)
