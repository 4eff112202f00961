"""Activity-log sources (commit header lines, pull-request JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

PR_SCHEMA = "number BIGINT, title STRING, state STRING, author STRUCT<login: STRING>"


def parse_commit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``author|date|subject`` lines -> (author, date, subject).

    Split with at most three parts (the subject may contain ``|``), keep lines
    with exactly three parts, strip each part.
    """
    parts = F.split(F.col(column), r"[|]", 3)
    return (lines.select(parts.alias("_p"))
            .filter(F.size("_p") == 3)
            .select(strip(F.get("_p", 0)).alias("author"),
                    strip(F.get("_p", 1)).alias("date"),
                    strip(F.get("_p", 2)).alias("subject")))


def scan_activity_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_commit_lines(spark.read.text(path))


def parse_pr_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per line -> (number, title, state, login).

    Malformed lines are dropped. A PR may lack any field, its number too
    (listings that ask for authors only): the missing fields are null.
    """
    schema = PR_SCHEMA + ", _corrupt_record STRING"
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return (lines.select(parsed.alias("_pr"))
            .filter(F.col("_pr").isNotNull() & F.col("_pr._corrupt_record").isNull())
            .select(F.col("_pr.number").alias("number"), F.col("_pr.title").alias("title"),
                    F.col("_pr.state").alias("state"), F.col("_pr.author.login").alias("login")))


def scan_pr_json(spark: SparkSession, path: str, json_array: bool = False, multiline: bool = True) -> DataFrame:
    """S8 source: JSON lines (default) or JSON arrays of PRs.

    In arrays every element is one PR. By default a file holds one array,
    which may span lines; with ``multiline`` false every line is an array of
    its own, so large files can be split. A malformed document yields no rows.
    """
    if not json_array:
        return parse_pr_json(spark.read.text(path))
    df = (spark.read.schema(PR_SCHEMA).option("multiLine", bool(multiline))
          .option("mode", "DROPMALFORMED").json(path))
    return (df.select("number", "title", "state", F.col("author.login").alias("login")))


def read_numstat_log(spark: SparkSession, path: str) -> DataFrame:
    """Numstat logs as (repo, line_no, txt): one text file per repository.

    The repository is the file path and ``line_no`` follows the line order
    inside the file (ids increase with the file offset). Feed to
    ``operators.activity.fold_numstat``.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("repo"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("txt"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Roster CSV with a header: member_id, member, alias (one row per alias)."""
    return (spark.read.option("header", True).schema("member_id bigint, member string, alias string")
            .csv(path))
