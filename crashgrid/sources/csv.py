"""Raw incident CSV scan with the required-column contract."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CSV_NULL_TOKENS, REQUIRED_COLUMNS, require_columns


def validate_required_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    """Raise ``ValueError`` listing missing columns in declared order."""
    require_columns(df, required)


def load_dataset(spark: SparkSession, path: str, null_tokens=CSV_NULL_TOKENS,
                 multiline: bool = False) -> DataFrame:
    """Read a raw incident CSV (header row, every column as text).

    Raises ``FileNotFoundError("Dataset not found: ...")`` for a missing path
    and ``ValueError("Missing required columns: [...]")`` when the header
    lacks a required column. Names come from the header and, without type
    inference, every column is text. A folder's files must agree: a file whose
    header differs from the first one's (other names or another order) is
    refused when it is read, never bound by position. Quotes inside quoted
    values are doubled (RFC 4180); a backslash is an ordinary character. The usual missing-value tokens become nulls in one
    projection. ``multiline`` accepts quoted values spanning lines; it is off
    by default because a multi-line file cannot be split across tasks.
    """
    try:
        df = (spark.read
              .option("header", True)
              .option("inferSchema", False)
              .option("enforceSchema", False)
              .option("escape", '"')
              .option("mode", "PERMISSIVE")
              .option("multiLine", bool(multiline))
              .option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False)
              .csv(path))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"Dataset not found: {path}") from exc
        raise
    validate_required_columns(df)
    tokens = list(null_tokens)
    return df.select(*[
        F.when(F.col(n).isin(tokens), F.lit(None).cast("string")).otherwise(F.col(n).cast("string")).alias(n)
        for n in df.columns
    ])

