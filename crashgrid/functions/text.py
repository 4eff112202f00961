"""String helpers (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace removed by a full strip: ASCII and Unicode (Spark's ``trim`` removes spaces only).
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
              + "\u2028\u2029\u202f\u205f\u3000")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading/trailing whitespace, ASCII and Unicode."""
    return F.btrim(col(c).cast("string"), F.lit(WHITESPACE))


def norm_key(c) -> Column:
    """Lookup key form of a name: stripped and lower-cased."""
    return F.lower(strip(c))


def norm_flag(c) -> Column:
    """YES/NO/N-R flag form: missing becomes empty, stripped, upper-cased."""
    return F.upper(strip(F.coalesce(col(c).cast("string"), F.lit(""))))
