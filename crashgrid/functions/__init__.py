"""Column expressions shared by the operators (all JVM-side)."""

from .coerce import round_half_even, to_int, to_number, to_timestamp_any
from .text import norm_flag, norm_key, strip

__all__ = ["round_half_even", "to_int", "to_number", "to_timestamp_any", "norm_flag", "norm_key", "strip"]
