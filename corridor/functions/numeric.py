"""Numeric helpers whose results must agree across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["round_half_up", "clamp", "col_of", "leading_number", "reversed_scale"]


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: str | Column, digits: int) -> Column:
    """``floor(x*10^d + 0.5) / 10^d``: the rounding used when a rounded value
    feeds a later comparison (identical IEEE steps in every engine)."""
    scale = float(10 ** digits)
    return F.floor(col_of(c) * scale + 0.5) / scale


def clamp(c: str | Column, lo, hi) -> Column:
    return F.least(F.greatest(col_of(c), F.lit(lo)), F.lit(hi))


def leading_number(text: str | Column, sep: str = "/") -> Column:
    """The integer before ``sep`` in texts like ``"3/5"`` (null if absent)."""
    return F.split(col_of(text), sep, 2).getItem(0).try_cast("int")


def reversed_scale(value: str | Column, top: int = 6) -> Column:
    """``top - x`` after a text-to-number cast (rank 1 best -> score 5)."""
    return F.lit(top) - col_of(value).try_cast("double")
