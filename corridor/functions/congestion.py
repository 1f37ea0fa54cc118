"""The four congestion definitions of the reference, kept apart on purpose.

* B6 ``congestion_score``: ``vc / max(vc) * 0.6 + (100 - speed) / 100 * 0.4``
* B7 ``congestion_class``: score cut right-closed at (0,.33], (.33,.66], (.66,1] -> 0/1/2
* B8 ``level_from_speed``: speed < 40 High, < 70 Medium, else Low
* B9 ``speed_band`` / ``speed_band_code``: speed cut (0,40], (40,70], (70,100]
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_of

__all__ = ["congestion_score", "congestion_class", "level_from_speed", "speed_band",
           "speed_band_code", "score_level"]

# Weights and cut points.
SCORE_VOLUME_WEIGHT = 0.6
SCORE_SPEED_WEIGHT = 0.4
SCORE_CUTS = (0.0, 0.33, 0.66, 1.0)
SPEED_CUTS = (0.0, 40.0, 70.0, 100.0)
LEVEL_SPEED_HIGH = 40
LEVEL_SPEED_MEDIUM = 70


def congestion_score(vehicle_count: str | Column, speed: str | Column, max_count: Column) -> Column:
    """B6. ``max_count`` is a scalar (a scalar subquery or literal), never a window."""
    vc, sp = col_of(vehicle_count), col_of(speed)
    return (F.try_divide(vc, max_count) * SCORE_VOLUME_WEIGHT
            + (F.lit(100.0) - sp) / 100.0 * SCORE_SPEED_WEIGHT)


def _right_closed_cut(x: Column, cuts, labels) -> Column:
    expr = None
    for (lo, hi), lab in zip(zip(cuts[:-1], cuts[1:]), labels):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr  # no otherwise: outside the cuts (and null input) -> null


def congestion_class(score: str | Column) -> Column:
    """0 = low, 1 = medium, 2 = high; null outside (0, 1]."""
    return _right_closed_cut(col_of(score), SCORE_CUTS, (0, 1, 2))


def level_from_speed(speed: str | Column) -> Column:
    """High / Medium / Low from average speed."""
    s = col_of(speed)
    return (F.when(s < LEVEL_SPEED_HIGH, "High").when(s < LEVEL_SPEED_MEDIUM, "Medium")
             .otherwise("Low"))


def speed_band(speed: str | Column) -> Column:
    """B9 (dashboard): High / Medium / Low congestion; null outside (0, 100]."""
    return _right_closed_cut(col_of(speed), SPEED_CUTS, ("High", "Medium", "Low"))


def speed_band_code(speed: str | Column) -> Column:
    """B9 (training label): 0 / 1 / 2 with null -> 1."""
    return F.coalesce(_right_closed_cut(col_of(speed), SPEED_CUTS, (0, 1, 2)), F.lit(1))


def score_level(score: str | Column) -> Column:
    """D18 score bins: low < .33 <= medium < .66 <= high (null stays null)."""
    s = col_of(score)
    return F.when(s < 0.33, "low").when(s < 0.66, "medium").when(s >= 0.66, "high")
