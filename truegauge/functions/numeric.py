"""Rounding and exact averages.

Three rounding rules coexist in the workload and differ on ties:

* ``half_even`` for scores and rates computed by the check and transform layers,
* ``half_up`` for figures the analytics SQL rounds as ``numeric``,
* ``nearest_int`` for whole percentages shown by the user interface.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def half_up(value: Column, digits: int) -> Column:
    return F.round(value, digits)


def nearest_int(value: Column) -> Column:
    """Ties go up, as browsers round."""
    return F.floor(value + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; null when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def score_cents(score: Column) -> Column:
    """Two-decimal scores as whole hundredths: long sums are fast and do not depend
    on row order, as double sums would."""
    return F.round(score * 100).cast("long")


def exact_mean(cents: Column, count: Column, digits: int) -> Column:
    """Sum of hundredths over count, rounded half up once, as a double."""
    mean = F.try_divide(cents.cast("decimal(20,0)"), (count * 100).cast("decimal(18,0)"))
    return F.round(mean, digits).cast("double")


def plain_mean(cents: Column, count: Column) -> Column:
    return F.try_divide(cents.cast("double"), count.cast("double")) / 100
