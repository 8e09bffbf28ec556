"""Labels derived from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and labels of the published dashboards.
HEALTHY_FROM = 90
WARNING_FROM = 70
TARGET_PASS_RATE = 90.0
TREND_SWING = 5
FAILURE_CRITICAL = 30
FAILURE_WARNING = 10
GOOD_SCORE = 80
FAIR_SCORE = 50
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
SEVERITY_ORDER = ["HIGH", "MEDIUM", "LOW"]


def quality_status(score: Column) -> Column:
    return (
        F.when(score >= HEALTHY_FROM, "Healthy").when(score >= WARNING_FROM, "Warning").otherwise("Critical")
    )


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "none")
        .when(score >= GOOD_SCORE, "success")
        .when(score >= FAIR_SCORE, "warning")
        .otherwise("danger")
    )


def failure_band(rate: Column) -> Column:
    return (
        F.when(rate >= FAILURE_CRITICAL, "critical").when(rate >= FAILURE_WARNING, "warning").otherwise("healthy")
    )


def trend_direction(trend: Column) -> Column:
    return F.when(trend > TREND_SWING, "Improving").when(trend < -TREND_SWING, "Declining").otherwise("Stable")


def day_name(day_of_week: Column) -> Column:
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.when(day_of_week < 7, F.try_element_at(names, (day_of_week + 1).cast("int"))).otherwise("Unknown")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITY_ORDER))
    for position, name in reversed(list(enumerate(SEVERITY_ORDER))):
        rank = F.when(severity == name, position).otherwise(rank)
    return rank
