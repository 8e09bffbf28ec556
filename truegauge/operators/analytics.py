"""Dashboard analytics over the star schema.

Most figures depend on the fact through one or two foreign keys only. Facts are
therefore added up per key ("cells") before any dimension is joined: the scan
combines rows inside each task, a dataset or rule that holds a third of all facts
shrinks to one cell, and the joins run over cells. Dimensions carry no broadcast
hint; the planner decides by their measured size.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.bands import (
    SEVERITY_ORDER,
    TARGET_PASS_RATE,
    day_name,
    failure_band,
    quality_status,
    severity_rank,
    trend_direction,
)
from truegauge.functions.numeric import exact_mean, half_even, half_up, percent, plain_mean, score_cents
from truegauge.functions.timing import key_of
from truegauge.operators.star import Star

TOP_FIELDS = 10
MEDIUM_ALARM = 10
SPREAD_ALARM = 15
DAY_SPREAD_ALARM = 5


@dataclass(frozen=True)
class Selection:
    """Validated dashboard filter. ``datasets`` is a table of ids (column ``id``) or a
    list; None means every dataset."""

    datasets: DataFrame | Sequence[int] | None
    start: date
    end: date
    severities: tuple[str, ...]

    @staticmethod
    def of(
        datasets: DataFrame | Iterable[object] | None, start: date, end: date, severities: Iterable[str]
    ) -> "Selection":
        """Drops ids that are not integers and unknown severities; refuses empty filters."""
        if datasets is not None and not isinstance(datasets, DataFrame):
            ids = [n for n in map(_integer, datasets) if n is not None]
            if not ids:
                raise ValueError("No dataset selected")
            datasets = ids
        known = tuple(s for s in severities if s in SEVERITY_ORDER)
        if not known:
            raise ValueError("No severity selected")
        if start > end:
            raise ValueError("Start date lies after end date")
        return Selection(datasets, start, end, known)


def _integer(value: object) -> int | None:
    try:
        return int(str(value).strip())
    except ValueError:
        return None


def selected_facts(star: Star, sel: Selection) -> DataFrame:
    """Facts of the chosen days and datasets. The day filter is on the partition column."""
    facts = star.facts.where(F.col("date_key").between(key_of(sel.start), key_of(sel.end)))
    if isinstance(sel.datasets, DataFrame):
        return facts.join(sel.datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    if sel.datasets is not None:
        facts = facts.where(F.col("dataset_id").isin(list(sel.datasets)))
    return facts


def selected_rules(star: Star, sel: Selection) -> DataFrame:
    return star.dim_rules.where(F.col("severity").isin(list(sel.severities))).select(
        F.col("id").alias("rule_id"), "rule_type", "severity", "field_name"
    )


def selected_dates(star: Star, sel: Selection) -> DataFrame:
    return star.dim_date.where(F.col("full_date").between(F.lit(sel.start), F.lit(sel.end))).select(
        "date_key", "full_date", "day_of_week"
    )


def star_filter(star: Star, sel: Selection) -> DataFrame:
    """Single facts with their date and rule attributes, filtered."""
    return (
        selected_facts(star, sel)
        .join(selected_dates(star, sel), "date_key")
        .join(selected_rules(star, sel), "rule_id")
    )


def cells(star: Star, sel: Selection, by: Sequence[str], where: Column | None = None) -> DataFrame:
    """Filtered facts added up per (``by`` keys, rule, day), with rule and date attributes."""
    points = score_cents(F.col("score"))
    facts = selected_facts(star, sel)
    if where is not None:
        facts = facts.where(where)
    keys = list(dict.fromkeys([*by, "rule_id", "date_key"]))
    summed = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("ok"),
        F.sum(points).alias("points"),
        F.sum(points * points).alias("squares"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    )
    return summed.join(selected_dates(star, sel), "date_key").join(selected_rules(star, sel), "rule_id")


def _n() -> Column:
    return F.sum("n")


def _ok() -> Column:
    return F.coalesce(F.sum("ok"), F.lit(0))


def _failed() -> Column:
    return F.coalesce(F.sum(F.col("n") - F.col("ok")), F.lit(0))


def _mean(digits: int) -> Column:
    return exact_mean(F.sum("points"), _n(), digits)


def _plain_mean() -> Column:
    return plain_mean(F.sum("points"), _n())


def _failure_rate() -> Column:
    share = F.try_divide((_failed() * 100).cast("decimal(20,0)"), _n().cast("decimal(18,0)"))
    return half_up(share, 1).cast("double")


def _sample_std(digits: int) -> Column:
    """Sample deviation from exact sums; null for a single row."""
    n = _n().cast("decimal(13,0)")
    total = F.sum("points").cast("decimal(18,0)")
    spread = n * F.sum(F.col("squares").cast("decimal(20,0)")).cast("decimal(24,0)") - total * total
    freedom = (n * (n - 1)).cast("double")
    return half_up(F.sqrt(F.try_divide(spread.cast("double"), freedom)) / 100, digits)


# --- base queries ----------------------------------------------------------


def datasets(star: Star) -> DataFrame:
    return star.dim_datasets.select("id", "name").distinct().orderBy("name", "id")


def date_range(star: Star) -> DataFrame:
    return star.dim_date.agg(F.min("full_date").alias("min_d"), F.max("full_date").alias("max_d"))


def kpi_overview(star: Star, sel: Selection) -> DataFrame:
    return cells(star, sel, []).agg(
        F.coalesce(_n(), F.lit(0)).alias("total_checks"),
        F.sum("ok").alias("passed_checks"),
        _plain_mean().alias("avg_score"),
        F.min("low").alias("min_score"),
        F.max("high").alias("max_score"),
    )


def daily_average(star: Star, sel: Selection) -> DataFrame:
    return cells(star, sel, []).groupBy("full_date").agg(_mean(1).alias("avg_score")).orderBy("full_date")


def quality_trends(star: Star, sel: Selection) -> DataFrame:
    """Mean and count per day and dataset name; equal names are one line.

    Day, dataset and rule together are the grain of the fact, so nothing would
    shrink beforehand: facts meet the dimensions first and are added up once.
    """
    names = star.dim_datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return (
        star_filter(star, sel)
        .join(names, "dataset_id")
        .groupBy("full_date", "dataset_name")
        .agg(
            plain_mean(F.sum(score_cents(F.col("score"))), F.count("score")).alias("avg_score"),
            F.count(F.lit(1)).alias("check_count"),
        )
        .orderBy("full_date", "dataset_name")
    )


def failure_by_rule_type(star: Star, sel: Selection) -> DataFrame:
    return (
        cells(star, sel, [])
        .groupBy("rule_type")
        .agg(_n().alias("total"), _failed().alias("failed"), _failure_rate().alias("failure_rate"))
        .orderBy(F.desc("failure_rate"), "rule_type")
    )


def failure_by_severity(star: Star, sel: Selection) -> DataFrame:
    return cells(star, sel, []).groupBy("severity").agg(_n().alias("total"), _failed().alias("failed"))


def dataset_comparison(star: Star, sel: Selection) -> DataFrame:
    """Per dataset name: mean, counts and sample deviation, worst first."""
    names = star.dim_datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"))
    return (
        cells(star, sel, ["dataset_id"])
        .join(names, "dataset_id")
        .groupBy("dataset")
        .agg(
            _mean(1).alias("avg_score"),
            _n().alias("total_checks"),
            _ok().alias("passed"),
            _failed().alias("failed"),
            _sample_std(2).alias("score_std"),
        )
        .orderBy("avg_score", "dataset")
    )


def field_issues(star: Star, sel: Selection, top: int = TOP_FIELDS) -> DataFrame:
    """The fields with the most failures. Only failed checks are read, so their rate is 100."""
    return (
        cells(star, sel, [], where=~F.col("passed"))
        .groupBy("field_name", "rule_type", "severity")
        .agg(_n().alias("total_checks"), _failed().alias("failures"), _failure_rate().alias("failure_rate"))
        .orderBy(F.desc("failures"), "field_name", "rule_type", "severity")
        .limit(top)
    )


def quality_by_weekday(star: Star, sel: Selection) -> DataFrame:
    return (
        cells(star, sel, [])
        .groupBy("day_of_week")
        .agg(_mean(1).alias("avg_score"), _n().alias("check_count"))
        .orderBy("day_of_week")
    )


# --- derived views ---------------------------------------------------------


def kpi_derived(star: Star, sel: Selection) -> DataFrame:
    kpi = kpi_overview(star, sel)
    rate = F.coalesce(percent(F.col("passed_checks"), F.col("total_checks")), F.lit(0.0))
    failed = F.col("total_checks") - F.coalesce("passed_checks", F.lit(0))
    return kpi.select(
        "*",
        failed.alias("failed_checks"),
        rate.alias("pass_rate"),
        (rate - TARGET_PASS_RATE).alias("delta_to_target"),
        F.coalesce(percent(failed, F.col("total_checks")), F.lit(0.0)).alias("failed_share"),
        quality_status(F.col("avg_score")).alias("status"),
    )


def kpi_long(star: Star, sel: Selection) -> DataFrame:
    """The figures as (metric, value) rows."""
    wide = kpi_derived(star, sel).select(
        F.col("total_checks").cast("double").alias("Total Checks"),
        F.col("passed_checks").cast("double").alias("Passed"),
        F.col("failed_checks").cast("double").alias("Failed"),
        half_even(F.col("pass_rate"), 1).alias("Pass Rate %"),
        half_even(F.col("avg_score"), 1).alias("Avg Score"),
        half_even(F.col("min_score"), 1).alias("Min Score"),
        half_even(F.col("max_score"), 1).alias("Max Score"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def trend_change(star: Star, sel: Selection) -> DataFrame:
    """Per dataset name: change from the first to the last day in percent, and the last value."""
    change = (F.col("last_avg") - F.col("first_avg")) / F.nullif(F.col("first_avg"), F.lit(0.0)) * 100
    return (
        quality_trends(star, sel)
        .groupBy("dataset_name")
        .agg(
            F.min_by("avg_score", "full_date").alias("first_avg"),
            F.max_by("avg_score", "full_date").alias("last_avg"),
            F.count(F.lit(1)).alias("days"),
        )
        .select(
            "dataset_name",
            F.when(F.col("days") < 2, 0.0).otherwise(F.coalesce(change, F.lit(0.0))).alias("trend"),
            F.col("last_avg").alias("latest"),
        )
    )


def trend_labels(star: Star, sel: Selection) -> DataFrame:
    return (
        trend_change(star, sel)
        .select(
            "*",
            trend_direction(F.col("trend")).alias("direction"),
            (F.col("latest") < 70).alias("below_critical"),
        )
        .orderBy("trend", "dataset_name")
    )


def failure_bands(star: Star, sel: Selection) -> DataFrame:
    return failure_by_rule_type(star, sel).withColumn("band", failure_band(F.col("failure_rate")))


def worst_rule_type(star: Star, sel: Selection) -> DataFrame:
    """The rule type that fails most, with the level of alarm it deserves."""
    rate = F.col("failure_rate")
    return (
        failure_by_rule_type(star, sel)
        .limit(1)
        .select(
            F.col("rule_type").alias("worst_rule"),
            rate.alias("max_rate"),
            F.when(rate > 30, "High failure rate").when(rate > 10, "Elevated rate").otherwise("All rules healthy").alias("insight"),
        )
    )


def severity_view(star: Star, sel: Selection) -> DataFrame:
    """Passed and failed per severity in fixed order, with alarm flags."""
    severity, failed = F.col("severity"), F.col("failed")
    return (
        failure_by_severity(star, sel)
        .select(
            severity,
            "total",
            failed,
            (F.col("total") - failed).alias("passed"),
            (((severity == "HIGH") & (failed > 0)) | ((severity == "MEDIUM") & (failed > MEDIUM_ALARM))).alias("alarm"),
        )
        .orderBy(severity_rank(severity))
    )


def comparison_view(star: Star, sel: Selection) -> DataFrame:
    return dataset_comparison(star, sel).select(
        "*",
        half_even(percent(F.col("passed"), F.col("total_checks")), 1).alias("pass_rate"),
        quality_status(F.col("avg_score")).alias("quality_status"),
        F.coalesce(F.col("score_std") > SPREAD_ALARM, F.lit(False)).alias("high_spread"),
    )


def comparison_extremes(star: Star, sel: Selection) -> DataFrame:
    """Best and worst dataset; names break ties the way the sorted list does."""
    order = F.struct("avg_score", "dataset")
    return dataset_comparison(star, sel).agg(
        F.max_by("dataset", order).alias("best"),
        F.max("avg_score").alias("best_score"),
        F.min_by("dataset", order).alias("worst"),
        F.min("avg_score").alias("worst_score"),
    )


def weekday_view(star: Star, sel: Selection) -> DataFrame:
    return quality_by_weekday(star, sel).select(
        "*",
        day_name(F.col("day_of_week")).alias("day_name"),
        quality_status(F.col("avg_score")).alias("status"),
    )


def weekday_extremes(star: Star, sel: Selection) -> DataFrame:
    """Best and worst day (the earlier day on ties) and the spread between days."""
    days = weekday_view(star, sel)
    spread = F.stddev_samp("avg_score")
    return days.agg(
        F.max_by("day_name", F.struct("avg_score", -F.col("day_of_week"))).alias("best_day"),
        F.max("avg_score").alias("best_score"),
        F.min_by("day_name", F.struct("avg_score", "day_of_week")).alias("worst_day"),
        F.min("avg_score").alias("worst_score"),
        spread.alias("spread"),
        F.coalesce(spread > DAY_SPREAD_ALARM, F.lit(False)).alias("high_spread"),
    )


def field_hierarchy(star: Star, sel: Selection) -> DataFrame:
    """Failures of the top fields by field and rule type, with totals per level."""
    return (
        field_issues(star, sel)
        .rollup("field_name", "rule_type")
        .agg(F.sum("failures").alias("failures"), F.grouping_id().cast("int").alias("level"))
    )


def top_field_alarm(star: Star, sel: Selection) -> DataFrame:
    """The field with the most failures, and whether its rule is of HIGH severity."""
    return field_issues(star, sel, 1).select(
        "field_name", "failures", "failure_rate", (F.col("severity") == "HIGH").alias("is_high")
    )


def daily_average_from_aggregate(daily: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Mean per day over all severities, read from the daily aggregate instead of the fact."""
    # Mean times count is a whole number of hundredths; rounding recovers it exactly.
    cents = F.round(F.col("avg_score") * F.col("total_checks") * 100).cast("long")
    return (
        daily.groupBy("date_key")
        .agg(F.sum(cents).alias("points"), F.sum("total_checks").alias("n"))
        .join(dim_date.select("date_key", "full_date"), "date_key")
        .select("full_date", exact_mean(F.col("points"), F.col("n"), 1).alias("avg_score"))
        .orderBy("full_date")
    )
