"""Exports: result sets, the six-section report and the health summary."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.numeric import half_even
from truegauge.operators import analytics
from truegauge.operators.analytics import Selection
from truegauge.operators.star import Star


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report_sections(star: Star, sel: Selection) -> dict[str, DataFrame]:
    return {
        "kpi_summary": analytics.kpi_overview(star, sel),
        "quality_trends": analytics.quality_trends(star, sel),
        "failure_analysis": analytics.failure_by_rule_type(star, sel),
        "dataset_comparison": analytics.dataset_comparison(star, sel),
        "field_issues": analytics.field_issues(star, sel),
        "day_of_week": analytics.quality_by_weekday(star, sel),
    }


def export_report(star: Star, sel: Selection, path: str) -> list[str]:
    """One CSV folder per section that has rows; returns the sections written."""
    written = []
    for name, df in report_sections(star, sel).items():
        if not df.isEmpty():
            export_csv(df, f"{path.rstrip('/')}/section={name}")
            written.append(name)
    return written


def report_summary(star: Star, sel: Selection, generated: datetime | None = None, names: list[str] | None = None) -> DataFrame:
    """One row with the summary as JSON: filters, overall health and the KPI block."""
    kpi = analytics.kpi_derived(star, sel)
    moment = (generated or datetime.now(timezone.utc)).isoformat()
    zero = F.lit(0.0)
    average = F.coalesce(half_even(F.col("avg_score"), 1), zero)
    chosen = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    summary = F.struct(
        F.lit(moment).alias("report_generated"),
        F.struct(
            chosen.alias("datasets"),
            F.array(*[F.lit(s) for s in sel.severities]).alias("severities"),
            F.struct(F.lit(str(sel.start)).alias("start"), F.lit(str(sel.end)).alias("end")).alias("date_range"),
        ).alias("filters"),
        F.struct(F.coalesce("status", F.lit("Critical")).alias("status"), average.alias("avg_score")).alias("overall_health"),
        F.struct(
            F.col("total_checks"),
            F.coalesce("passed_checks", F.lit(0)).alias("passed_checks"),
            F.col("failed_checks"),
            half_even(F.col("pass_rate"), 1).alias("pass_rate"),
            average.alias("avg_score"),
            F.coalesce(half_even(F.col("min_score"), 1), zero).alias("min_score"),
            F.coalesce(half_even(F.col("max_score"), 1), zero).alias("max_score"),
        ).alias("kpi"),
    )
    return kpi.select(F.to_json(summary).alias("summary"))
