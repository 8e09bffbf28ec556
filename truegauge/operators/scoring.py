"""Severity-weighted scores and the rows one check run leaves behind."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.numeric import half_even
from truegauge.operators.rules import SEVERITY_WEIGHTS, Rule, applicable_rules, rule_load, severity_weight

# Weighted rates are added as decimals: the sum must not depend on row order.
RATE_DECIMAL = "decimal(20,12)"
# Why a run is refused.
BLOCKED_STATUS = {
    "PROCESSING": "Dataset is currently processing. Please wait for processing to finish.",
    "ERROR": "Dataset parsing failed, cannot run checks.",
}
NO_FILE = "No file associated with this dataset"


def pass_rate(failed: Column, total: Column, passed: Column) -> Column:
    """Share of rows that passed; an empty dataset counts by the verdict, no result as 0."""
    return (
        F.when(total > 0, (total - failed).cast("double") / F.nullif(total, F.lit(0)).cast("double"))
        .when(F.coalesce(passed, F.lit(False)), 1.0)
        .otherwise(0.0)
    )


def rule_performance(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results of known rules with the rule's weight and pass rate."""
    return results.join(
        rules.select(
            F.col("id").alias("rule_id"), "severity", severity_weight(F.col("severity")).alias("weight")
        ),
        "rule_id",
    ).withColumn("rate", pass_rate(F.col("failed_rows"), F.col("total_rows"), F.col("passed")))


def _score_columns(weighted: Column, weights: Column, passed: Column, rules: Column) -> list[Column]:
    score = F.try_divide(weighted.cast("double"), weights.cast("double")) * 100
    return [
        F.coalesce(half_even(score, 2), F.lit(100.0)).alias("score"),
        rules.cast("long").alias("total_rules"),
        passed.cast("long").alias("passed_rules"),
        (rules - passed).cast("long").alias("failed_rules"),
    ]


def quality_score(datasets: DataFrame, rules: DataFrame, results: DataFrame) -> DataFrame:
    """Score of every dataset from at most one result per (dataset, rule).

    Results are added up per dataset before anything is joined to it; the rules a
    dataset should have met come as a count and a weight, so a rule without a
    result fails without being listed. A dataset without rules scores 100.
    """
    in_scope = rule_performance(results, rules.where("is_active")).join(
        applicable_rules(datasets, rules).select("file_type", "rule_id"), "rule_id"
    )
    earned = (
        in_scope.groupBy("dataset_id", "file_type")
        .agg(
            F.sum((F.col("weight") * F.col("rate")).cast(RATE_DECIMAL)).alias("weighted"),
            F.count_if("passed").alias("passed"),
        )
    )
    zero = F.lit(0)
    return (
        rule_load(datasets, rules)
        .join(earned, ["dataset_id", "file_type"], "left")
        .select(
            "dataset_id",
            *_score_columns(
                F.coalesce("weighted", zero), F.col("weights"), F.coalesce("passed", zero), F.col("rules")
            ),
        )
    )


def score_results(results: DataFrame, rules: Iterable[Rule], by: Sequence[str] = ()) -> DataFrame:
    """Scores of a run whose rule list is at hand: its weights are constants, so the
    results are aggregated without a join."""
    rules = list(rules)
    weights = {r.id: SEVERITY_WEIGHTS.get(r.severity, 1) for r in rules}
    total = sum(weights.values())
    if not weights:
        groups = results.select(*by).distinct() if by else results.sparkSession.range(1).select()
        return groups.select(
            *by, F.lit(100.0).alias("score"), *[F.lit(0).cast("long").alias(c) for c in ("total_rules", "passed_rules", "failed_rules")]
        )
    lookup = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    weight = F.try_element_at(lookup, F.col("rule_id").cast("int" if max(weights) < 2**31 else "long"))
    rate = pass_rate(F.col("failed_rows"), F.col("total_rows"), F.col("passed"))
    known = results.withColumn("weight", weight).where("weight is not null")
    scored = known.groupBy(*by).agg(
        F.sum((F.col("weight") * rate).cast(RATE_DECIMAL)).alias("weighted"),
        F.count_if("passed").alias("passed"),
    )
    zero = F.lit(0)
    return scored.select(
        *by,
        *_score_columns(
            F.coalesce("weighted", zero), F.lit(total), F.coalesce("passed", zero), F.lit(len(weights))
        ),
    )


def dataset_status(failed_rules: Column) -> Column:
    return F.when(failed_rules == 0, "VALIDATED").otherwise("FAILED")


def apply_status(datasets: DataFrame, scores: DataFrame) -> DataFrame:
    """Datasets with the status their run earned; those without a run keep theirs."""
    earned = scores.select(F.col("dataset_id").alias("id"), dataset_status(F.col("failed_rules")).alias("earned"))
    return (
        datasets.join(earned, "id", "left")
        .withColumn("status", F.coalesce("earned", "status"))
        .select(*datasets.columns)
    )


def eligible(datasets: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds ``skip_reason``: null for datasets a run may take."""
    reason = F.lit(None).cast("string")
    for status, text in BLOCKED_STATUS.items():
        reason = F.when(F.col("status") == status, text).otherwise(reason)
    if files is None:
        return datasets.withColumn("skip_reason", reason)
    owners = files.select(F.col("dataset_id").alias("id")).distinct().withColumn("_has_file", F.lit(True))
    return (
        datasets.join(owners, "id", "left")
        .withColumn("skip_reason", F.coalesce(reason, F.when(F.col("_has_file").isNull(), NO_FILE)))
        .drop("_has_file")
    )


def check_result_rows(results: DataFrame, scores: DataFrame, rules: DataFrame) -> DataFrame:
    """Result rows to append: linked to their score row, rules that no longer exist skipped.

    ``details`` carries message and samples as JSON when the results have samples.
    """
    known = rules.select(F.col("id").alias("rule_id"))
    linked = scores.select("dataset_id", F.col("id").alias("quality_score_id"), "checked_at")
    details = F.col("details")
    if "samples" in results.columns:
        details = F.to_json(F.struct(F.col("details").alias("message"), F.col("samples")))
    return (
        results.join(known, "rule_id", "left_semi")
        .join(linked, "dataset_id")
        .select(
            "dataset_id",
            "rule_id",
            "quality_score_id",
            "passed",
            "failed_rows",
            "total_rows",
            details.alias("details"),
            "checked_at",
        )
    )


def audit_rows(scores: DataFrame, trigger_type: str, triggered_by: str = "system") -> DataFrame:
    """One audit row per run; the table only ever grows."""
    if trigger_type not in ("manual", "scheduled"):
        raise ValueError(f"Unknown trigger type: {trigger_type}")
    return scores.select(
        "dataset_id",
        F.lit(triggered_by).alias("triggered_by"),
        F.lit(trigger_type).alias("trigger_type"),
        "score",
        F.col("checked_at").alias("timestamp"),
    )


def append_rows(rows: DataFrame, path: str) -> None:
    """Append-only sink of scores, results and audit rows."""
    rows.write.mode("append").parquet(path)
