"""A check run: rules out of a table, results, scores, audit rows, statuses and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators import alerts, checks, scoring
from truegauge.operators.rules import read_rules, rules_for


@dataclass(frozen=True)
class CheckRun:
    """What one run adds to the history, and the datasets with the statuses they earned."""

    scores: DataFrame
    results: DataFrame
    audit: DataFrame
    datasets: DataFrame
    alerts: DataFrame

    def append_to(self, root: str) -> None:
        """Scores, results and audit rows at the end of their tables under ``root``."""
        for name in ("scores", "results", "audit"):
            scoring.append_rows(getattr(self, name), f"{root.rstrip('/')}/{name}")


def run(
    rows: DataFrame,
    datasets: DataFrame,
    rules: DataFrame,
    configs: DataFrame,
    checked_at: Column,
    trigger: str = "scheduled",
) -> CheckRun:
    """Check every eligible dataset; ``rows`` holds their data, keyed by ``dataset_id``.

    The datasets of a file type meet the same rules, so each file type is one keyed run,
    however many datasets it has; rules are query text and come to the driver. The id of
    a score is its dataset and time as one number, so runs never collide.
    """
    taken = scoring.eligible(datasets).where("skip_reason is null")
    kinds = [r[0] for r in taken.select(F.lower("file_type")).distinct().collect()]
    results, scores = [], []
    for kind in sorted(k for k in kinds if k):
        mine = taken.where(F.lower("file_type") == kind).select(F.col("id").alias("dataset_id"))
        compiled = read_rules(rules_for(rules, kind))
        found = checks.run_checks_by(rows.join(mine, "dataset_id", "left_semi"), compiled, ["dataset_id"])
        results.append(found)
        scores.append(scoring.score_results(found, compiled, ["dataset_id"]))
    if not results:
        # No eligible dataset: the same tables without rows, of a run over no rules.
        found = checks.run_checks_by(rows.limit(0), [], ["dataset_id"])
        results, scores = [found], [scoring.score_results(found, [], ["dataset_id"])]
    result = _all(results)
    number = F.col("dataset_id").cast("long") * 10_000_000_000 + F.unix_timestamp("checked_at")
    score = _all(scores).withColumn("checked_at", checked_at).withColumn("id", number)
    return CheckRun(
        scores=score,
        results=scoring.check_result_rows(result, score, rules),
        audit=scoring.audit_rows(score, trigger),
        datasets=scoring.apply_status(datasets, score),
        alerts=alerts.alerts(score, configs),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
