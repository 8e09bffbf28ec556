"""Check history read back: denormalising join, increments and watermarks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.timing import to_utc


@dataclass(frozen=True)
class History:
    """The three tables the extract reads."""

    check_results: DataFrame
    rules: DataFrame
    datasets: DataFrame


def since(results: DataFrame, mode: str, last_run: datetime | str | None) -> DataFrame:
    """All rows, or those at or after ``last_run``; re-read ties are removed on load."""
    if mode not in ("full", "incremental"):
        raise ValueError(f"Unknown extraction mode: {mode}")
    if mode == "full" or last_run is None:
        return results
    bound = F.lit(last_run).cast(results.schema["checked_at"].dataType)
    return results.where(F.col("checked_at") >= bound)


def _dimensions(history: History) -> tuple[DataFrame, DataFrame]:
    rules = history.rules.select(
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        "rule_type",
        "severity",
        "field_name",
        "dataset_type",
        "is_active",
    )
    datasets = history.datasets.select(
        F.col("id").alias("dataset_id"),
        F.col("name").alias("dataset_name"),
        "file_type",
        F.col("row_count").alias("dataset_row_count"),
        "column_count",
        "uploaded_at",
        F.col("status").alias("dataset_status"),
    )
    return rules, datasets


RESULT_COLUMNS = ["id", "dataset_id", "rule_id", "passed", "failed_rows", "total_rows", "checked_at"]


def base_extract(history: History) -> DataFrame:
    """Results with rule and dataset attributes; results of unknown rules or datasets drop out.

    No join hint: the planner broadcasts a dimension only when its measured size
    allows, and otherwise sort-merge joins with skewed partitions split.
    """
    rules, datasets = _dimensions(history)
    return history.check_results.select(*RESULT_COLUMNS).join(rules, "rule_id").join(datasets, "dataset_id")


def dimension_extract(history: History) -> DataFrame:
    """What dimensions need of ``base_extract``: one row per dataset and rule that met, with
    the times of their first and last result, ``checked_at`` and ``last_checked_at``.

    Results are reduced before any join, so a dataset that holds much of them is a row per
    rule there. Joined as they are, its results are alike in the columns a dimension needs;
    they compress to so little that millions end up in one task.
    """
    moment = to_utc(F.col("checked_at"))
    met = history.check_results.groupBy("dataset_id", "rule_id").agg(F.min(moment).alias("checked_at"), F.max(moment).alias("last_checked_at"))
    rules, datasets = _dimensions(history)
    return met.join(rules, "rule_id").join(datasets, "dataset_id")


def marked_extract(history: History) -> DataFrame:
    """All results, with the attributes of ``base_extract`` and ``known``: whether it has them.

    A run reads the source once through it: what is known is loaded, and all of it counts
    as what the source holds.
    """
    rules, datasets = _dimensions(history)
    found = history.check_results.select(*RESULT_COLUMNS)
    found = found.join(rules.withColumn("_rule", F.lit(True)), "rule_id", "left")
    found = found.join(datasets.withColumn("_dataset", F.lit(True)), "dataset_id", "left")
    return found.withColumn("known", F.col("_rule").isNotNull() & F.col("_dataset").isNotNull()).drop("_rule", "_dataset")


def build_extract(history: History, mode: str = "full", last_run: datetime | str | None = None) -> DataFrame:
    """The extract of one run. The time filter sits on the scan of the results."""
    return base_extract(
        History(since(history.check_results, mode, last_run), history.rules, history.datasets)
    )


def high_watermark(results: DataFrame) -> DataFrame:
    return results.agg(F.max("checked_at").alias("high_watermark"))


def record_count(results: DataFrame, mode: str = "full", last_run: datetime | str | None = None) -> DataFrame:
    return since(results, mode, last_run).agg(F.count(F.lit(1)).alias("records"))


def extract_with_watermark(
    history: History, stored: datetime | None
) -> tuple[DataFrame, datetime | None, str]:
    """Extract since the stored watermark, the watermark to store next, and the mode used.

    No watermark, or one ahead of the source, means a full extract.
    """
    newest = history.check_results.agg(
        F.unix_micros(F.max(F.col("checked_at").cast("timestamp"))).alias("w")
    ).first()["w"]
    current = from_micros(newest)
    behind = stored is not None and current is not None and stored <= current
    mode = "incremental" if behind else "full"
    return build_extract(history, mode, stored.replace(tzinfo=None) if behind else None), current, mode


def from_micros(micros: int | None) -> datetime | None:
    if micros is None:
        return None
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)
