"""Rule catalogue: validity, parameters, applicability, upkeep and search.

A rule table has ``id, name, field_name, rule_type, severity, dataset_type,
is_active, parameters`` (JSON text).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rule model.
RULE_TYPES = ["NOT_NULL", "DATA_TYPE", "RANGE", "UNIQUE", "REGEX"]
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
DEFAULT_SEVERITY = "MEDIUM"
SEVERITY_WEIGHTS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
ANY_DATASET_TYPE = ["all", ""]
# A backslash that neither follows a backslash nor starts a JSON escape.
LONE_BACKSLASH = r'(?<!\\)\\(?![\\"/bfnrtu])'

# Stands for every file type; a blank is no file type.
EVERY_TYPE = " "

RULE_FIELDS = ["name", "field_name", "rule_type", "severity", "dataset_type", "is_active", "parameters"]
PARAMETER_SCHEMA = "expected_type STRING, min DOUBLE, max DOUBLE, pattern STRING"


@dataclass(frozen=True)
class Rule:
    """One rule as the check compiler reads it."""

    id: int
    field_name: str
    rule_type: str
    severity: str = DEFAULT_SEVERITY
    parameters: dict[str, Any] = field(default_factory=dict)
    name: str = ""

    @staticmethod
    def from_row(row: Any) -> "Rule":
        values = row.asDict() if hasattr(row, "asDict") else dict(row)
        raw = values.get("parameters")
        params = raw if isinstance(raw, dict) else (json.loads(raw) if raw and raw.strip() else {})
        return Rule(
            id=values["id"],
            field_name=values.get("field_name") or "",
            rule_type=values.get("rule_type") or "",
            severity=values.get("severity") or DEFAULT_SEVERITY,
            parameters=params,
            name=values.get("name") or "",
        )


def read_rules(rules: DataFrame) -> list[Rule]:
    """Rule definitions are query text, not data: they come to the driver, one by one."""
    ordered = rules.orderBy("id")
    return [Rule.from_row(r) for r in ordered.toLocalIterator()]


def severity_weight(severity: Column) -> Column:
    weight = F.lit(1)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, value).otherwise(weight)
    return weight


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parse_parameters(text: Column) -> Column:
    """JSON text usable as parameters.

    Blank passes through; text that is not JSON is retried with its lone
    backslashes doubled; null means it had to be rejected.
    """
    repaired = F.regexp_replace(text, LONE_BACKSLASH, r"\\\\")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.coalesce(text, F.lit("")))
        .when(is_json(text), text)
        .when(is_json(repaired), repaired)
    )


def repair_parameters(text: str) -> str:
    """The same repair for one rule typed by a user; raises when it cannot be JSON."""
    if not text or not text.strip():
        return text
    for candidate in (text, re.sub(LONE_BACKSLASH, r"\\\\", text)):
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    raise ValueError("Parameters must be a valid JSON string.")


def typed_parameters(text: Column) -> Column:
    """Struct of ``expected_type, min, max, pattern`` with their defaults."""
    filled = F.when(text.isNull() | (F.trim(text) == ""), F.lit("{}")).otherwise(text)
    parsed = F.from_json(filled, PARAMETER_SCHEMA)
    return F.struct(
        F.coalesce(parsed["expected_type"], F.lit("str")).alias("expected_type"),
        parsed["min"].alias("min"),
        parsed["max"].alias("max"),
        F.coalesce(parsed["pattern"], F.lit("")).alias("pattern"),
    )


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (null when valid); a missing severity gets the default."""
    severity = F.coalesce(F.col("severity"), F.lit(DEFAULT_SEVERITY))
    known_type = F.coalesce(F.col("rule_type").isin(RULE_TYPES), F.lit(False))
    reason = F.when(~known_type, "Invalid rule_type").when(~severity.isin(SEVERITIES), "Invalid severity")
    if "parameters" in rules.columns:
        reason = F.coalesce(
            reason, F.when(parse_parameters(F.col("parameters")).isNull(), "Parameters must be a valid JSON string.")
        )
    return rules.withColumn("severity", severity).withColumn("reject_reason", reason)


def applicable_rules(datasets: DataFrame, rules: DataFrame) -> DataFrame:
    """Active rules per file type in use: ``file_type, rule_id, severity, weight``.

    A rule serves its own file type or, when general, each of them. Datasets meet
    their rules by joining on ``file_type``; (dataset, rule) pairs are never listed.
    """
    active = rules.where(F.col("is_active"))
    served = datasets.select(F.lower("file_type").alias("file_type")).where("file_type is not null").distinct()
    # A file type answers to its own name and to the mark of general rules.
    reach = served.withColumn("_scope", F.explode(F.array("file_type", F.lit(EVERY_TYPE))))
    scope = F.when(F.col("dataset_type").isin(ANY_DATASET_TYPE), EVERY_TYPE).otherwise(F.col("dataset_type"))
    return (
        active.withColumn("_scope", scope)
        .join(reach, "_scope")
        .select("file_type", F.col("id").alias("rule_id"), "severity", severity_weight(F.col("severity")).alias("weight"))
    )


def rule_load(datasets: DataFrame, rules: DataFrame) -> DataFrame:
    """Every dataset with the number and summed weight of the rules it must meet."""
    per_type = (
        applicable_rules(datasets, rules)
        .groupBy("file_type")
        .agg(F.count("rule_id").alias("rules"), F.sum("weight").alias("weights"))
    )
    return (
        datasets.select(F.col("id").alias("dataset_id"), F.lower("file_type").alias("file_type"))
        .join(per_type, "file_type", "left")
        .select(
            "dataset_id",
            "file_type",
            F.coalesce("rules", F.lit(0)).cast("long").alias("rules"),
            F.coalesce("weights", F.lit(0)).cast("long").alias("weights"),
        )
    )


def rules_for(rules: DataFrame, file_type: str) -> DataFrame:
    """Active rules of one file type."""
    return rules.where(F.col("is_active") & F.col("dataset_type").isin([file_type.lower(), *ANY_DATASET_TYPE]))


def list_rules(rules: DataFrame, dataset_type: str | None = None) -> DataFrame:
    active = rules.where(F.col("is_active"))
    return active.where(F.col("dataset_type") == dataset_type) if dataset_type else active


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules after a batch of partial changes: null in a change keeps the old value.

    Only active rules can be changed; ids that do not exist yet are added.
    """
    fields = [c for c in RULE_FIELDS if c in rules.columns]
    given = [c for c in fields if c in changes.columns]
    new = changes.select(F.col("id"), *[F.col(c).alias(f"new_{c}") for c in given])
    merged = rules.join(new, "id", "left")
    updated = merged.select(
        *[
            F.when(F.col("is_active"), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
            for c in rules.columns
        ]
    )
    defaults = {"severity": F.lit(DEFAULT_SEVERITY), "is_active": F.lit(True)}
    added = changes.join(rules.select("id"), "id", "left_anti").select(
        *[
            (F.coalesce(F.col(c), defaults[c]) if c in defaults else F.col(c)).alias(c)
            if c in changes.columns
            else defaults.get(c, F.lit(None)).cast(rules.schema[c].dataType).alias(c)
            for c in rules.columns
        ]
    )
    return updated.unionByName(added)


def deactivate_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: the rows stay, ``is_active`` turns false."""
    dropped = ids.select("id").distinct().withColumn("_dropped", F.lit(True))
    return (
        rules.join(dropped, "id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_dropped").isNull())
        .select(*rules.columns)
    )


def search_rules(
    rules: DataFrame, text: str = "", rule_type: str | None = None, severity: str | None = None
) -> DataFrame:
    needle = text.lower()
    found = rules.where(F.lower("name").contains(needle) | F.lower("field_name").contains(needle))
    if rule_type:
        found = found.where(F.col("rule_type") == rule_type)
    if severity:
        found = found.where(F.col("severity") == severity)
    return found


def page(df: DataFrame, number: int, size: int, order: Sequence[str | Column] = ("id",)) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def as_rules(rules: DataFrame | Iterable[Rule]) -> list[Rule]:
    return read_rules(rules) if isinstance(rules, DataFrame) else list(rules)
