"""Star schema built from an extract: three dimensions, one fact, warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.keyed import pick_one
from truegauge.functions.numeric import half_even
from truegauge.functions.timing import date_key, to_utc

# The published table layouts.
REQUIRED = ["dataset_id", "rule_id", "total_rows", "checked_at"]
BUSINESS_KEY = ["dataset_id", "rule_id", "checked_at"]
DATASET_COLUMNS = {
    "dataset_id": "id",
    "dataset_name": "name",
    "file_type": "file_type",
    "dataset_row_count": "row_count",
    "column_count": "column_count",
    "dataset_status": "status",
    "uploaded_at": "uploaded_at",
}
RULE_COLUMNS = {
    "rule_id": "id",
    "rule_name": "name",
    "field_name": "field_name",
    "rule_type": "rule_type",
    "severity": "severity",
    "dataset_type": "dataset_type",
    "is_active": "is_active",
}
DATE_COLUMNS = ["date_key", "full_date", "day_of_week", "month", "quarter", "year"]
FACT_COLUMNS = ["dataset_id", "rule_id", "date_key", "passed", "failed_rows", "total_rows", "score", "checked_at"]


class SchemaError(ValueError):
    """A table lacks required columns."""


@dataclass(frozen=True)
class Star:
    """The four tables; lazy."""

    dim_datasets: DataFrame
    dim_rules: DataFrame
    dim_date: DataFrame
    facts: DataFrame


@dataclass(frozen=True)
class Transformed:
    star: Star
    warnings: DataFrame


def check_schema(df: DataFrame, expected: Sequence[str], name: str) -> list[str]:
    """Raises on missing columns; returns a note when there are extra ones."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise SchemaError(f"{name}: Missing required columns: {missing}")
    extra = sorted(set(df.columns) - set(expected))
    return [f"{name}: Extra columns present (will be ignored): {extra}"] if extra else []


def raw_problems(raw: DataFrame) -> DataFrame:
    """Warnings about an extract, ``check, n, message``, one row per problem found.

    One aggregate counts the nulls and empty checks; a second one, over the
    business key, counts surplus duplicates.
    """
    check_schema(raw.select(*[c for c in raw.columns if c in REQUIRED]), REQUIRED, "raw")
    counts = raw.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED],
        F.count_if(F.col("total_rows") <= 0).alias("empty"),
    )
    entries = [
        F.struct(
            F.lit(f"NULL_{c.upper()}").alias("check"),
            F.col(f"null_{c}").alias("n"),
            F.concat(F.lit(f"Column '{c}' has "), F.col(f"null_{c}"), F.lit(" null values")).alias("message"),
        )
        for c in REQUIRED
    ] + [
        F.struct(
            F.lit("EMPTY_CHECK").alias("check"),
            F.col("empty").alias("n"),
            F.concat(F.col("empty"), F.lit(" records have total_rows <= 0")).alias("message"),
        )
    ]
    repeated = surplus_duplicates(raw).select(
        F.lit("DUPLICATE").alias("check"),
        F.col("duplicates").alias("n"),
        F.concat(F.col("duplicates"), F.lit(" duplicate check results found")).alias("message"),
    )
    return counts.select(F.inline(F.array(*entries))).unionByName(repeated).where("n > 0")


def surplus_duplicates(rows: DataFrame) -> DataFrame:
    """Rows beyond the first of each business key, as one number."""
    per_key = rows.groupBy(*BUSINESS_KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def _dimension(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    # Distinct over whole rows is a hash aggregate without value buffers, so the facts
    # are never sorted. One row per id is then picked from the few rows left by a
    # window: dropDuplicates would be merged with the distinct into one sort aggregate.
    columns = [F.col(source).alias(target) for source, target in mapping.items()]
    rows = raw.select(*columns).distinct()
    return pick_one(rows, ["id"], [F.col(c) for c in mapping.values() if c != "id"])


def build_dim_datasets(raw: DataFrame) -> DataFrame:
    return _dimension(raw, DATASET_COLUMNS)


def build_dim_rules(raw: DataFrame) -> DataFrame:
    return _dimension(raw, RULE_COLUMNS).withColumn("is_active", F.col("is_active").cast("boolean"))


def build_dim_date(raw: DataFrame) -> DataFrame:
    """Every day from the first to the last check; no rows without valid dates.

    Rows of several checks hold the last of them in ``last_checked_at``.
    """
    last = "last_checked_at" if "last_checked_at" in raw.columns else "checked_at"
    first, last = (F.to_date(to_utc(F.col(c))) for c in ("checked_at", last))
    span = raw.agg(F.min(first).alias("first"), F.max(last).alias("last")).where("first is not null")
    days = span.select(F.explode(F.sequence("first", "last")).alias("full_date"))
    full = F.col("full_date")
    return days.select(
        date_key(full).alias("date_key"),
        full,
        F.weekday(full).cast("int").alias("day_of_week"),
        F.month(full).cast("int").alias("month"),
        F.quarter(full).cast("int").alias("quarter"),
        F.year(full).cast("int").alias("year"),
    )


def fact_score(failed: Column, total: Column) -> Column:
    """Percentage of rows that passed, two decimals; 0 for an empty check."""
    share = (total - failed).cast("double") / F.when(total > 0, total).cast("double") * 100
    return F.coalesce(half_even(share, 2), F.lit(0.0))


def build_facts(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    """Facts with score and date key; of equal business keys the newest source row stays."""
    moment = to_utc(F.col("checked_at"))
    facts = raw.select(
        "id",
        "dataset_id",
        "rule_id",
        date_key(moment).alias("date_key"),
        F.col("passed").cast("boolean").alias("passed"),
        "failed_rows",
        "total_rows",
        fact_score(F.col("failed_rows"), F.col("total_rows")).alias("score"),
        moment.cast("timestamp_ntz").alias("checked_at"),
    )
    if dedupe:
        # date_key follows from checked_at; as a key it lets day filters pass the window.
        facts = pick_one(facts, [*BUSINESS_KEY, "date_key"], [F.col("id").desc()])
    return facts


def date_key_problems(facts: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Facts without a date, and date keys the date dimension does not know."""
    per_key = facts.groupBy("date_key").agg(F.count(F.lit(1)).alias("rows"))
    undated = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("date_key") == 0, F.col("rows"))), F.lit(0)).cast("long").alias("n")
    ).select(
        F.lit("INVALID_DATE_KEY").alias("check"),
        "n",
        F.concat("n", F.lit(" facts have invalid date_key (NULL checked_at)")).alias("message"),
    )
    unknown = (
        per_key.where("date_key <> 0")
        .join(dim_date.select("date_key"), "date_key", "left_anti")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.lit("ORPHAN_DATE_KEY").alias("check"),
            "n",
            F.concat("n", F.lit(" date_keys in facts not found in dim_date")).alias("message"),
        )
    )
    return undated.unionByName(unknown)


def build_star(raw: DataFrame, dims: DataFrame | None = None) -> Star:
    """The four tables. Nothing runs until one of them is used.

    ``dims``, the ``dimension_extract`` of the same history, spares the dimensions the rows
    of all results.
    """
    check_schema(raw.select(*[c for c in raw.columns if c in REQUIRED]), REQUIRED, "raw")
    dims = raw if dims is None else dims
    return Star(build_dim_datasets(dims), build_dim_rules(dims), build_dim_date(dims), build_facts(raw))


def transform(raw: DataFrame) -> Transformed:
    """The four tables and the warnings about the extract."""
    star = build_star(raw)
    for table, columns, name in (
        (star.dim_datasets, list(DATASET_COLUMNS.values()), "dim_datasets"),
        (star.dim_rules, list(RULE_COLUMNS.values()), "dim_rules"),
        (star.dim_date, DATE_COLUMNS, "dim_date"),
        (star.facts, FACT_COLUMNS, "fact_quality_checks"),
    ):
        check_schema(table, columns, name)
    undated = date_key_problems(star.facts, star.dim_date).where("n > 0")
    return Transformed(star, raw_problems(raw).unionByName(undated))
