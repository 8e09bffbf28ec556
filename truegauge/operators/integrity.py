"""Post-load validation of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.numeric import exact_mean, half_even, half_up, percent, plain_mean, score_cents
from truegauge.operators.star import BUSINESS_KEY, Star, surplus_duplicates

MIN_SCORE, MAX_SCORE = 0.0, 100.0
HIGH_FAILURE_RATE = 50
ERROR_LEVELS = ["ERROR", "CRITICAL"]
FINDING = ["check", "message", "severity", "details"]


class IntegrityError(RuntimeError):
    """Validation found errors."""


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def row_counts(source: DataFrame, facts: DataFrame) -> DataFrame:
    """Source rows, target rows and their difference, in one row."""
    sides = _count(source, "n").select(F.lit("source").alias("side"), "n").unionByName(
        _count(facts, "n").select(F.lit("target").alias("side"), "n")
    )
    totals = sides.agg(
        F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source"),
        F.max(F.when(F.col("side") == "target", F.col("n"))).alias("target"),
    )
    return totals.withColumn("delta", F.col("target") - F.col("source"))


def orphans(star: Star) -> DataFrame:
    """Facts without their dataset, rule or date: ``entity, orphans``.

    Facts are read once and counted per combination of keys; the dimensions are joined
    to those, so it does not matter how many facts one dataset holds.
    """
    cells = star.facts.groupBy("date_key", "dataset_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    counts = _with_dimensions(cells, star).agg(*[_orphans_of(key).alias(entity) for entity, key in ENTITIES.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(e).alias("entity"), F.col(e).alias("orphans")) for e in ENTITIES])))


ENTITIES = {"dataset": "dataset_id", "rule": "rule_id", "date": "date_key"}


def _with_dimensions(cells: DataFrame, star: Star) -> DataFrame:
    """Cells of facts with a flag for each dimension that knows them."""
    for dimension, dim_key, key in (
        (star.dim_datasets, "id", "dataset_id"),
        (star.dim_rules, "id", "rule_id"),
        (star.dim_date, "date_key", "date_key"),
    ):
        known = dimension.select(F.col(dim_key).alias(key)).distinct().withColumn(f"has_{key}", F.lit(True))
        cells = cells.join(known, key, "left")
    return cells


def _orphans_of(key: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(f"has_{key}").isNull(), F.col("n"))), F.lit(0)).cast("long")


def score_range(facts: DataFrame, low: float = MIN_SCORE, high: float = MAX_SCORE) -> DataFrame:
    outside = (F.col("score") < low) | (F.col("score") > high)
    return facts.agg(F.count_if(outside).alias("invalid_scores"))


def duplicate_groups(facts: DataFrame) -> DataFrame:
    """Business keys that occur more than once."""
    per_key = facts.groupBy(*BUSINESS_KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_key.where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))


def duplicate_rows(facts: DataFrame) -> DataFrame:
    """Rows beyond the first of each business key; rows with a null key part count too.

    The distinct count is taken over one struct, as ``count(distinct (a, b, c))``.
    """
    return surplus_duplicates(facts).select(F.col("duplicates").alias("duplicate_rows"))


def summary_statistics(facts: DataFrame) -> DataFrame:
    """Totals, success rate and score range; zeros and nulls for an empty table."""
    n, ok = F.count(F.lit(1)), F.count_if("passed")
    rate = F.round(
        F.try_divide((ok * 100).cast("decimal(20,0)"), n.cast("decimal(18,0)")), 2
    ).cast("double")
    return facts.agg(
        n.alias("total_records"),
        ok.alias("passed_count"),
        (n - ok).alias("failed_count"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate"),
        F.coalesce(exact_mean(F.sum(score_cents(F.col("score"))), F.count("score"), 2), F.lit(0.0)).alias("avg_score"),
        F.coalesce(half_up(F.min("score"), 2), F.lit(0.0)).alias("min_score"),
        F.coalesce(half_up(F.max("score"), 2), F.lit(100.0)).alias("max_score"),
    )


def rate_of(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, 0 when there is nothing to divide by."""
    return F.coalesce(half_even(percent(part, whole), 2), F.lit(0.0))


def dataset_summary(star: Star) -> DataFrame:
    """Per dataset: counts, pass rate and score range."""
    per_dataset = star.facts.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.sum(score_cents(F.col("score"))).alias("points"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
    names = star.dim_datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return per_dataset.join(names, "dataset_id").select(
        "dataset_id",
        "dataset_name",
        "total_checks",
        "passed_checks",
        "failed_checks",
        plain_mean(F.col("points"), F.col("total_checks")).alias("avg_score"),
        "min_score",
        "max_score",
        rate_of(F.col("passed_checks"), F.col("total_checks")).alias("pass_rate"),
    )


def rule_failure_summary(star: Star) -> DataFrame:
    """Per rule: checks, failures and failure rate."""
    per_rule = star.facts.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if(~F.col("passed")).alias("failure_count")
    )
    rules = star.dim_rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity")
    return per_rule.join(rules, "rule_id").select(
        "rule_id",
        "rule_name",
        "severity",
        "total_checks",
        "failure_count",
        rate_of(F.col("failure_count"), F.col("total_checks")).alias("failure_rate"),
    )


def high_failure_rules(star: Star, above: float = HIGH_FAILURE_RATE) -> DataFrame:
    return rule_failure_summary(star).where(F.col("failure_rate") > above)


def day_figures(star: Star, low: float = MIN_SCORE, high: float = MAX_SCORE) -> DataFrame:
    """What validation counts, per day: ``date_key, facts, invalid_scores, duplicate_groups,
    orphan_datasets, orphan_rules, orphan_dates``.

    A business key lies within one day, so the figures of days add up. Facts are read and
    shuffled once; the dimensions are joined to (day, dataset, rule) cells.
    """
    outside = (F.col("score") < low) | (F.col("score") > high)
    per_key = star.facts.groupBy("date_key", *BUSINESS_KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("bad"))
    cells = per_key.groupBy("date_key", "dataset_id", "rule_id").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count_if(F.col("n") > 1).alias("repeated")
    )
    cells = _with_dimensions(cells, star)
    return cells.groupBy("date_key").agg(
        F.sum("n").alias("facts"),
        F.sum("bad").alias("invalid_scores"),
        F.sum("repeated").alias("duplicate_groups"),
        _orphans_of("dataset_id").alias("orphan_datasets"),
        _orphans_of("rule_id").alias("orphan_rules"),
        _orphans_of("date_key").alias("orphan_dates"),
    )


DAY_FIGURES = ["facts", "invalid_scores", "duplicate_groups", "orphan_datasets", "orphan_rules", "orphan_dates"]


def totals(per_day: DataFrame) -> DataFrame:
    """``day_figures`` added up, in one row; zeros without days."""
    return per_day.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in DAY_FIGURES])


def findings(figures: DataFrame, low: float = MIN_SCORE, high: float = MAX_SCORE) -> DataFrame:
    """``totals`` with ``source`` as findings: ``check, message, severity, details``."""
    delta = (F.col("facts") - F.col("source")).alias("delta")
    target = F.col("facts").alias("target")

    def one(check: str, n: Column, message: Column, severity: str, details: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), message.alias("message"), F.lit(severity).alias("severity"), F.to_json(details).alias("details"), n.alias("n"))

    text = "Source: %d, Target: %d. Delta may indicate multiple ETL runs or deduplication."
    rows = [one("ROW_COUNT", F.col("facts") - F.col("source"), F.format_string(text, "source", "facts"), "WARNING", F.struct("source", target, delta))]
    for entity in ("dataset", "rule", "date"):
        n = F.col(f"orphan_{entity}s")
        message = F.format_string(f"%d orphaned {entity} references", n)
        rows.append(one(f"FK_{entity.upper()}", n, message, "ERROR", F.struct(n.alias("count"), F.lit(entity).alias("entity"))))
    n = F.col("invalid_scores")
    bounds = F.struct(n.alias("count"), F.lit(low).alias("min_allowed"), F.lit(high).alias("max_allowed"))
    rows.append(one("INVALID_SCORE", n, F.concat(n, F.lit(f" scores outside [{low}, {high}]")), "ERROR", bounds))
    n = F.col("duplicate_groups")
    rows.append(one("DUPLICATE_FACTS", n, F.concat(n, F.lit(" duplicate fact groups detected")), "WARNING", F.struct("duplicate_groups")))
    return figures.select(F.inline(F.array(*rows))).where("n <> 0").select(*FINDING)


def validate(source: DataFrame, star: Star, low: float = MIN_SCORE, high: float = MAX_SCORE) -> DataFrame:
    """One row per finding: ``check, message, severity, details``."""
    figures = totals(day_figures(star, low, high))
    return findings(figures.withColumn("source", _count(source, "n").scalar()), low, high)


def verdict(findings: DataFrame) -> DataFrame:
    """``error_count, warning_count, passed`` of a list of findings."""
    is_error = F.col("severity").isin(ERROR_LEVELS)
    return findings.agg(
        F.count_if(is_error).alias("error_count"),
        F.count_if(~is_error).alias("warning_count"),
        (F.count_if(is_error) == 0).alias("passed"),
    )


def guarded(findings: DataFrame) -> DataFrame:
    """The same findings, but reading them fails as soon as one is an error."""
    is_error = F.col("severity").isin(ERROR_LEVELS)
    alarm = F.raise_error(F.concat(F.lit("Pipeline validation failed: ["), F.col("check"), F.lit("] "), F.col("message")))
    return findings.withColumn("message", F.when(is_error, alarm).otherwise(F.col("message")))


def validate_with_guard(source: DataFrame, star: Star) -> list[dict]:
    """Findings as plain rows, at most six; raises when any is an error."""
    findings = [r.asDict() for r in validate(source, star).collect()]
    errors = [f"[{f['severity']}] [{f['check']}] {f['message']}" for f in findings if f["severity"] in ERROR_LEVELS]
    if errors:
        raise IntegrityError(f"Pipeline validation failed with {len(errors)} critical error(s): {errors}")
    return findings
