"""Rollups behind the administrator and user pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.keyed import pick_one, pick_top
from truegauge.functions.numeric import nearest_int, percent
from truegauge.operators.reports import latest_scores

# Fixed values shown by the pages.
TREND_DAYS = 7
TOP = 5
SAMPLE_LIMIT = 10
NO_OWNER = "System User"
NO_DATASET = "Unknown"
UNCHECKED = ["PENDING", "PROCESSING", "ERROR"]
DEFAULT_REASON = "Rule validation failed"


def _whole_mean(total: Column, count: Column) -> Column:
    """Mean to the nearest integer, 0 when there is nothing to average."""
    return F.coalesce(nearest_int(F.try_divide(total, count)), F.lit(0)).cast("long")


def _exact(score: Column) -> Column:
    # Scores carry up to 12 decimals here; decimals keep sums independent of order.
    return score.cast("decimal(20,12)")


def _sum(score: Column) -> Column:
    return F.sum(_exact(score)).cast("double")


def daily_trend(scores: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """Mean score per day over all given scores, missing ones as 0; the last days that have any."""
    return (
        scores.where("checked_at is not null")
        .groupBy(F.to_date("checked_at").alias("day"))
        .agg(_whole_mean(_sum(F.coalesce("score", F.lit(0.0))), F.count(F.lit(1))).alias("score"))
        .orderBy(F.desc("day"))
        .limit(days)
    )


def current_scores(datasets: DataFrame, scores: DataFrame) -> DataFrame:
    """Datasets with the score, rule count and time of their latest run (null if none)."""
    newest = latest_scores(scores).select(
        F.col("dataset_id").alias("id"), "score", "total_rules", F.col("checked_at").alias("last_checked")
    )
    return datasets.join(newest, "id", "left")


def average_score(scored: DataFrame) -> DataFrame:
    return scored.agg(_whole_mean(_sum(F.col("score")), F.count("score")).alias("avg_score"))


def worst_datasets(scored: DataFrame, n: int = TOP) -> DataFrame:
    return scored.where("score is not null").orderBy("score", "id").limit(n).select("id", "name", "score")


def _per_owner(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("uploaded_by").alias("id")).agg(
        F.count(F.lit(1)).alias("uploads"), F.count("score").alias("scored"), _sum(F.col("score")).alias("points")
    )


def active_users(users: DataFrame, scored: DataFrame, n: int = TOP) -> DataFrame:
    """Users with most uploads; datasets without a score weigh as 0 in the mean."""
    return (
        users.join(_per_owner(scored), "id", "left")
        .select(
            "id",
            "email",
            F.coalesce("uploads", F.lit(0)).cast("long").alias("uploads"),
            _whole_mean(F.coalesce("points", F.lit(0.0)), F.coalesce("uploads", F.lit(0))).alias("avg_score"),
        )
        .orderBy(F.desc("uploads"), "id")
        .limit(n)
    )


def totals(datasets: DataFrame, users: DataFrame, rules: DataFrame, audit: DataFrame) -> DataFrame:
    """Row counts of the four tables side by side."""

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))

    counted = (
        one("datasets", datasets)
        .unionByName(one("users", users))
        .unionByName(one("rules", rules))
        .unionByName(one("activity", audit))
    )
    return counted.agg(
        *[F.max(F.when(F.col("name") == name, F.col("n"))).alias(f"total_{name}") for name in ("datasets", "users", "rules", "activity")]
    )


def display_name(full_name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(full_name, F.lit("")), F.split_part(email, F.lit("@"), F.lit(1)))


def user_stats(users: DataFrame, scored: DataFrame, search: str = "") -> DataFrame:
    """Per user: uploads, mean of scored datasets, activity and the five latest uploads."""
    needle = search.lower()
    name = display_name(F.col("full_name"), F.col("email"))
    people = users.withColumn("name", name).where(
        F.lower("name").contains(needle) | F.lower("email").contains(needle)
    )
    newest = pick_top(
        scored.where("uploaded_by is not null"),
        ["uploaded_by"],
        [F.desc("uploaded_at"), F.col("id")],
        TOP,
        "position",
    )
    recent = newest.groupBy(F.col("uploaded_by").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("position", F.col("id").alias("dataset_id")))).alias("picked")
    )
    uploads = F.coalesce("uploads", F.lit(0))
    return (
        people.join(_per_owner(scored), "id", "left")
        .join(recent, "id", "left")
        .select(
            "id",
            "name",
            "email",
            uploads.cast("long").alias("datasets_count"),
            _whole_mean(F.col("points"), F.col("scored")).alias("avg_score"),
            F.when(uploads > 0, "Recently").otherwise("Never").alias("last_active"),
            F.array_join(F.transform("picked", lambda p: p["dataset_id"].cast("string")), ",").alias("recent_uploads"),
        )
    )


def trend_pivot(scores: DataFrame, datasets: DataFrame, names: Iterable[str]) -> DataFrame:
    """Day by dataset name; the last score of a day wins, a missing score shows as 0.

    The names are given, so no extra job has to find them; one row per day and name
    is kept before the pivot.
    """
    names = list(names)
    wanted = datasets.where(F.col("name").isin(names)).select(F.col("id").alias("dataset_id"), "name")
    rows = scores.where("checked_at is not null").join(wanted, "dataset_id").withColumn("day", F.to_date("checked_at"))
    last = pick_one(rows, ["day", "name"], [F.desc("checked_at"), F.desc("id")])
    return last.groupBy("day").pivot("name", names).agg(F.max(F.coalesce("score", F.lit(0.0))))


def trend_stats(scores: DataFrame, audit: DataFrame) -> DataFrame:
    """Mean and best of the scores (missing ones as 0) and the number of runs in the audit log."""
    known = F.coalesce("score", F.lit(0.0))
    figures = scores.select(known.alias("score"), F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(
        audit.select(F.lit(None).cast("double").alias("score"), F.lit(0).alias("s"), F.lit(1).alias("r"))
    )
    return figures.agg(
        _whole_mean(_sum(F.col("score")), F.sum("s")).alias("avg"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("best"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("total"),
    )


def user_overview(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        _whole_mean(_sum(F.col("score")), F.count("score")).alias("avg_score"),
        F.coalesce(F.sum("total_rules"), F.lit(0)).cast("long").alias("rules_defined"),
        F.max("last_checked").alias("last_check"),
    )


def report_list(scores: DataFrame, datasets: DataFrame, users: DataFrame, search: str = "") -> DataFrame:
    """Scores with dataset name and owner. An unknown dataset is named by its id."""
    owners = users.select(F.col("id").alias("uploaded_by"), F.col("email").alias("owner"))
    known = datasets.select(F.col("id").alias("dataset_id"), "name", "uploaded_by").join(owners, "uploaded_by", "left")
    known = known.withColumn("user_email", F.coalesce("owner", F.lit(NO_OWNER))).select("dataset_id", "name", "user_email")
    needle = search.lower()
    return (
        scores.join(known, "dataset_id", "left")
        .select(
            *[scores[c] for c in scores.columns],
            F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Dataset #"), F.col("dataset_id"))).alias("dataset_name"),
            F.coalesce("user_email", F.lit(NO_DATASET)).alias("user_email"),
        )
        .where(F.lower("dataset_name").contains(needle) | F.lower("user_email").contains(needle))
    )


def rule_pass_percent(passed: Column, failed: Column) -> Column:
    return F.coalesce(nearest_int(percent(passed, passed + failed)), F.lit(0)).cast("long")


def rule_share(part: Column, total: Column) -> Column:
    """Percentage of a whole that counts as at least one."""
    return part.cast("double") / F.greatest(total, F.lit(1)).cast("double") * 100


def failed_samples(shown: DataFrame, rules: DataFrame, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """The first samples of each dataset's failing results, with rule name and reason.

    Expects rows of ``result_view``. Samples are taken in the order of the results.
    """
    names = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"))
    flat = shown.where("fail_count > 0").select(
        "dataset_id",
        "rule_id",
        F.col("id").alias("result_id"),
        F.coalesce(F.nullif("message", F.lit("")), F.lit(DEFAULT_REASON)).alias("reason"),
        F.posexplode("samples").alias("sample_pos", "data"),
    )
    top = pick_top(flat, ["dataset_id"], [F.col("result_id"), F.col("sample_pos")], limit, "position")
    return top.join(names, "rule_id").select("dataset_id", "position", "rule_name", "reason", "data")


def dataset_grid(
    datasets: DataFrame,
    users: DataFrame,
    search: str = "",
    user: str = "all",
    file_type: str = "all",
    status: str = "all",
) -> DataFrame:
    """Datasets with owner and type, filtered as in the administrator's grid."""
    owners = users.select(F.col("id").alias("uploaded_by"), F.col("email").alias("owner"))
    shown = datasets.join(owners, "uploaded_by", "left").select(
        "id",
        F.coalesce(
            F.nullif("name", F.lit("")),
            F.concat(F.lit("dataset_file_"), "id", F.lit("."), F.coalesce("file_type", F.lit("csv"))),
        ).alias("name"),
        F.coalesce("owner", F.lit(NO_OWNER)).alias("user"),
        F.upper(F.coalesce("file_type", F.lit("CSV"))).alias("type"),
        F.to_date("uploaded_at").alias("date"),
        "status",
    )
    needle = search.lower()
    shown = shown.where(F.lower("name").contains(needle) | F.lower("user").contains(needle))
    if user != "all":
        shown = shown.where(F.col("user") == user)
    if file_type != "all":
        shown = shown.where(F.col("type") == file_type)
    if status == "checked":
        shown = shown.where(~F.col("status").isin(UNCHECKED))
    elif status != "all":
        shown = shown.where(F.col("status") == "PENDING")
    return shown


def dataset_types(datasets: DataFrame) -> DataFrame:
    return datasets.select(F.upper(F.coalesce("file_type", F.lit("CSV"))).alias("type")).distinct()
