"""Reports, trends, visibility and audit queries over stored results and scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.keyed import pick_one
from truegauge.functions.timing import strict_day

# Fixed values of the paging and report rules.
PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
NEARBY_SECONDS = 5

NEWEST = ("checked_at", "id")


def _newest() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST]


# --- results ---------------------------------------------------------------


def check_results_for(results: DataFrame, dataset_id: int) -> DataFrame:
    return results.where(F.col("dataset_id") == dataset_id).orderBy(*_newest())


def _details_json(details: Column) -> Column:
    """Stored details as JSON text with bare NaN turned to null; null when not an object."""
    # The trailing context is kept, so that the word NaN inside a message stays.
    clean = F.regexp_replace(details, r"([:\[,]\s*)NaN(?=\s*[,\]}])", "$1null")
    return F.when(F.try_parse_json(clean).isNotNull() & F.trim(clean).startswith("{"), clean)


def result_view(results: DataFrame) -> DataFrame:
    """Results as shown: counts, message and sample rows (JSON text each).

    Manual runs store ``{message, samples}``; scheduled runs store the bare message.
    """
    parsed = F.from_json(_details_json(F.col("details")), "message STRING, samples ARRAY<STRING>")
    message = F.coalesce(parsed["message"], F.col("details"), F.lit(""))
    return results.select(
        *[c for c in ("report_id",) if c in results.columns],
        "id",
        "dataset_id",
        "rule_id",
        "passed",
        F.col("failed_rows").alias("fail_count"),
        (F.col("total_rows") - F.col("failed_rows")).alias("pass_count"),
        message.alias("message"),
        F.coalesce(parsed["samples"], F.array().cast("array<string>")).alias("samples"),
        "checked_at",
    )


# --- scores ----------------------------------------------------------------


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest score of every dataset."""
    return pick_one(scores, ["dataset_id"], _newest())


def latest_report(scores: DataFrame, dataset_id: int) -> DataFrame:
    return scores.where(F.col("dataset_id") == dataset_id).orderBy(*_newest()).limit(1)


def report_by_id(scores: DataFrame, datasets: DataFrame, report_id: int) -> DataFrame:
    names = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "uploaded_by")
    return scores.where(F.col("id") == report_id).join(names, "dataset_id")


def _nearby(scores: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the same dataset within five seconds of a score.

    Both sides carry a five-second slot, and the score is listed in its own slot and
    the two around it: the join is an equality on (dataset, slot), so a dataset
    with very many results is spread over its slots instead of one partition.
    """

    def slot(moment: Column) -> Column:
        return F.floor(F.unix_seconds(moment.cast("timestamp")) / NEARBY_SECONDS)

    around = scores.withColumn(
        "_slot", F.explode(F.sequence(slot(F.col("score_at")) - 1, slot(F.col("score_at")) + 1))
    )
    near = results.withColumn("_slot", slot(F.col("checked_at"))).withColumnRenamed("dataset_id", "_dataset")
    reach = F.expr(f"INTERVAL {NEARBY_SECONDS} SECONDS")
    return (
        around.join(
            near,
            (F.col("dataset_id") == F.col("_dataset"))
            & (around["_slot"] == near["_slot"])
            & F.col("checked_at").between(F.col("score_at") - reach, F.col("score_at") + reach),
        )
        .drop("_slot", "_dataset")
    )


def score_results(scores: DataFrame, results: DataFrame) -> DataFrame:
    """Results of each score: those linked to it or, when it has none, those nearby in time."""
    heads = scores.select(F.col("id").alias("report_id"), "dataset_id", F.col("checked_at").alias("score_at"))
    columns = ["id", "dataset_id", "rule_id", "passed", "failed_rows", "total_rows", "details", "checked_at"]
    linked = results.select(F.col("quality_score_id").alias("report_id"), *columns)
    own = linked.join(heads.select("report_id"), "report_id", "left_semi")
    bare = heads.join(linked.select("report_id").distinct(), "report_id", "left_anti")
    near = _nearby(bare, results.select(*columns)).select("report_id", *columns)
    return own.unionByName(near)


def dataset_reports(scores: DataFrame, datasets: DataFrame, results: DataFrame) -> DataFrame:
    """Full report of every dataset's latest score, one row per result.

    The header repeats on each row; a report without results keeps one row.
    """
    newest = latest_scores(scores)
    head = newest.select(
        F.col("id").alias("report_id"),
        "dataset_id",
        "score",
        "total_rules",
        "passed_rules",
        "failed_rules",
        F.col("checked_at").alias("report_at"),
    ).join(
        datasets.select(
            F.col("id").alias("dataset_id"),
            F.col("name").alias("dataset_name"),
            parse_columns(F.col("column_names")).alias("columns"),
        ),
        "dataset_id",
    )
    shown = result_view(score_results(newest, results)).drop("dataset_id").withColumnRenamed("id", "result_id")
    # An inner join can split the results of one very large report over several tasks;
    # an outer one could not. Reports without results are added afterwards.
    full = head.join(shown, "report_id")
    bare = head.join(shown.select("report_id").distinct(), "report_id", "left_anti")
    return full.unionByName(bare, allowMissingColumns=True)


# --- trends ----------------------------------------------------------------


def _in_days(scores: DataFrame, start: str | None, end: str | None) -> DataFrame:
    day = F.to_date("checked_at")
    if start:
        scores = scores.where(day >= F.lit(strict_day(start)))
    if end:
        scores = scores.where(day <= F.lit(strict_day(end)))
    return scores


def trends(scores: DataFrame, dataset_id: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Scores of one dataset, oldest first; both days inclusive."""
    return _in_days(scores.where(F.col("dataset_id") == dataset_id), start, end).orderBy("checked_at", "id")


def bulk_trends(
    scores: DataFrame, datasets: DataFrame | Iterable[int], start: str | None = None, end: str | None = None
) -> DataFrame:
    """Scores of several datasets; ``datasets`` is a table with ``id`` or a list of ids."""
    if isinstance(datasets, DataFrame):
        chosen = scores.join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    else:
        chosen = scores.where(F.col("dataset_id").isin(list(datasets)))
    return _in_days(chosen, start, end)


def missing_ids(requested: DataFrame, visible_datasets: DataFrame) -> DataFrame:
    return requested.select("id").distinct().join(visible_datasets.select("id"), "id", "left_anti")


def dashboard_summary(datasets: DataFrame, scores: DataFrame) -> DataFrame:
    """Latest score per dataset; never-checked datasets appear with nulls."""
    newest = latest_scores(scores).withColumnRenamed("id", "score_id")
    return (
        datasets.select(F.col("id").alias("dataset_id"))
        .join(newest, "dataset_id", "left")
        .select("dataset_id", "score_id", "score", "total_rules", "passed_rules", "failed_rules", "checked_at")
    )


# --- visibility, lists, audit ----------------------------------------------


def visible(datasets: DataFrame, user_id: int, role: str = "USER") -> DataFrame:
    """Administrators see everything, others their own."""
    return datasets if role == "ADMIN" else datasets.where(F.col("uploaded_by") == user_id)


def list_datasets(datasets: DataFrame, user_id: int, role: str = "USER", uploaded_by: int | None = None) -> DataFrame:
    """Visible datasets, newest first; administrators may narrow to one uploader."""
    shown = visible(datasets, user_id, role)
    if role == "ADMIN" and uploaded_by is not None:
        shown = shown.where(F.col("uploaded_by") == uploaded_by)
    return shown.orderBy(F.desc("uploaded_at"), "id")


def audit_log(
    audit: DataFrame,
    datasets: DataFrame,
    dataset_id: int | None = None,
    since: object = None,
    until: object = None,
) -> DataFrame:
    """Audit rows with dataset names, newest first; the bounds are full timestamps."""
    kind = audit.schema["timestamp"].dataType
    if dataset_id is not None:
        audit = audit.where(F.col("dataset_id") == dataset_id)
    if since is not None:
        audit = audit.where(F.col("timestamp") >= F.lit(since).cast(kind))
    if until is not None:
        audit = audit.where(F.col("timestamp") <= F.lit(until).cast(kind))
    names = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return audit.join(names, "dataset_id").orderBy(F.desc("timestamp"), F.desc("id"))


def paginate(df: DataFrame, page: int, limit: int = PAGE_SIZE, order: Iterable[Column | str] = ("id",)) -> DataFrame:
    """One page in a total order, each row with the ``total`` number of rows."""
    size = min(max(limit, 1), MAX_PAGE_SIZE)
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", total)


def parse_columns(text: Column, lenient: bool = False) -> Column:
    """Column names stored as text.

    A JSON list is read as such, other text is one name. ``lenient`` follows the
    client: single quotes count as double ones, and text that is still no JSON is
    split at commas.
    """
    empty = F.array().cast("array<string>")
    source = F.replace(text, F.lit("'"), F.lit('"')) if lenient else text
    as_list = F.when(
        F.try_parse_json(source).isNotNull() & F.trim(source).startswith("["), F.from_json(source, "array<string>")
    )
    if lenient:
        parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
        other = F.when(F.try_parse_json(source).isNotNull(), empty).otherwise(F.filter(parts, lambda p: p != ""))
    else:
        other = F.array(text)
    return F.when(text.isNull() | (text == ""), empty).otherwise(F.coalesce(as_list, other))
