"""Threshold alerts with suppression until recovery.

An alert is active from the breach that raised it until a score meets the
threshold again. Each score either raises (breach with notifications on), clears
(no breach) or leaves the state alone (breach with notifications off); the state
before a score is set by the last raise or clear before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 80
# Fixed value: the reason given for a threshold that is not taken.
OUT_OF_BOUNDS = "Threshold must be between 0 and 100."
ALERT, RECOVERY = "ALERT", "RECOVERY"


def _versions(configs: DataFrame) -> DataFrame:
    """Settings as ``_dataset, _at, setting``. Without ``effective_from`` (or with a null
    one) a setting always held. Every setting of a dataset but the first is a change."""
    for column, default in (("effective_from", F.lit(None).cast("timestamp_ntz")), ("is_alert_active", F.lit(False))):
        if column not in configs.columns:
            configs = configs.withColumn(column, default)
    changes = Window.partitionBy("dataset_id").orderBy(F.asc_nulls_first("effective_from"), "threshold")
    setting = F.struct("threshold", "email_notifications", "is_alert_active", (F.row_number().over(changes) > 1).alias("changed"))
    return configs.select(F.col("dataset_id").alias("_dataset"), F.col("effective_from").alias("_at"), setting.alias("_setting"))


def _as_of(scores: DataFrame, configs: DataFrame, slice_by: str) -> DataFrame:
    """Scores and changes of settings as one timeline, each row with the setting that holds.

    Columns: those of ``scores``, ``_dataset``, ``_at`` (null first), ``_is_score``,
    ``_slice`` and ``_setting``. A change comes before the scores of its own instant.
    """
    kinds = {f.name: f.dataType for f in scores.schema.fields}
    shown = scores.where("score is not null").select("*", F.col("dataset_id").alias("_dataset"), F.col("checked_at").alias("_at"))
    versions = _versions(configs)
    if "effective_from" not in configs.columns:
        rows = shown.withColumn("_is_score", F.lit(True)).join(versions.drop("_at"), "_dataset")
        return rows.withColumn("_slice", F.date_trunc(slice_by, "_at"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    changes = versions.select(*nothing, "_dataset", F.col("_at").cast(kinds["checked_at"]).alias("_at"), F.lit(False).alias("_is_score"), F.col("_setting").alias("_own"))
    shown = shown.withColumn("_is_score", F.lit(True)).withColumn("_own", F.lit(None).cast(changes.schema["_own"].dataType))
    rows = shown.unionByName(changes).withColumn("_slice", F.date_trunc(slice_by, "_at"))
    return _carried(rows, "_own", "_setting", current=True).drop("_own").where("_setting is not null")


def _carried(rows: DataFrame, value: str, name: str, current: bool) -> DataFrame:
    """``rows`` with the last ``value`` that is not null before them, or up to them.

    A time slice leaves one value behind. These few are carried over the slices, and each
    slice then only needs its own rows, so that a dataset with very many is spread out.
    """
    when = F.struct(F.col("_at").isNotNull(), "_at", "_is_score", "id")
    ends = rows.groupBy("_dataset", "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), when)).alias("_left"))
    before = Window.partitionBy("_dataset").orderBy(F.asc_nulls_first("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_dataset", "_slice", F.last("_left", ignorenulls=True).over(before).alias("_carried"))
    time = [F.asc_nulls_first("_at"), F.col("_is_score"), F.asc_nulls_first("id")]
    within = Window.partitionBy("_dataset", "_slice").orderBy(*time).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    joined = rows.alias("r").join(carried.alias("c"), (F.col("r._dataset") == F.col("c._dataset")) & F.col("r._slice").eqNullSafe(F.col("c._slice")))
    return joined.select("r.*", "c._carried").withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within), "_carried")).drop("_carried")


def _effects(scores: DataFrame, configs: DataFrame, slice_by: str) -> DataFrame:
    """The timeline with ``_effect``: 1 raises, 0 clears, null leaves the state as it is.

    These maps of the two states onto themselves are closed under composition (a later
    raise or clear hides all before it), so any stretch of time is one of the three.
    """
    breach = F.col("score") < F.col("_setting.threshold")
    score = F.when(~breach, 0).when(breach & F.col("_setting.email_notifications"), 1)
    change = F.when(F.col("_setting.changed"), 0)
    return _as_of(scores, configs, slice_by).withColumn("_effect", F.when(F.col("_is_score"), score).otherwise(change))


def judged(scores: DataFrame, configs: DataFrame, slice_by: str = "day") -> DataFrame:
    """Scores of datasets that have a setting, with its threshold and the breach flag."""
    rows = _as_of(scores, configs, slice_by).where("_is_score")
    threshold = F.col("_setting.threshold")
    return rows.select(*scores.columns, threshold.alias("threshold"), F.col("_setting.email_notifications").alias("email_notifications"), (F.col("score") < threshold).alias("breach"))


def breaches(scores: DataFrame, configs: DataFrame) -> DataFrame:
    return judged(scores, configs).where("breach").select("id", "dataset_id", "score", "threshold", "checked_at")


def alert_events(scores: DataFrame, configs: DataFrame, slice_by: str = "day") -> DataFrame:
    """Alerts and recoveries: ``id, dataset_id, score, threshold, checked_at, event``.

    A change of a dataset's setting clears its alert without an event.
    """
    rows = _carried(_effects(scores, configs, slice_by), "_effect", "_before", current=False).where("_is_score")
    active = F.coalesce("_before", F.coalesce("_setting.is_alert_active", F.lit(False)).cast("int"))
    event = F.when((F.col("_effect") == 1) & (active == 0), ALERT).when((F.col("_effect") == 0) & (active == 1), RECOVERY)
    found = rows.withColumn("event", event).where("event is not null")
    return found.select("id", "dataset_id", "score", F.col("_setting.threshold").alias("threshold"), "checked_at", "event")


def alert_states(scores: DataFrame, configs: DataFrame, slice_by: str = "day") -> DataFrame:
    """State of every dataset with a judged score: ``dataset_id, active, set_from``.

    ``set_from`` is the start of the setting that its last score met (null: it always
    held); a later one has not taken effect yet. One row per dataset.
    """
    rows = _effects(scores, configs, slice_by)
    when = F.struct(F.col("_at").isNotNull(), "_at", "_is_score", "id")
    met = rows.groupBy("_dataset").agg(F.max(F.when(F.col("_is_score"), F.col("_at"))).alias("_last"))
    rows = rows.join(met, "_dataset").where("_last is not null and (_at is null or _at <= _last)")
    last = rows.groupBy("_dataset").agg(
        F.max_by("_effect", F.when(F.col("_effect").isNotNull(), when)).alias("effect"),
        F.max(F.when(~F.col("_is_score"), F.col("_at"))).alias("set_from"),
        F.max_by("_setting.is_alert_active", F.when(F.col("_is_score"), when)).alias("was"),
    )
    return last.select(F.col("_dataset").alias("dataset_id"), F.coalesce(F.col("effect") == 1, "was", F.lit(False)).alias("active"), "set_from")


def settings_from(configs: DataFrame, states: DataFrame) -> DataFrame:
    """``configs`` as they hold for scores that come after ``states``.

    A dataset's setting that the state has met goes on with the state's flag, for late
    scores too; earlier ones are over, later ones will still clear the flag.
    """
    if "effective_from" not in configs.columns:
        configs = configs.withColumn("effective_from", F.lit(None).cast("timestamp_ntz"))
    if "is_alert_active" not in configs.columns:
        configs = configs.withColumn("is_alert_active", F.lit(False))
    state = states.select("dataset_id", "active", F.col("set_from").cast(configs.schema["effective_from"].dataType).alias("set_from"), F.lit(True).alias("known"))
    joined = configs.join(state, "dataset_id", "left")
    since, met = F.col("effective_from"), F.col("set_from")
    same = F.col("known") & since.eqNullSafe(met)
    later = F.col("known").isNull() | since.isNotNull() & (met.isNull() | (since > met))
    return joined.where(same | later).select(
        "dataset_id",
        "threshold",
        "email_notifications",
        F.when(same, F.col("active")).otherwise(F.col("is_alert_active")).alias("is_alert_active"),
        F.when(~F.coalesce(same, F.lit(False)), since).alias("effective_from"),
    )


def alerts(scores: DataFrame, configs: DataFrame) -> DataFrame:
    return alert_events(scores, configs).where(F.col("event") == ALERT).drop("event")


def recoveries(scores: DataFrame, configs: DataFrame) -> DataFrame:
    return alert_events(scores, configs).where(F.col("event") == RECOVERY).drop("event")


def _lawful(threshold: Column) -> Column:
    return threshold.between(0, 100)


def rejected_thresholds(changes: DataFrame) -> DataFrame:
    """The changes that ``set_thresholds`` refuses, each with its reason."""
    refused = changes.where(F.col("threshold").isNotNull() & ~F.coalesce(_lawful(F.col("threshold")), F.lit(False)))
    return refused.select("dataset_id", "threshold", F.lit(OUT_OF_BOUNDS).alias("reject_reason"))


def set_thresholds(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of thresholds (80 when none is named); a changed dataset may alert again
    at once. Changes that ``rejected_thresholds`` lists are not applied."""
    wanted = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    lawful = changes.select("dataset_id", wanted.alias("_new")).where(_lawful(F.col("_new")))
    old = configs if "is_alert_active" in configs.columns else configs.withColumn("is_alert_active", F.lit(False))
    return old.join(lawful, "dataset_id", "full").select(
        "dataset_id",
        F.coalesce("_new", "threshold").alias("threshold"),
        F.coalesce("email_notifications", F.lit(True)).alias("email_notifications"),
        (F.col("_new").isNull() & F.coalesce("is_alert_active", F.lit(False))).alias("is_alert_active"),
    )


def set_thresholds_at(settings: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """``settings`` with the lawful ``changes`` as further versions that hold from ``at`` on.

    A dataset keeps its notifications (on, if it is new). Its alert is cleared by the new
    version, also when the threshold stays the same.
    """
    wanted = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    lawful = changes.select("dataset_id", wanted.cast(settings.schema["threshold"].dataType).alias("threshold")).where(_lawful(F.col("threshold")))
    newest = settings.groupBy("dataset_id").agg(F.max_by("email_notifications", F.struct(F.col("effective_from").isNotNull(), "effective_from")).alias("email_notifications"))
    added = lawful.join(newest, "dataset_id", "left").withColumn("email_notifications", F.coalesce("email_notifications", F.lit(True)))
    added = added.withColumn("effective_from", at.cast(settings.schema["effective_from"].dataType))
    return settings.unionByName(added, allowMissingColumns=True)


def alert_messages(
    raised: DataFrame, datasets: DataFrame, users: DataFrame, site: str = "", columns: Sequence[str] = ("id",)
) -> DataFrame:
    """Recipient (null without an owner), subject and text of each alert."""
    owners = users.select(F.col("id").alias("uploaded_by"), F.nullif("email", F.lit("")).alias("recipient"))
    named = datasets.select(F.col("id").alias("dataset_id"), "name", "uploaded_by")
    text = F.concat(
        F.lit("The quality score for dataset '"),
        F.col("name"),
        F.lit("' has dropped below the threshold.\n\nCurrent Score: "),
        F.col("score"),
        F.lit("\nThreshold: "),
        F.col("threshold"),
        F.lit(f"\n\nView the full report here: {site}/reports/"),
        F.col("dataset_id"),
    )
    return (
        raised.join(named, "dataset_id")
        .join(owners, "uploaded_by", "left")
        .select(
            *columns,
            "dataset_id",
            "recipient",
            F.concat(F.lit("Data Quality Alert: "), "name").alias("subject"),
            text.alias("message"),
        )
    )
