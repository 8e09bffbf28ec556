"""Alert suppression over a stream of scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from truegauge.operators.alerts import alert_events, alert_states, settings_from

STATE_SCHEMA = "dataset_id BIGINT, active BOOLEAN, set_from TIMESTAMP_NTZ"


def stream_alerts(
    scores: DataFrame,
    configs: DataFrame | Callable[[], DataFrame],
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Alerts and recoveries of a score stream, written under ``root/events``.

    ``configs`` may hold several settings per dataset, each from its ``effective_from``
    on. A function is asked anew for every micro-batch, so settings made while the stream
    runs count. The state is one row per dataset: its flag, and the setting its last score
    met. Scores that come after a later setting has been met are judged by that one.

    Every micro-batch runs the batch operator from the state that the previous one left.
    Each batch writes its events and state to folders of its own number, so repeating it
    after a failure replaces them and nothing is raised twice. A dataset with very many
    scores is spread over time slices, as in batch; a keyed state function would hold all
    its rows of the batch in one task.
    """
    spark = scores.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if number == 0:
            states = spark.createDataFrame([], STATE_SCHEMA)
        else:
            states = spark.read.schema(STATE_SCHEMA).parquet(f"{root}/state/batch={number - 1}")
        current = settings_from(configs() if callable(configs) else configs, states)
        alert_events(batch, current).write.mode("overwrite").parquet(f"{root}/events/batch={number}")
        met = alert_states(batch, current)
        # A setting that goes on from the state has no start of its own in this batch.
        new = met.select("dataset_id", F.col("active").alias("_active"), F.col("set_from").cast("timestamp_ntz").alias("_from"))
        both = states.join(new, "dataset_id", "full")
        both.select(
            "dataset_id", F.coalesce("_active", "active").alias("active"), F.coalesce("_from", "set_from").alias("set_from")
        ).write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    return (
        scores.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
