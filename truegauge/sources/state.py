"""Watermark state and the run log, as small Parquet tables.

State rows are only appended and the newest counts, so a run that dies while
writing leaves the previous state in force.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from truegauge.functions.timing import parse_watermark
from truegauge.session import path_exists

STATE_SCHEMA = (
    "high_watermark STRING, last_run_id STRING, last_successful_run STRING, saved_at TIMESTAMP, "
    "source_rows BIGINT, rows_at_mark BIGINT"
)
RUN_LOG_SCHEMA = (
    "run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, mode STRING, records_extracted BIGINT, "
    "records_loaded BIGINT, duplicates_removed BIGINT, duration_seconds DOUBLE, error_message STRING"
)


@dataclass(frozen=True)
class State:
    high_watermark: datetime | None = None
    last_run_id: str | None = None
    last_successful_run: str | None = None
    #: Source rows seen so far, and how many of them lie on the watermark itself.
    source_rows: int | None = None
    rows_at_mark: int | None = None


def load_state(spark: SparkSession, path: str) -> State:
    """Newest stored state; an absent or unreadable table is an empty state."""
    if not path_exists(spark, path):
        return State()
    try:
        row = spark.read.schema(STATE_SCHEMA).parquet(path).orderBy(F.desc("saved_at")).limit(1).first()
    except AnalysisException:
        return State()
    if row is None:
        return State()
    return State(
        parse_watermark(row["high_watermark"]),
        row["last_run_id"],
        row["last_successful_run"],
        row["source_rows"],
        row["rows_at_mark"],
    )


def save_state(spark: SparkSession, path: str, state: State) -> None:
    mark = state.high_watermark.isoformat() if state.high_watermark else None
    row = (
        mark,
        state.last_run_id,
        state.last_successful_run,
        datetime.now(timezone.utc),
        state.source_rows,
        state.rows_at_mark,
    )
    spark.createDataFrame([row], STATE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    names = [part.split()[0] for part in RUN_LOG_SCHEMA.split(", ")]
    row = tuple(run.get(name) for name in names)
    spark.createDataFrame([row], RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
