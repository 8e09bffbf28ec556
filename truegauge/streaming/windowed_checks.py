"""Checks over a stream, one verdict per dataset and time window."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.operators.checks import run_checks_by
from truegauge.operators.rules import Rule


def stream_checks(
    rows: DataFrame,
    rules: Iterable[Rule],
    keys: Sequence[str],
    event_time: str,
    width: str = "1 day",
    lateness: str = "1 day",
) -> DataFrame:
    """Results per key and tumbling window, emitted once the window is complete.

    The expressions are those of the batch checks. Row-wise rules keep one counter
    per rule in the state, so state grows with keys and open windows only. UNIQUE
    keeps one counter per distinct value of an open window, then adds them up in a
    second stateful step; use it in append mode.
    """
    timed = rows.withWatermark(event_time, lateness).withColumn("window", F.window(event_time, width))
    return run_checks_by(timed, rules, ["window", *keys])
