"""The star schema of a data folder, loaded once per application.

Dashboards read stored tables: facts partitioned by day, dimensions, and the daily
aggregate. The first query that needs them runs the load into the shared scratch
folder; later ones only read.
"""

from __future__ import annotations

import threading

from truegauge.operators.extract import base_extract, dimension_extract
from truegauge.operators.load import StarStore
from truegauge.operators.star import build_star
from truegauge.plans.history import Inputs
from truegauge.session import scratch_dir

_lock = threading.Lock()
_stores: dict[tuple[str, str], str] = {}


def stored(i: Inputs) -> StarStore:
    """Loaded star schema of the inputs."""
    key = (i.spark.sparkContext.applicationId, i.folder)
    with _lock:
        if key not in _stores:
            root = scratch_dir(i.spark, "star")
            StarStore(i.spark, root).load(build_star(base_extract(i.history), dimension_extract(i.history)))
            _stores[key] = root
    return StarStore(i.spark, _stores[key])
