"""Continuous load of check results into the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from truegauge.operators.extract import History, base_extract, dimension_extract
from truegauge.operators.load import LoadSummary, StarStore
from truegauge.operators.star import build_star

MARK_SCHEMA = "mark TIMESTAMP"


def stream_history(
    results: DataFrame,
    rules: DataFrame,
    datasets: DataFrame,
    store: StarStore,
    checkpoint: str,
    lateness: str = "2 days",
    trigger: dict | None = None,
    compact_every: int = 20,
) -> StreamingQuery:
    """Each micro-batch is joined, transformed and loaded like an incremental run.

    Rows older than the newest event time of earlier batches less ``lateness`` would touch
    days long settled. They are kept in a side table, ``late/batch=<n>`` under the store,
    until ``merge_late`` loads them. The load ignores facts already present, so a batch or
    a row that is delivered again changes nothing, and the stream needs no state but one
    time per batch. After every ``compact_every`` batches, days of many small files are
    compacted.
    """
    spark, root = results.sparkSession, store.root

    def load(batch: DataFrame, number: int) -> None:
        mark = _mark(spark, root, number - 1)
        late = F.col("checked_at") <= F.lit(mark).cast("timestamp") if mark is not None else F.lit(False)
        late = F.coalesce(late, F.lit(False))
        # One read of the batch; its parts and its newest time come from the written copy.
        folder = f"{root}/_stream/batch={number}"
        batch.withColumn("_late", late).write.mode("overwrite").parquet(folder)
        rows = spark.read.parquet(folder)
        newest = rows.agg(F.max("checked_at").cast("timestamp") - F.expr(f"interval {lateness}")).first()[0]
        settled = max((t for t in (mark, newest) if t is not None), default=None)
        rows.where("_late").drop("_late").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        fresh = rows.where("not _late").drop("_late")
        if not fresh.isEmpty():
            part = History(fresh, rules, datasets)
            store.load(build_star(base_extract(part), dimension_extract(part)))
        if (number + 1) % compact_every == 0 and store.exists("fact_quality_checks"):
            store.compact()
        spark.createDataFrame([(settled,)], MARK_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/_marks/batch={number}")

    return (
        results.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _mark(spark: SparkSession, root: str, number: int):
    """Up to where everything counted as settled after batch ``number``."""
    if number < 0:
        return None
    return spark.read.schema(MARK_SCHEMA).parquet(f"{root}/_marks/batch={number}").first()["mark"]


def merge_late(store: StarStore, rules: DataFrame, datasets: DataFrame) -> LoadSummary:
    """Load the rows that came too late for the stream; only their days are read.

    Rows loaded before are skipped, so nothing need be removed and a second merge adds
    nothing. The stream may go on meanwhile.
    """
    late = store.spark.read.parquet(f"{store.root}/late").drop("batch")
    part = History(late, rules, datasets)
    return store.load(build_star(base_extract(part), dimension_extract(part)))
