"""Pages by key: the next page after a row, and jumps through an index of page starts.

``OFFSET`` sorts everything before a page to reach it. With a total order over columns
without nulls, the rows after a known key, or between two of them, are a plain filter on
those columns, which reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegauge.session import scratch_dir


def _after(df: DataFrame, order: Sequence[str], key: Sequence[object], equal: bool) -> Column:
    """Whether a row comes behind ``key`` in the order, or is it if ``equal``."""
    values = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, key)]
    ways = []
    for n, column in enumerate(order):
        last = n == len(order) - 1
        step = F.col(column) >= values[n] if equal and last else F.col(column) > values[n]
        ways.append(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(order[:n], values)], F.lit(True)) & step)
    # Implied by the rest, and simple enough for the scan's statistics.
    return (F.col(order[0]) >= values[0]) & reduce(lambda a, b: a | b, ways)


def page_after(df: DataFrame, order: Sequence[str], size: int, last: Sequence[object] | None = None) -> DataFrame:
    """The ``size`` rows that follow the row of key ``last``; the first ones without it.

    A top-k per task and no more, whatever lies before.
    """
    rows = df if last is None else df.where(_after(df, order, last, equal=False))
    return rows.orderBy(*order).limit(size)


@dataclass(frozen=True)
class PageIndex:
    """First key of every page (``page``, the order columns) and the total number of rows."""

    starts: DataFrame
    order: tuple[str, ...]
    size: int
    total: int

    def page(self, df: DataFrame, number: int) -> DataFrame:
        """Page ``number`` (from 1) of the rows that were indexed; rows added since show
        on the page whose keys they fall between. Empty beyond the last page."""
        found = {r["page"]: r for r in self.starts.where(F.col("page").isin(number, number + 1)).collect()}
        if number not in found:
            return df.where(F.lit(False))
        rows = df.where(_after(df, self.order, [found[number][c] for c in self.order], equal=True))
        if number + 1 in found:
            rows = rows.where(~_after(df, self.order, [found[number + 1][c] for c in self.order], equal=True))
        return rows.orderBy(*self.order)


def page_index(df: DataFrame, order: Sequence[str], size: int) -> PageIndex:
    """The index of ``df``: its keys are sorted once, by ranges over all tasks.

    Places come from the place within a range and the rows of the ranges before it, so
    nothing passes through one task but a number per range.
    """
    path = scratch_dir(df.sparkSession, "page-index")
    keys = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    keys.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranges.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    place = F.col("_first") + F.col("_at") - F.shiftleft("_range", 33)
    starts = placed.join(firsts, "_range").withColumn("_place", place).where(F.col("_place") % size == 0)
    stored = f"{path}-starts"
    starts.select((F.col("_place") / size + 1).cast("long").alias("page"), *order).write.parquet(stored)
    total = placed.count()
    return PageIndex(df.sparkSession.read.parquet(stored), tuple(order), size, total)
