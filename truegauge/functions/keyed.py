"""Per-key picks and joins that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys joined by broadcast. Whatever the data, at most this many are sent, and any
# key left over holds less than 1/1000 of the rows, so its partition stays small.
HEAVY_KEYS = 1000


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    ``row_number() = 1`` lets Spark keep one row per key and task before the
    shuffle, so a hot key costs one row per task rather than all its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def pick_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows of each key, numbered from 1 in ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def semi_join_by_count(rows: DataFrame, counted: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Rows whose (null-safe) key appears in ``counted``, one line per key there.

    The heaviest keys are matched by broadcast and never shuffled; the remaining
    rows are shuffled on the key. Both halves are complete: no key is dropped.
    """
    heavy = counted.orderBy(F.desc(count), *keys).limit(HEAVY_KEYS).select(*keys)
    rows, counted = rows.alias("r"), counted.select(*keys).alias("c")
    heavy = F.broadcast(heavy.alias("h"))

    def on(other: str) -> Column:
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(f"r.`{k}`").eqNullSafe(F.col(f"{other}.`{k}`"))
        return condition

    hot = rows.join(heavy, on("h"), "left_semi")
    rest = rows.join(heavy, on("h"), "left_anti").alias("r")
    return hot.unionByName(rest.join(counted, on("c"), "left_semi"))
