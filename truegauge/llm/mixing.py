"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a hashed order, are cut into blocks of ``BLOCK`` characters.
Block k of a source of weight w may run from slot floor(k / w) on and has to run before
slot ceil((k + 1) / w). One block runs in each slot, the released one of the earliest
deadline; as the weights add up to one, all deadlines are met, so after any number of
slots t every source has had fewer than one block more or less than w * t, until it has
none left. Its slots then stay idle and the others go on as before.

Weights are whole multiples of 1 / ``PERIOD``, so the schedule repeats after that many
slots: one period is laid out once, as a small table, and every block finds its slot by
division. Block numbers are running sums over hash buckets of bounded size, so a source
that holds a third of all rows is still many groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegauge.llm.shared import fresh, stored, tasks_for

BLOCK, PERIOD, BUCKET = 65_536, 1000, 20_000
#: Without given weights a source weighs its size to this power.
TEMPERATURE = 0.7


def whole_shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole numbers of slots, one at least, that add up to the period.

    The period grows with the number of sources, so that small weights stay exact enough.
    """
    period = max(period, 20 * len(weights))
    total = sum(weights.values())
    exact = {s: max(1.0, period * w / total) for s, w in weights.items()}
    scale = period / sum(exact.values())
    shares = {s: max(1, int(e * scale)) for s, e in exact.items()}
    rest = sorted(shares, key=lambda s: (shares[s] - exact[s] * scale, s))
    missing = period - sum(shares.values())
    for i in range(abs(missing)):
        if missing > 0:
            shares[rest[i % len(rest)]] += 1
        else:
            shares[max(shares, key=lambda s: (shares[s], s))] -= 1
    return shares


def one_period(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, k, slot, release, deadline) of every slot of a period, earliest deadline first."""
    period = sum(shares.values())

    def window(source: str, k: int) -> tuple[int, int]:
        return k * period // shares[source], -(-(k + 1) * period // shares[source])

    waiting = [(window(s, 0)[0], s, 0) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, k)[1], s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, slot, release, deadline))
        if k + 1 < shares[s]:
            heapq.heappush(waiting, (window(s, k + 1)[0], s, k + 1))
    return out


def _name(source: str):
    """A source as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _schedule(rows: DataFrame, weights: dict[str | None, float] | None, block: int, period: int) -> DataFrame:
    """``rows`` (row, name, size) with block, slot, release, deadline and place in the block."""
    spark = rows.sparkSession
    sizes = {r["name"]: (r["n"], float(r["chars"])) for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).collect()}
    if weights is None:
        target = {s: (chars + n) ** TEMPERATURE for s, (n, chars) in sizes.items()}
    else:
        given = {"" if s is None else f"={s}": float(w) for s, w in weights.items()}
        least = min([w for w in given.values() if w > 0], default=1.0)
        target = {s: given.get(s) or least for s in sizes}
    shares = whole_shares(target, period) if sizes else {}
    slots = spark.createDataFrame(one_period(shares), "name string, k long, at long, release long, deadline long")
    lengths = spark.createDataFrame(list(shares.items()), "name string, share long")
    total = sum(shares.values())

    buckets = tasks_for(sum(n for n, _ in sizes.values()), BUCKET)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sums = dealt.groupBy("name", "bucket").agg(F.sum("size").alias("sum"))
    by_source = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("name", "bucket", F.coalesce(F.sum("sum").over(by_source), F.lit(0)).alias("start"))
    by_bucket = Window.partitionBy("name", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("before", F.coalesce(F.sum("size").over(by_bucket), F.lit(0)))
    placed = inside.join(starts, ["name", "bucket"]).withColumn("begin", F.col("start") + F.col("before"))
    placed = placed.withColumn("block", F.floor(F.col("begin") / block))
    placed = placed.join(F.broadcast(lengths), "name").withColumn("k", F.col("block") % F.col("share"))
    # The period table has one row per slot of a period, whatever the size of the input.
    timed = placed.join(F.broadcast(slots), ["name", "k"]).withColumn("round", F.floor(F.col("block") / F.col("share")) * total)
    return timed.select("row", "block", *[(F.col("round") + F.col(c)).alias(n) for c, n in (("at", "slot"), ("release", "release"), ("deadline", "deadline"))], F.col("begin").alias("place"))


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """One row per document: key, source, block, slot, release, deadline and place.

    ``place`` is the document's character offset in its source and orders a block. Every
    row is scheduled once, repeated rows too. A null source is a source of its own; a
    source without a given weight, or with none above zero, has the least given one. Null
    texts have no length. A document longer than a block leaves slots idle behind it.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), _name(source).alias("name"), size.alias("size"), F.monotonically_increasing_id().alias("row")), "mixing")
    found = _schedule(rows.select("row", "name", "size"), weights, block, period)
    return rows.join(found, "row").select(F.col("key").alias(key), F.col("source").alias(source), "block", "slot", "release", "deadline", "place")


def interleaved(docs: DataFrame, text: str = "text", source: str = "source", weights: dict[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``docs`` in the order of the schedule: by slot across files, sorted inside them."""
    row, slot, place = fresh(docs, "_row"), fresh(docs, "_slot"), fresh(docs, "_place")
    marked = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixing")
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    found = _schedule(marked.select(F.col(row).alias("row"), _name(source).alias("name"), size.alias("size")), weights, block, period)
    found = found.select(F.col("row").alias(row), F.col("slot").alias(slot), F.col("place").alias(place))
    return marked.join(found, row).repartitionByRange(slot, place).sortWithinPartitions(slot, place).select(docs.columns)
