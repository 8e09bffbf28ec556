"""Sharding by Karmarkar-Karp differencing: shards of near equal bytes, equal texts together.

A group (all documents of one text) is an item that stays whole. Differencing starts with
one partial partition per item, a tuple of shard sums of which one is not zero, and
repeatedly combines the two of largest spread, the largest sums of one with the smallest
of the other, until one is left.

How it runs over many groups:

1. Groups are summed by hash of their text, on the map side first, so copies of a text
   travel as one row per task.
2. Groups larger than 1 / ``LARGE`` of a shard's mean are few, at most ``LARGE`` times
   the number of shards. They are partitioned first, in one task.
3. The others are dealt by hash to buckets of about ``BUCKET`` groups. Each bucket starts
   with its share of the large groups' sums as one more partial partition, in proportion
   to its bytes, and differences it away together with its own groups. So each bucket
   fills the shards that the large groups leave short, all buckets at once.
4. Each group hands its shard to its documents, which are numbered per shard: in the
   tasks that hold them, then with offsets per task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.shared import stored, tasks_for

SHARDS = 40
#: Bytes that a document counts beside its text.
OVERHEAD = 16
#: Groups of a bucket, and the parts of a shard's mean from which on a group is large.
BUCKET, LARGE = 5000, 100


def difference(sizes: np.ndarray, shards: int, start: np.ndarray | None = None) -> np.ndarray:
    """The shard of each size by largest differencing.

    ``start`` are sums already in shards 0, 1, 2 and so on, one more partial partition
    that keeps its shards' names. Equal spreads are taken in order of the items, the
    start first.
    """
    n = len(sizes)
    first = [np.zeros(shards, np.int64) if start is None else np.asarray(start, np.int64)]
    # A partial partition is its sums in ascending order; of two that are combined, place i
    # of the new one is place left[i] of the one and place right[i] of the other.
    order = np.argsort(first[0], kind="stable")
    sums: dict[int, np.ndarray] = {0: first[0][order]}
    heap = [(-int(sums[0][-1] - sums[0][0]), 0)]
    for i, size in enumerate(np.asarray(sizes, np.int64).tolist(), 1):
        one = np.zeros(shards, np.int64)
        one[-1] = size
        sums[i] = one
        heap.append((-size if shards > 1 else 0, i))
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        left = np.argsort(both, kind="stable")
        name = n + 1 + len(made)
        made.append((a, b, left, shards - 1 - left))
        sums[name] = both[left]
        heapq.heappush(heap, (-int(sums[name][-1] - sums[name][0]), name))
    # Downwards from the last: which shard each place of a partial partition has become.
    shard_of: dict[int, np.ndarray] = {heap[0][1]: np.arange(shards)}
    for k in range(len(made) - 1, -1, -1):
        a, b, left, right = made[k]
        own = shard_of.pop(n + 1 + k)
        for child, places in ((a, left), (b, right)):
            shard_of[child] = np.empty(shards, np.int64)
            shard_of[child][places] = own
    # The start's places have the names they came with; without one any naming will do.
    name = np.empty(shards, np.int64)
    name[shard_of[0]] = order
    return np.array([name[shard_of[i][-1]] for i in range(1, n + 1)], np.int64)


def _partition(groups: DataFrame, shards: int, total: int, loads: list[int]) -> DataFrame:
    """``groups`` (bucket, group, size), each bucket by differencing, to (group, size, shard)."""

    def place(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("size", "descending"), ("group", "ascending")])
        sizes = bucket.column("size").to_numpy()
        own = int(sizes.sum())
        start = np.array([x * own // max(1, total) for x in loads], np.int64)
        return pa.table({"group": bucket.column("group"), "size": sizes, "shard": difference(sizes, shards, start)})

    return groups.groupBy("bucket").applyInArrow(place, "group long, size long, shard long")


def assign(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, large: int = LARGE) -> DataFrame:
    """``groups`` (group long, size long, each group once) to rows (group, size, shard).

    The largest shard exceeds the mean only by what single groups force, plus the few
    bytes that differencing leaves in each bucket. An empty table gives an empty table.
    """
    whole = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    is_large = F.col("size") * (shards * large) > F.lit(int(whole["bytes"]))
    few = stored(_partition(groups.where(is_large).withColumn("bucket", F.lit(0)), shards, 1, [0] * shards), "large-groups")
    loads = [0] * shards
    # One row per shard.
    for r in few.groupBy("shard").agg(F.sum("size").alias("load")).collect():
        loads[r["shard"]] = int(r["load"])
    buckets = tasks_for(int(whole["n"]), bucket)
    many = groups.where(~is_large).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    return few.unionByName(_partition(many, shards, int(whole["bytes"]) - sum(loads), loads))


def _numbered(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 and so on in each shard, in the order of the tasks' rows."""
    schema = T.StructType([*rows.schema.fields, T.StructField("task", T.LongType()), T.StructField("nth", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            many = np.bincount(shard, minlength=shards)
            nth = np.empty(len(shard), np.int64)
            nth[order] = np.arange(len(shard)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen, many)
            seen += many
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], schema.fieldNames())

    counted = stored(rows.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(count, schema), "shard-rows")
    # A row per task and shard.
    sizes = counted.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return counted.join(starts, ["task", "shard"]).withColumn("slot", F.col("first") + F.col("nth")).drop("task", "nth", "first")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, bucket: int = BUCKET, large: int = LARGE) -> DataFrame:
    """One row per document: key, size, text_crc32, shard and slot.

    ``size`` is the text's bytes in UTF-8 and ``OVERHEAD``; a null text has none and goes
    with the empty ones. Equal texts are in one shard. Slots count up from 0 without gaps
    in each shard. Repeated rows and null keys are documents of their own. Columns beside
    key and text are not used. An empty table gives an empty table.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Two texts of one hash would merely stay together.
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("group"))
    rows = stored(rows, "sharding")
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("size")), "groups")
    placed = stored(assign(groups, shards, bucket, large), "placed")
    joined = rows.join(placed.select("group", F.col("shard")), "group").drop("group")
    numbered = _numbered(joined.select("key", "size", "text_crc32", "shard"), shards)
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
