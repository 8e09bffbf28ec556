"""SimHash near-duplicates by vantage-point trees over Hamming distance.

1. Every whole text becomes a 64-bit fingerprint; equal fingerprints are one point.
2. The top of a vantage-point tree is built from a bounded sample: each node holds a
   vantage fingerprint and the median distance to it. Every point owns exactly one leaf
   (shard). By the triangle inequality a point whose distance to the vantage is within
   ``max_bits`` of the median may have partners on both sides, so it also visits the
   shards with a higher number that it may overlap.
3. Each shard is one group: it goes on as a tree down to small leaves, where owners are
   compared with owners and visitors bit by bit. No pair within ``max_bits`` is missed
   and none beyond it is linked. A shard hands on a star forest, not its pairs.
4. The forests of all shards are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.shared import Forest, components, fresh, stored

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Points of a shard, on average; leaves inside a shard; shingles counted at a time.
SHARD, LEAF, BLOCK = 16384, 256, 65536
#: The top tree has at most 2**MAX_DEPTH leaves (16 bytes a node); larger inputs have
#: larger shards, which the tree inside a shard splits on.
MAX_DEPTH = 18
#: Sampled points for each leaf of the top tree.
SAMPLE = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    size = min(shingle, len(words))
    ends = (starts + length)[size - 1 :]
    n = len(ends)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(at + BLOCK, n)].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([digest(flat[s:e], SEED) for s, e in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long column."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="uint64").astype("int64")

    return docs.withColumn(name, of(F.col(text)))


def _distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def _choose(points: np.ndarray) -> tuple[int, int]:
    """A vantage that spreads the points, and the median distance to it."""
    tried = points[:: max(1, len(points) // 8)][:8]
    vantage = max(tried.tolist(), key=lambda v: (_distance(points, v).std(), v))
    return vantage, int(np.median(_distance(points, vantage)))


def top_tree(sample: np.ndarray, depth: int) -> np.ndarray:
    """Nodes in heap order (root 1): vantage and median; median -1 marks a leaf."""
    nodes = np.zeros((2 ** (depth + 1), 2), np.uint64)
    median = np.full(len(nodes), -1, np.int64)
    parts = {1: sample}
    for node in range(1, 2**depth):
        points = parts.pop(node, np.empty(0, np.uint64))
        if len(points) < 8:
            continue
        vantage, mid = _choose(points)
        far = _distance(points, vantage) > mid
        if far.all() or not far.any():
            continue
        nodes[node, 0], median[node] = vantage, mid
        parts[2 * node], parts[2 * node + 1] = points[~far], points[far]
    nodes[:, 1] = median.view(np.uint64)
    return nodes


def route(points: np.ndarray, tree: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, owner?) for each shard that a point belongs to or visits."""
    median = tree[:, 1].view(np.int64)
    index, node, own = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(index):
        leaf = median[node] < 0
        done.append((index[leaf], node[leaf], own[leaf]))
        index, node, own = index[~leaf], node[~leaf], own[~leaf]
        gap = np.bitwise_count(points[index] ^ tree[node, 0]).astype(np.int64) - median[node]
        near = gap <= 0
        # The far side is always numbered higher: owners only visit upwards.
        stay_near, to_far = own & near | ~own & (gap <= max_bits), np.where(own, ~near, gap > -max_bits)
        visit_far = own & near & (gap > -max_bits)
        index, node, own = (
            np.concatenate([index[stay_near], index[to_far], index[visit_far]]),
            np.concatenate([2 * node[stay_near], 2 * node[to_far] + 1, 2 * node[visit_far] + 1]),
            np.concatenate([own[stay_near], own[to_far], np.zeros(int(visit_far.sum()), bool)]),
        )
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (index, node, own)


def shard_links(own: np.ndarray, visitors: np.ndarray, max_bits: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of all pairs owner-owner and visitor-owner within ``max_bits``."""
    forest = Forest()
    work = [(own, visitors)]
    while work:
        mine, guests = work.pop()
        if not len(mine):
            continue
        if len(mine) > leaf:
            vantage, mid = _choose(mine)
            d = _distance(mine, vantage)
            near = d <= mid
            if near.any() and not near.all():
                g = _distance(guests, vantage)
                work.append((mine[near], guests[g <= mid + max_bits]))
                work.append((mine[~near], np.concatenate([guests[g > mid - max_bits], mine[near & (d > mid - max_bits)]])))
                continue
        for i in range(0, len(mine), leaf):
            block = mine[i : i + leaf]
            others = np.concatenate([mine[i:], guests])
            for j in range(0, len(others), 8192):
                x, y = np.nonzero(np.bitwise_count(block[:, None] ^ others[None, j : j + 8192]) <= max_bits)
                a, b = block[x], others[j + y]
                forest.add(a[a != b], b[a != b])
    return forest.links()


def link_fingerprints(points: DataFrame, max_bits: int = MAX_BITS, shard: int = SHARD) -> DataFrame:
    """Distinct ``fp`` longs to ``(node, component)``: linked ones with their component."""
    spark = points.sparkSession
    total = points.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, total / shard))))))
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE * 2**depth).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(top_tree(sample, depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            index, node, own = route(fps, shared.value, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fps[index].view(np.int64)), pa.array(own)], ["shard", "fp", "own"])

    def link(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        own = group.column("own").to_numpy()
        # Sorted, as the rows of a group come in any order.
        a, b = shard_links(np.sort(fps[own]), np.sort(fps[~own]), max_bits)
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, "shard long, fp long, own boolean")
    links = dealt.groupBy("shard").applyInArrow(link, "a long, b long")
    return components(links)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``key``, ``fp`` and ``component_id``.

    Every fingerprint links with every other at ``max_bits`` or fewer differing bits;
    ``component_id`` is the smallest key reachable by links. Texts that are null, empty
    or without words have fingerprint zero and link like any other. Repeated rows stay
    separate rows of one component. A null key is no candidate for the smallest key; a
    group of null keys alone has a null id. An empty table gives an empty table.
    """
    prints = stored(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), shingle=shingle).select("key", "fp"), "fingerprints")
    return _grouped(prints, max_bits).select(F.col("key").alias(key), "fp", F.col("first").alias("component_id"))


def _grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints`` (key, fp, ...) with its component's ``group`` and smallest key ``first``."""
    points = stored(prints.groupBy("fp").agg(F.min("key").alias("low")), "points")
    linked = link_fingerprints(points, max_bits)
    placed = points.join(linked, points.fp == linked.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("group"))
    firsts = placed.groupBy("group").agg(F.min("low").alias("first"))
    first_of = placed.join(firsts, "group").select("fp", "group", "first")
    return prints.join(first_of, "fp")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, its smallest key.

    Of rows that share the smallest key one stays; where a component has null keys
    alone, one of those. All columns are kept as they are.
    """
    row, fp = fresh(docs, "_row"), fresh(docs, "_fp")
    marked = stored(fingerprints(docs, text, shingle, fp).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    prints = marked.select(F.col(key).alias("key"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    keep = _grouped(prints, max_bits).where("key <=> first").groupBy("group").agg(F.min("row").alias(row)).select(row)
    return marked.join(keep, row, "left_semi").select(docs.columns)
