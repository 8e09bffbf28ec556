"""Exact top-k inner products of integer vectors by MaxScore over shards.

A dimension is a term: its postings are the candidates' values. For a query, a term adds
between a least and a most, known from the extremes of its postings. Measured from the
least, terms in order of how much they can add split in two: the non-essential ones
cannot together lift a candidate over the threshold, so only the postings of the
essential ones are traversed. Candidates that may still reach the threshold are probed in
the other terms, a few at a time, while they stay competitive. Candidates are dealt to
shards of bounded size and queries to blocks of bounded size; each (block, shard) pair is
one group, and the best of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegauge.llm.shared import stored, tasks_for

TOP = 5
SCALE = 256
#: Candidates of a shard, queries of a block.
SHARD, BLOCK = 4096, 2048
#: Candidates scored in full for the first threshold, and terms per probe.
SEEDS, PROBE = 64, 8


def search(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, ids: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the ``top`` best per query; ties to the smaller id.

    ``own`` is the candidate that a query itself is, or -1.
    """
    if not len(queries) or not len(candidates):
        return (np.empty(0, np.int64),) * 3
    # Doubles add integers exactly up to 2**53, and far faster.
    most = np.abs(queries).max(initial=0).astype(float) * np.abs(candidates).max(initial=0).astype(float) * queries.shape[1]
    kind = np.float64 if most < 2**52 else np.int64
    q, postings = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    low, high = postings.min(axis=1), postings.max(axis=1)
    least, upper = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
    terms = np.argsort(-(upper - least), axis=1, kind="stable")
    in_order = np.take_along_axis(upper, terms, 1)
    # What the terms from each place on can add at most, and the same above their least.
    rest = np.concatenate([np.cumsum(in_order[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), kind)], axis=1)
    gain = np.take_along_axis(upper - least, terms, 1)
    rest_gain = np.concatenate([np.cumsum(gain[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), kind)], axis=1)
    base = least.sum(axis=1)
    seeds = np.argsort(-np.abs(postings).sum(axis=0), kind="stable")[:SEEDS]
    first = q @ postings[:, seeds]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        scores = first[i][seeds != own[i]]
        threshold = np.partition(scores, len(scores) - top)[len(scores) - top] if len(scores) >= top else None
        order = terms[i]
        if threshold is None:
            essential = len(order)
        else:
            essential = int(np.argmax(base[i] + rest_gain[i] < threshold)) if base[i] < threshold else len(order)
        partial = q[i, order[:essential]] @ postings[order[:essential]]
        alive = np.arange(len(partial))
        at = essential
        while True:
            if threshold is not None:
                stay = partial + rest[i, at] >= threshold
                alive, partial = alive[stay], partial[stay]
            if at == len(order):
                break
            probe = order[at : at + PROBE]
            partial = partial + q[i, probe] @ postings[probe][:, alive]
            at += len(probe)
        other = alive != own[i]
        alive, partial = alive[other], partial[other]
        best = np.lexsort((ids[alive], -partial))[:top]
        found.append((np.full(len(best), i), alive[best], partial[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers; shorter vectors are padded with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """For each row where the column ``is_query`` holds: its ``top`` rows of highest score.

    Components become floor(256 * x) and the score is the integer inner product; of
    vectors of unequal length the shorter counts as padded with zeros. Vectors that are
    null or hold null or non-finite components, and rows with a null key, take no part.
    A query's own row is no candidate of it; a repeated row is one and is a query of its
    own. Fewer than ``top`` candidates: all of them. Columns: query_id, rank, vec_id, score.
    """
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("query"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    terms = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    rows = stored(good.select("id", terms.alias("v"), F.coalesce("query", F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row")), "terms")
    asked, total = rows.where("query"), rows.count()
    shards, blocks = tasks_for(total, shard), tasks_for(asked.count(), block)

    def every(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def one(n: int, name: str):
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name)

    kept = ("row", "id", "v")
    sides = rows.select(every(blocks, "block"), one(shards, "shard"), F.lit(False).alias("asks"), *kept).union(asked.select(one(blocks, "block"), every(shards, "shard"), F.lit(True).alias("asks"), *kept))

    def best(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        asks = group.column("asks").to_numpy()
        x, row, ids = _matrix(group.column("v")), group.column("row").to_numpy(), group.column("id").to_numpy()
        mine, theirs = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        place = np.searchsorted(row[theirs], row[mine])
        known = place < len(theirs)
        known[known] = row[theirs][place[known]] == row[mine][known]
        i, j, score = search(x[mine], x[theirs], np.where(known, place, -1), ids[theirs], top)
        return pa.table({"row": row[mine][i], "query_id": ids[mine][i], "vec_id": ids[theirs][j], "score": score})

    found = sides.groupBy("block", "shard").applyInArrow(best, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
