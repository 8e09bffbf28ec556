"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

1. Equal vectors of a label are one point with a weight.
2. The top level is global: a bounded sample gives every large label its centres. A point
   belongs to the nearest centre's cell and visits every cell of a higher number whose
   bisecting plane is within the threshold distance.
3. Cells larger than a block are cut into chunks, and every pair of chunks is one group,
   so that a group is bounded whatever the data look like.
4. In a group both sides become cover trees, nested levels with halving radii. Pairs of
   nodes are dropped when their covering radii leave them too far apart, taken whole when
   they leave every pair close enough, and opened otherwise. Single points are compared
   in double precision.
5. A group hands on how many vectors each point links with and a star forest of the
   links, never the pairs, so a dense group of copies stays linear in its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.shared import Forest, components, stored

COSINE = 0.98
#: Points of a cell (on average) and of a chunk; sampled vectors for the centres.
CELL, CHUNK, SAMPLE = 4096, 4096, 2048
#: What rounding may add to a distance between unit vectors.
SLACK = 1e-6
#: Nodes of so few points are not divided further; rows of a distance matrix at a time.
SMALL, ROWS = 16, 512


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Nodes in creation order; the points of a node are a range of ``order``."""

    def __init__(self, x: np.ndarray, weight: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.x, self.centre, self.lo, self.hi, self.radius, self.children = x, [], [], [], [], []
        self._add([0], [0], [len(x)])
        top = 2.0
        work = [0]
        while work:
            node = work.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo == 1:
                continue
            points = self.order[lo:hi]
            if hi - lo <= SMALL or self.radius[node] <= SLACK:
                child_of = np.arange(hi - lo)
            else:
                # The next level that does not cover the whole node again.
                reach = top * 0.5 ** np.ceil(np.log2(top / self.radius[node]) + 1e-9)
                child_of = self._cover(points, reach)
                if not child_of.any():
                    child_of = np.arange(hi - lo)
            by = np.argsort(child_of, kind="stable")
            self.order[lo:hi] = points[by]
            starts = lo + np.concatenate([[0], np.nonzero(np.diff(child_of[by]))[0] + 1])
            ends = np.append(starts[1:], hi)
            # The first point of a child is its centre: covers are found in point order.
            made = self._add(self.order[starts].tolist(), starts.tolist(), ends.tolist())
            self.children[node] = made
            work.extend(made)
        self.weight = weight
        sums = np.concatenate([[0], np.cumsum(weight[self.order])])
        self.lo, self.hi, self.radius, self.centre = (np.array(v) for v in (self.lo, self.hi, self.radius, self.centre))
        self.mass = sums[self.hi] - sums[self.lo]

    def _add(self, centre: list[int], lo: list[int], hi: list[int]) -> list[int]:
        first = len(self.centre)
        for c, a, b in zip(centre, lo, hi):
            self.centre.append(c)
            self.lo.append(a)
            self.hi.append(b)
            self.radius.append(0.0 if b - a == 1 else float(distances(self.x[self.order[a:b]], self.x[c : c + 1]).max()))
            self.children.append([])
        return list(range(first, len(self.centre)))

    def _cover(self, points: np.ndarray, reach: float) -> np.ndarray:
        """Child number of each point: the first centre within reach; greedy in point order."""
        child = np.full(len(points), -1)
        number = 0
        while True:
            left = np.nonzero(child < 0)[0]
            if not len(left):
                return child
            tried = left[:128]
            near = distances(self.x[points[tried]], self.x[points[left]]) <= reach
            for k, at in enumerate(tried.tolist()):
                if child[at] < 0:
                    taken = left[near[k]]
                    child[taken[child[taken] < 0]] = number
                    child[at] = number
                    number += 1

    def points(self, node: int) -> np.ndarray:
        return self.order[self.lo[node] : self.hi[node]]

    def opened(self, node: int) -> np.ndarray:
        return np.array(self.children[node] or [node])


class Links:
    """Link counts per point of two trees (or of one with itself) and a forest of links."""

    def __init__(self, a: CoverTree, b: CoverTree, cosine: float) -> None:
        self.a, self.b, self.cosine, self.far = a, b, cosine, float(np.sqrt(2 - 2 * cosine))
        self.count_a = np.zeros(len(a.x), np.int64)
        self.count_b = self.count_a if a is b else np.zeros(len(b.x), np.int64)
        # Points of the second tree are numbered after those of the first.
        self.shift = 0 if a is b else len(a.x)
        self.forest = Forest()

    def whole(self, u: int, v: int) -> None:
        """Every point of ``u`` links with every point of ``v``."""
        a, b, p, q = self.a, self.b, self.a.points(u), self.b.points(v)
        same = a is b and u == v
        self.count_a[p] += b.mass[v] - (a.weight[p] if same else 0)
        if not same:
            self.count_b[q] += a.mass[u]
        both = np.concatenate([p, q + self.shift])
        self.forest.add(both, np.full(len(both), p[0]))

    def single(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.count_a, p, self.b.weight[q])
        np.add.at(self.count_b, q, self.a.weight[p])
        self.forest.add(p, q + self.shift)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.a, self.b
        work = [(0, 0)]
        while work:
            u, v = work.pop()
            same = a is b and u == v
            if same and a.hi[u] - a.lo[u] == 1:
                continue
            if same and 2 * a.radius[u] < self.far - SLACK:
                self.whole(u, u)
                continue
            mine, theirs = a.opened(u), b.opened(v)
            for at in range(0, len(mine), ROWS):
                rows = mine[at : at + ROWS]
                cos = a.x[a.centre[rows]] @ b.x[b.centre[theirs]].T
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
                reach = a.radius[rows][:, None] + b.radius[theirs][None, :]
                keep = d - reach <= self.far + SLACK
                if same:
                    keep &= np.arange(at, at + len(rows))[:, None] <= np.arange(len(theirs))[None, :]
                i, j = np.nonzero(keep)
                d, cos, reach, left, right = d[i, j], cos[i, j], reach[i, j], rows[i], theirs[j]
                alone = (a.hi[left] - a.lo[left] == 1) & (b.hi[right] - b.lo[right] == 1)
                linked = alone & (cos >= self.cosine) & ~(same & (left == right))
                self.single(a.centre[left[linked]], b.centre[right[linked]])
                for x, y, inside in zip(left[~alone].tolist(), right[~alone].tolist(), (d + reach < self.far - SLACK)[~alone].tolist()):
                    if inside and not (same and x == y):
                        self.whole(x, y)
                    else:
                        work.append((x, y))
        return self.forest.links()


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_py(), kind) for v in column]).astype(np.float64)


def _centres(points: DataFrame, kind: str, cell: int, sample: int) -> dict:
    """(label, dim) -> unit centres, for labels that fill more than a cell; bounded by ``sample``."""
    drawn = points.orderBy(F.xxhash64("node"), "node").limit(sample).select("label", "dim", "vec")
    keys = drawn.select("label", "dim").distinct()
    sizes = {(r.label, r.dim): r["count"] for r in points.join(keys, ["label", "dim"], "left_semi").groupBy("label", "dim").count().where(F.col("count") > cell).collect()}
    found: dict = {}
    for r in drawn.collect():
        if (r.label, r.dim) in sizes:
            found.setdefault((r.label, r.dim), []).append(np.frombuffer(r.vec, kind))
    out = {}
    for key, vectors in found.items():
        x, picked = units(np.stack(vectors).astype(np.float64)), [0]
        near = distances(x, x[:1])[:, 0]
        # Farthest first: the centres of each coarser level are among those of the next.
        while len(picked) < min(len(x), -(-sizes[key] // cell)):
            far = int(near.argmax())
            if near[far] <= SLACK:
                break
            picked.append(far)
            near = np.minimum(near, distances(x, x[far : far + 1])[:, 0])
        out[key] = x[picked]
    return out


def _blocks(dealt: DataFrame, chunk: int) -> DataFrame:
    """Each point once for every pair of chunks that it is part of: columns ``i``, ``j`` and ``side``."""
    where = ["label", "dim", "cell"]
    sizes = dealt.groupBy(where).agg(F.ceil(F.sum(F.col("own").cast("int")) / chunk).alias("ours"), F.ceil(F.sum((~F.col("own")).cast("int")) / chunk).alias("guests"))
    placed = dealt.join(sizes.where("ours > 0"), where)
    number = F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("ours")).otherwise(F.col("guests")))
    placed = placed.withColumn("c", number)
    as_left = F.when(F.col("own"), F.sequence(F.col("c"), F.col("ours") + F.col("guests") - 1))
    as_right = F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("c"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("ours") - 1))
    mine = F.when(F.col("own"), F.col("c")).otherwise(F.col("ours") + F.col("c"))
    left = F.coalesce(F.transform(as_left, lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(0).alias("side"))), F.array().cast("array<struct<i:bigint,j:bigint,side:int>>"))
    right = F.transform(F.filter(as_right, lambda i: i != mine), lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(1).alias("side")))
    return placed.select(*where, "node", "weight", "vec", F.inline(F.concat(left, right)))


def link_points(points: DataFrame, kind: str, cosine: float = COSINE, cell: int = CELL, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """``points`` (node, label, dim, weight, vec) to rows (a, b, links).

    Rows with a null ``b`` say with how much weight node ``a`` links; the others are
    links (a, b), a forest of those of each group.
    """
    shared = points.sparkSession.sparkContext.broadcast(_centres(points, kind, cell, sample))
    far = float(np.sqrt(2 - 2 * cosine)) + SLACK
    schema = T.StructType([*(points.schema[c] for c in ("label", "dim", "node", "weight", "vec")), T.StructField("cell", T.IntegerType()), T.StructField("own", T.BooleanType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            rows, cells, own = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            by_key: dict = {}
            for i, key in enumerate(keys):
                by_key.setdefault(key, []).append(i)
            for key, at in by_key.items():
                at = np.array(at)
                centres = shared.value.get(key)
                rows.append(at)
                own.append(np.ones(len(at), bool))
                if centres is None or len(centres) == 1:
                    cells.append(np.zeros(len(at), np.int64))
                    continue
                d = distances(units(_matrix(batch.column("vec").take(pa.array(at)), kind)), centres)
                home = d.argmin(axis=1)
                cells.append(home)
                gap = distances(centres, centres)[home]
                plane = (d**2 - d[np.arange(len(at)), home][:, None] ** 2) / np.maximum(2 * gap, SLACK)
                i, q = np.nonzero((plane <= far) & (np.arange(len(centres))[None, :] > home[:, None]))
                rows.append(at[i])
                cells.append(q)
                own.append(np.zeros(len(i), bool))
            out = batch.take(pa.array(np.concatenate(rows)))
            columns = [out.column(c) for c in ("label", "dim", "node", "weight", "vec")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(own))], schema.fieldNames())

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        side, node, weight = (group.column(c).to_numpy() for c in ("side", "node", "weight"))
        x = units(_matrix(group.column("vec"), kind))
        alone = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        if not (side == 0).any() or not alone and not (side == 1).any():
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "links")})
        a = CoverTree(x[side == 0], weight[side == 0])
        b = a if alone else CoverTree(x[side == 1], weight[side == 1])
        links = Links(a, b, cosine)
        p, q = links.run()
        names = np.concatenate([node[side == 0], node[side == 1]])
        counts = links.count_a if a is b else np.concatenate([links.count_a, links.count_b])
        some = np.nonzero(counts)[0]
        empty = pa.nulls(len(some), pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(names[some]), pa.array(names[p])]), "b": pa.concat_arrays([empty, pa.array(names[q])]), "links": pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(p), pa.int64())])})

    dealt = stored(points.select("label", "dim", "node", "weight", "vec").mapInArrow(deal, schema), "cells")
    found = _blocks(dealt, chunk).groupBy("label", "dim", "cell", "i", "j").applyInArrow(link, "a long, b long, links long")
    return stored(found, "cell-links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, **sizes: int) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link when their labels are equal and not null and their cosine is at least
    ``cosine``. Null, zero and non-finite vectors, and those of another length, link with
    nothing. Repeated rows are further vectors that link. ``component_id`` is the smallest
    key reachable by links; a null key is no candidate unless all keys there are null.
    """
    v = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"))
    element = v.schema["v"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    if kind == "<f8":
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    marked = v.withColumn("good", good)
    same = marked.where("good").groupBy("label", "v").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("weight"))
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()), "vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.array(x.as_py(), kind).tobytes() for x in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([len(x) // int(kind[2]) for x in values], pa.int32()), batch.column("node"), batch.column("weight"), pa.array(values, pa.binary())], ["label", "dim", "node", "weight", "vec"])

    shape = T.StructType([nodes.schema["label"], T.StructField("dim", T.IntegerType()), nodes.schema["node"], nodes.schema["weight"], T.StructField("vec", T.BinaryType())])
    points = stored(nodes.select("label", "v", "node", "weight").mapInArrow(packed, shape), "points")
    found = link_points(points, kind, cosine, **sizes)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(found.where("b is not null").select("a", "b"))
    placed = nodes.select("node", "low", "weight").join(counts, "node", "left").join(linked, "node", "left")
    placed = placed.select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"))
    firsts = placed.groupBy("group").agg(F.min("low").alias("first"))
    of_node = placed.join(firsts, "group").select("node", "n_links", "first")
    of_vector = nodes.select("label", "v", "node").join(of_node, "node").drop("node")
    good_rows = marked.where("good").join(of_vector, ["label", "v"]).select("key", "n_links", F.col("first").alias("component_id"))
    others = marked.where("not good").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return good_rows.union(others).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
