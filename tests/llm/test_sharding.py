import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from truegauge.llm import queries, sharding


def plain_differencing(sizes, shards, start):
    """The same rule on lists of lists of items, slowly."""
    parts = [[(int(x), [("start", j)]) for j, x in enumerate(start)]]
    parts += [[(0, [])] * (shards - 1) + [(int(s), [i])] for i, s in enumerate(sizes)]
    tagged = [(k, sorted(p, key=lambda x: x[0])) for k, p in enumerate(parts)]
    made = len(tagged)
    while len(tagged) > 1:
        tagged.sort(key=lambda t: (-(t[1][-1][0] - t[1][0][0]), t[0]))
        (_, a), (_, b), *rest = tagged
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: x[0])
        tagged, made = [*rest, (made, both)], made + 1
    out = {}
    for _, items in tagged[0][1]:
        name = next(i[1] for i in items if isinstance(i, tuple))
        out.update({i: name for i in items if not isinstance(i, tuple)})
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(8))
def test_differencing_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, 1000, rng.integers(0, 60)))[::-1]
    shards = int(rng.integers(1, 7))
    start = rng.integers(0, 3000, shards)
    assert sharding.difference(sizes, shards, start).tolist() == plain_differencing(sizes, shards, start)


def test_differencing_beats_dealing_the_largest_first():
    # The classic example: 8, 7, 6, 5, 4 into two; greedy leaves 4, differencing 2.
    sizes = np.array([8, 7, 6, 5, 4])
    shard = sharding.difference(sizes, 2)
    sums = np.bincount(shard, weights=sizes)
    assert abs(sums[0] - sums[1]) == 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(None))


def check(rows, texts, shards):
    by_text, slots = {}, defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body)) and 0 <= r.shard < shards
        assert by_text.setdefault(body, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter({s: sum(r.size for r in rows if r.shard == s) for s in range(shards)})


@pytest.mark.parametrize("bucket", [50, 5000])
def test_groups_stay_whole_and_bytes_are_even(spark, bucket):
    rng = np.random.default_rng(3)
    texts = [f"{i} " + "é" * int(rng.integers(0, 400)) for i in range(1500)] + ["copy " * 9] * 700 + [None, "", None]
    rows = sharding.shard(frame(spark, list(enumerate(texts))).repartition(5), shards=8, bucket=bucket).collect()
    assert len(rows) == len(texts)
    loads = check(rows, texts, 8).values()
    assert max(loads) - min(loads) <= 0.002 * sum(loads) / 8 + 40 * (len(texts) / bucket) ** 0.5


def test_a_group_above_the_mean_has_its_shard_alone(spark):
    texts = ["hot"] * 900 + [f"text {i}" for i in range(400)]
    rows = sharding.shard(frame(spark, list(enumerate(texts))), shards=6, bucket=40).collect()
    loads = check(rows, texts, 6)
    hot = next(r.shard for r in rows if texts[r.doc_id] == "hot")
    assert loads[hot] == 900 * 19 and all(r.shard != hot or texts[r.doc_id] == "hot" for r in rows)
    rest = [n for s, n in loads.items() if s != hot]
    assert max(rest) - min(rest) <= 100


def test_odd_rows_and_empty_table(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    rows = sharding.shard(frame(spark, [(None, None), (None, None), (7, "a" * 300_000), (7, "a" * 300_000)])).collect()
    assert len(rows) == 4 and len({r.shard for r in rows}) == 2
    assert sorted((r.size, r.slot) for r in rows) == [(16, 0), (16, 1), (300_016, 0), (300_016, 1)]


def test_query_on_the_whole_table(spark, data):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    found = queries.QUERIES["op13_differencing_shards"](spark, data)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    loads = check(rows, texts, 40)
    # Brute force: all groups here are large, so the query is one differencing over them.
    sizes = Counter()
    for t in texts.values():
        sizes[t or ""] += len((t or "").encode()) + 16
    order = sorted(sizes, key=lambda t: -sizes[t])
    plain = plain_differencing([sizes[t] for t in order], 40, [0] * 40)
    want = np.bincount(plain, weights=[sizes[t] for t in order], minlength=40)
    assert max(loads.values()) <= max(want.max(), 1.02 * sum(loads.values()) / 40)
