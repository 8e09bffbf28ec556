import numpy as np
import pytest
from pyspark.sql import functions as F

from truegauge.llm import maxscore


def brute(rows, top):
    out = []
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for a, (i, v) in enumerate(kept):
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(kept) if a != b)[:top]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,sizes", [(0, {}), (1, {"shard": 40, "block": 3}), (2, {"top": 9, "shard": 7, "block": 1})])
def test_equals_brute_force(spark, seed, sizes):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=6) * [3, 1, 1, 0.2, 0.1, 0.01]).round(2).tolist()) for i in rng.permutation(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, sizes.get("top", 5))


def test_large_values_stay_exact():
    q, c = np.array([[2**40, 3]]), np.array([[2**20, 1], [2**20, 2], [-1, 7], [0, 0], [5, 5], [6, 6]])
    assert maxscore.search(q, c, np.array([-1]), np.arange(6), 2)[2].tolist() == [2**60 + 6, 2**60 + 3]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, []), (8, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id long, embedding array<double>, row int, block string")
    got = sorted(tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows, 5) and len(got) == 12
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
