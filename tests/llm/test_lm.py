import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from truegauge.llm import lm


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + [None]


def remainder(key):
    return zlib.crc32(str(key).encode()) % 5 if key is not None else 0


def brute(rows, weights_of):
    train = [tokens(t) for k, t in rows if remainder(k) != 1]
    words = Counter(w for d in train for w in d)
    pairs = Counter(p for d in train for p in zip([None, *d], d))
    n, v = sum(words.values()), len(words)
    out = []
    for k, t in rows:
        d = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        score = 0.0
        for c, w in zip([None, *d], d):
            a = weights_of[0 if not words[c] else min(31, int(math.log2(words[c])) + 1)]
            score += math.log10(a[0] * pairs[c, w] / max(1, words[c]) + a[1] * words[w] / max(1, n) + a[2] / (v + 1))
        out.append((k, remainder(k) == 1, len(d), sum(words[w] > 0 for w in d), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def learned(monkeypatch):
    """The weights that a run learns."""
    kept, real = [], lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: kept.append(real(*a)) or kept[-1])
    return kept


@pytest.mark.parametrize("sizes", [{}, {"chunk": 500, "bucket": 300}])
def test_scores_equal_brute_force(spark, data, monkeypatch, sizes):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("n_chars").limit(120).collect()]
    rows += [(None, None), (5001, ""), (5001, ""), (5002, "The the THE É é \x0b x\x85y"), (5003, "long " * 3000)]
    kept = learned(monkeypatch)
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, tune int, chunk string").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.scores(docs, **sizes).collect()), key=repr)
    want = brute(rows, kept[0])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-5)


def test_probabilities_add_up_to_one(monkeypatch):
    cells = np.array([[0, 0, 30, 5], [0, 0, 0, 2], [3, 10, 30, 50], [3, 0, 20, 9], [9, 4, 0, 7]])
    weights = lm.learn_weights(cells, 0.01)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0


def test_expectation_maximisation_raises_the_likelihood():
    cells = np.array([[4, 8, 24, 60], [4, 0, 24, 30], [4, 0, 0, 3]])
    parts = np.stack([lm._probability(cells[:, 1]), lm._probability(cells[:, 2]), np.full(3, 0.001)], axis=1)

    def likelihood(w):
        return cells[:, 3] @ np.log(parts @ w)

    best = likelihood(lm.learn_weights(cells, 0.001)[4])
    for other in np.random.default_rng(0).dirichlet([1, 1, 1], 500):
        assert likelihood(other) <= best + 1e-6


def test_better_than_the_base_on_held_out_documents(spark, data):
    from truegauge.llm.queries import QUERIES

    rows = [r for r in QUERIES["op10_deleted_interpolation_scores"](spark, data).collect() if r.held_out]
    assert len(rows) > 20 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nothing_to_learn_from(spark):
    key = next(k for k in range(100) if remainder(k) == 1)
    row = lm.scores(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
