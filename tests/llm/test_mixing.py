from collections import Counter

import pytest

from truegauge.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 3.0, "c": 2.0}, {"a": 0.5, **{f"s{i}": 0.01 for i in range(50)}}, {"a": 1.0}, {"a": 0.999, "b": 0.0001, "c": 1e-9}])
def test_period_keeps_windows_and_deviation(weights):
    shares = mixing.whole_shares(weights, 200)
    period = sum(shares.values())
    plan = mixing.one_period(shares)
    assert period == max(200, 20 * len(weights)) and min(shares.values()) >= 1
    assert Counter(p[0] for p in plan) == shares
    had = Counter()
    for source, k, slot, release, deadline in plan:
        assert release <= slot < deadline and k == had[source]
        had[source] += 1
        for s, n in shares.items():
            assert abs(had[s] - n * (slot + 1) / period) < 1


def docs(spark, n=400):
    rows = [(i, "x" * (50 + i % 7), ["a", "b", None][(i % 6 > 2) + (i % 6 == 5)]) for i in range(n)]
    rows += [(7, None, "a"), (7, None, "a"), (None, "y" * 1000, "b"), (900, "", "c")]
    return spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, slot int, _row string")


@pytest.mark.parametrize("weights", [None, {"a": 2.0, "b": 1.0, None: 1.0}])
def test_every_prefix_stays_within_a_block(spark, weights, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 60)
    rows = mixing.schedule(docs(spark), weights=weights, block=300, period=100).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs(spark).collect())
    blocks = {(r.source, r.block): r.slot for r in rows}
    assert len({r.slot for r in rows}) == len(blocks) and all(r.release <= r.slot < r.deadline for r in rows)
    sizes = Counter()
    for r in docs(spark).collect():
        sizes[r.source] += len(r.text or "")
    total = {s: max(b for t, b in blocks if t == s) + 1 for s in sizes}
    shares = mixing.whole_shares({"" if s is None else f"={s}": w for s, w in weights.items()} | {"=c": 1.0}, 100) if weights else None
    for source, most in total.items():
        slots = sorted(v for (s, _), v in blocks.items() if s == source)
        if shares and len(slots) == most:
            w = shares["" if source is None else f"={source}"] / 100
            assert all(abs(i + 1 - w * (slot + 1)) < 1 for i, slot in enumerate(slots))


def test_order_of_the_written_table(spark, tmp_path):
    source = docs(spark)
    kept = mixing.interleaved(source, block=300, period=100)
    assert kept.columns == source.columns
    rows = [r.source for r in kept.collect()]
    assert sorted(map(str, rows)) == sorted(str(r.source) for r in source.collect())
    # Both halves of the first third hold all the lasting sources.
    assert {"a", "b", None} <= set(rows[:60]) and {"a", "b", None} <= set(rows[60:140])
    assert mixing.interleaved(source.limit(0)).count() == 0 and mixing.schedule(source.limit(0)).count() == 0
