import numpy as np
import pytest

from truegauge.llm import covertree
from truegauge.llm.shared import stars


def cloud(seed, groups=12, size=25, dim=8, noise=0.05):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, 1, dim))
    dense = (base + noise * rng.normal(size=(groups, size, dim))).reshape(-1, dim)
    return np.concatenate([dense, rng.normal(size=(60, dim)), np.repeat(base[0], 3, axis=0), 3 * base[1]])


def brute(x, cosine=0.98):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= cosine
    np.fill_diagonal(links, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return links.sum(axis=1), label
        label = new


@pytest.mark.parametrize("seed", range(4))
def test_levels_nest_and_radii_cover(seed):
    x = covertree.units(cloud(seed))
    tree = covertree.CoverTree(x, np.ones(len(x), np.int64))
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for node, made in enumerate(tree.children):
        far = covertree.distances(x[tree.points(node)], x[tree.centre[node]][None])
        assert far.max() <= tree.radius[node] + 1e-7
        if made:
            assert tree.centre[made[0]] == tree.centre[node] and len(made) > 1
            assert sorted(np.concatenate([tree.points(c) for c in made])) == sorted(tree.points(node))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cut", [0, 1, 120])
def test_dual_traversal_equals_brute_force(seed, cut):
    x = cloud(seed, noise=[0.01, 0.03, 0.05, 0.08, 0.12, 0.3][seed])
    counts, label = brute(x)
    u, one = covertree.units(x), np.ones(len(x), np.int64)
    a = covertree.CoverTree(u[cut:], one[cut:])
    parts = [covertree.Links(a, a, 0.98)]
    found = [tuple(e + cut for e in parts[0].run())]
    total = np.zeros(len(x), np.int64)
    total[cut:] = parts[0].count_a
    if cut:
        b = covertree.CoverTree(u[:cut], one[:cut])
        for left, right in ((b, b), (b, a)):
            links = covertree.Links(left, right, 0.98)
            found.append(links.run())
            total[:cut] += links.count_a
            if right is a:
                total[cut:] += links.count_b
    assert (total == counts).all()
    p, q = stars(*(np.concatenate(e) for e in zip(*found)))
    got = np.arange(len(x))
    got[p] = q
    assert (got == label).all()


@pytest.mark.parametrize("sizes", [{}, {"cell": 40, "chunk": 30, "sample": 64}, {"cell": 100000, "chunk": 25}])
def test_whole_operator_equals_brute_force(spark, sizes):
    rows, want = [], {}
    for label in (1, 2):
        x = cloud(label, groups=4, size=20, noise=0.04).astype(np.float32).astype(np.float64)
        ids = [1000 * label + i for i in range(len(x))]
        counts, least = brute(x)
        rows += [(i, v.tolist(), label) for i, v in zip(ids, x)]
        want |= {i: (int(n), ids[k], i == ids[k]) for i, n, k in zip(ids, counts, least)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = covertree.near_duplicates(df, **sizes).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want and len(got) == len(rows)


def test_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [
        (5, one, 1), (3, one, 1), (3, one, 1), (4, [2.0, 0.0], 1), (2, [-1.0, 0.0], 1), (9, one, None), (8, None, 1), (7, [0.0, 0.0], 1),
        (6, [float("nan"), 1.0], 1), (10, [float("inf"), 0.0], 1), (11, [None, 1.0], 1), (12, [], 1), (13, [1.0], 1), (None, [0.0, 1.0], 1), (14, [0.0, 5.0], 1), (15, one, 2),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, weight int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (2, 6, 7, 8, 9, 10, 11, 12, 13, 15)]
    assert got == sorted([(5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (None, 1, 14, False), (14, 1, 14, True), *alone], key=repr)
    assert covertree.near_duplicates(df.limit(0)).count() == 0
