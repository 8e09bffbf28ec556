import numpy as np
import pytest
import xxhash

from truegauge.llm import simhash
from truegauge.llm.shared import components, stars


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points, max_bits):
    """Brute force: point -> smallest reachable point."""
    label = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for a in points:
            for b in points:
                if (a ^ b).bit_count() <= max_bits and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A  b\tC d\x0be É é f g", "x " * 900 + "Ünï " * 70000])
def test_fingerprint_follows_its_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('the quick brown fox')").first()[0]
    assert row % 2**64 == xxhash.xxh64(b"the quick brown fox", seed=42).intdigest()


def clustered(rng, centres, copies):
    base = rng.integers(0, 2**63, centres, dtype=np.uint64)
    out = [base]
    for _ in range(copies):
        flips = np.zeros(centres, np.uint64)
        for _ in range(3):
            flips |= np.uint64(1) << rng.integers(0, 64, centres, dtype=np.uint64)
        out.append(base ^ flips)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_routing_and_shards_lose_no_pair(depth):
    points = clustered(np.random.default_rng(depth), 150, 3)
    tree = simhash.top_tree(points[::3], depth)
    index, node, own = simhash.route(points, tree, 4)
    assert sorted(index[own].tolist()) == list(range(len(points)))
    links = [simhash.shard_links(points[index[(node == n) & own]], points[index[(node == n) & ~own]], 4, leaf=16) for n in set(node.tolist())]
    a, b = stars(*(np.concatenate(x) for x in zip(*links)))
    found = {p: p for p in points.tolist()} | dict(zip(a.tolist(), b.tolist()))
    assert found == groups(points.tolist(), 4)


def test_components_of_a_chain_a_star_and_copies(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (5, 4), (4, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [
    (5, "the cat sat on the mat and looked at the dog all day"),
    (3, "The cat sat on the mat and looked at the dog all day"),
    (3, "The cat sat on the mat and looked at the dog all day"),
    (9, None),
    (8, ""),
    (7, " \n"),
    (None, "only here with a null key and a few more words"),
    (None, "only here with a null key and a few more words"),
    (1, "word " * 30000),
    (2, "entirely different words in this one so it stays alone here"),
]


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], "doc_id long, text string, fp long, component_id string, _fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 7), (8, 7), (7, 7), (None, None), (None, None), (1, 1), (2, 2)], key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 7, None, 1, 2], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, data):
    from truegauge.llm.queries import QUERIES

    rows = QUERIES["op8_simhash_near_duplicates"](spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    label = groups(sorted(set(prints.values())), 4)
    least = {}
    for d, p in prints.items():
        least[label[p]] = min(d, least.get(label[p], d))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(d, f"{p:016x}", least[label[p]]) for d, p in prints.items()}
