import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from truegauge.llm import collocations, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, longest=4, top=2000, nested=80):
    """Brute force over (text, lang) rows."""
    counts, out = {}, []
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = tuple(w for w in re.split("[\x20\x09]+", piece) if w)
            for k in range(1, longest + 1):
                f.update(words[i : i + k] for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        around = Counter()
        for g, c in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    around[g[i : i + m]] = max(around[g[i : i + m]], c)
        best = []
        for g, a in cand.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if g not in around or 100 * around[g] < nested * a:
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").withColumn("rank", F.lit("clash")).withColumn("n", F.lit(None))


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "c", "dé", "New", "york", "city", "of", "x1", "中", "\xa0", "long" * 30]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    signs = np.array([" ", " ", " ", "\t", "  ", ". ", "\n", ", ", "\x0b"])
    rows = []
    for i in range(n):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum())
        rows.append(("".join(w + s for w, s in zip(words, rng.choice(signs, len(words)))) + "new york city hall", ["en", "fr", None, "und"][i % 4]))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk": 50, "trie": 5, "broadcast": 200, "top": 7}, {"least": 3, "longest": 3, "nested": 50}])
def test_phrases_by_brute_force(spark, options):
    rows = random_rows(len(options)) + [(None, "en"), ("", "fr"), (" \t", None), ("!!!", "en"), ("w " * 3000, "xx")]
    limits = {k: v for k, v in options.items() if k in ("least", "longest", "top", "nested")}
    assert found(collocations.collocations(frame(spark, rows).repartition(3), **options)) == plain(rows, **limits)


def test_no_rows_and_no_candidates(spark):
    assert found(collocations.collocations(frame(spark, []))) == []
    assert found(collocations.collocations(frame(spark, [("a b c", "en")] * 29 + [(None, None)]))) == []


@pytest.mark.parametrize("seed", range(6))
def test_trie_holds_its_phrases_and_no_others(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 2 + 40 * seed, 3000).astype(np.int32) * 3
    ids[rng.random(3000) < 0.1] = -1
    grams = {}
    for size in (2, 3, 4):
        at = collocations.grams_at(ids, None, size)
        for i in at[:: size + seed]:
            g = tuple(ids[i : i + size])
            for k in range(2, size + 1):
                grams[g[:k]] = 0
    table = np.array([list(g) + [-1] * (4 - len(g)) for g in grams], np.int32).reshape(-1, 4)
    arrays = collocations.build_trie(table)
    counts = np.zeros(len(arrays[2]), np.int64)
    for level, states in enumerate(collocations.walk(ids, *arrays, 4)):
        if level:
            counts += np.bincount(states, minlength=len(counts))
    at = np.nonzero(counts)[0]
    got = {tuple(w for w in row if w >= 0): int(n) for row, n in zip(collocations.spelled(at, *arrays, 4).tolist(), counts[at])}
    want = Counter(tuple(ids[i : i + k]) for k in (2, 3, 4) for i in range(len(ids) - k + 1) if tuple(ids[i : i + k]) in grams)
    assert got == want
    # Every state but the root has a parent that leads to it.
    assert (arrays[2] >= 0).sum() == len({g[:k] for g in grams for k in range(1, len(g) + 1)})


@pytest.mark.parametrize("bits", [1, 7, 16, 23, 32])
def test_spread_keys_are_one_to_one(bits):
    keys = np.unique(np.random.default_rng(bits).integers(0, 1 << 2 * bits, 5000, dtype=np.uint64))
    mixed = collocations.spread(keys, bits)
    assert len(np.unique(mixed)) == len(keys) and int(mixed.max()) < 1 << 2 * bits
    assert (collocations.unspread(mixed, bits) == keys).all()


def test_candidates_are_the_frequent_phrases_each_once(spark, monkeypatch):
    # Many rare phrases, and frequent ones that occur in each of many chunks.
    rng = np.random.default_rng(7)
    rows = [(" ".join(f"w{w}" for w in rng.integers(0, 300, 250)) + " new york city hall new york", "en") for _ in range(240)]
    made, write = {}, collocations.stored

    def stored(df, purpose):
        made.setdefault(purpose, []).append(write(df, purpose))
        return made[purpose][-1]

    monkeypatch.setattr(collocations, "stored", stored)
    monkeypatch.setattr(collocations, "RANGE", 9000)
    collocations.collocations(frame(spark, rows).repartition(2), chunk=6000)
    counts = Counter()
    for text, _ in rows:
        words = text.split()
        for k in (2, 3, 4):
            counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {g for g, c in counts.items() if c >= 30}
    word = {r["id"]: r["word"] for r in made["word-ids"][0].collect()}
    got = [tuple(word[w] for w in r[1:]) for df in made["candidates"] for r in df.collect()]
    assert sorted(got) == sorted(frequent) and {len(g) for g in got} == {2, 3, 4}
    # Packed rows: one per chunk and range and one per range, none per phrase.
    chunks, ranges = made["chunks"][0].count(), -(-240 * 256 // 9000)
    assert chunks >= 10 and all(df.count() <= (chunks + 1) * ranges for df in made["frequent-keys"])


def test_query_and_its_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text", "lang").collect()
    rows = found(queries.QUERIES["op12_trie_collocations"](spark, data))
    assert rows == plain([tuple(d) for d in docs]) and rows
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    result = db.execute(queries.ORACLES["op12_trie_collocations"])
    names = [d[0] for d in result.description]
    assert sorted(tuple(dict(zip(names, r))[c] for c in COLUMNS) for r in result.fetchall()) == rows
