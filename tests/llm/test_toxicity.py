import itertools

import numpy as np
import pytest

from truegauge.llm import toxicity


def kernel(a, b):
    """Brute force: common subsequences of three letters, weighted by the stretches they span."""

    def triples(word):
        out = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if word[i].isalpha() and word[j].isalpha() and word[k].isalpha():
                key = word[i] + word[j] + word[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_over_triples_is_the_string_kernel():
    words = ["idiot", "idxiot", "i d i o t", "stupid", "banana", "abcabcabc"]
    marks = toxicity.Landmarks(words[:4])
    parts = toxicity.Triples(words)
    got = parts.against(marks.table) / parts.norms()[:, None]
    want = [[kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b)) for b in words[:4]] for a in words]
    np.testing.assert_allclose(got, want, atol=1e-12)
    features = got @ marks.whiten
    np.testing.assert_allclose((features @ features.T)[:4, :4], np.array(want)[:4], atol=1e-8)


@pytest.mark.parametrize("word,want", [("The!!", "the"), ("Été,", "ete"), ("1d10t", "idiot"), ("$cum", "scum"), ("i-d-i", "i-d-i"), ("!!!", ""), ("", ""), ("́", "")])
def test_plain_words(word, want):
    assert toxicity.plain(word) == want


def test_whole_texts_are_read():
    assert "last" in toxicity.instances("x " * 100_000 + "last") and "i d i o t" in toxicity.instances("you i d  i\no t there")
    model = toxicity.Model(np.zeros(toxicity.LETTERS**3), -0.25)
    model.weight[(25 * 27 + 24) * 27 + 25] = 9.0
    assert model.margins(["a" * 5000 + "zyz"])[0] > -0.25 == model.margins(["a" * 5000])[0]
    assert toxicity.Scorer(model).margins([None, "", "ab"]).tolist() == [-0.25] * 3


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    syllables = ["ba", "ko", "ri", "ten", "mu", "sol", "da", "pel", "vo", "nim"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            words.insert(int(rng.integers(60)), str(rng.choice(["zorgwick", "hexmurf"])))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learns_and_tolerates_gaps(spark, corpus):
    docs = spark.createDataFrame([r[:2] for r in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in corpus], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.learnable(labels))
    got = {r.doc_id: r.score for r in toxicity.with_score(docs, model).collect()}
    assert [int(got[r[0]] >= 0.5) for r in corpus] == [r[2] for r in corpus]
    clean = corpus[1][1]
    tried = ["zorg-wick", "zorgxwick", "Z0RGWICK!!", "h e x m u r f", "hexmurfs", "zorgwickel"]
    found = model.probability(toxicity.Scorer(model).margins([f"{clean} {w} {clean}" for w in tried]))
    assert (found >= 0.5).all() and model.probability(toxicity.Scorer(model).margins([clean]))[0] < 0.5
    kept = toxicity.reject_toxic(docs.selectExpr("*", "1 as score", "'a' as _score", "doc_id as margin"), labels)
    assert kept.columns == ["doc_id", "text", "score", "_score", "margin"]
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in corpus if not r[2]]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "word " * 9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        assert toxicity.train(docs, labels) is None
        assert toxicity.reject_toxic(docs, labels).count() == 4
    both = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    rows = toxicity.with_score(docs, toxicity.train(docs, both)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.with_score(docs.limit(0), None).count() == 0


def test_query_on_the_held_out_fold(spark, data):
    from truegauge.llm.queries import QUERIES

    rows = QUERIES["op1_string_kernel_toxicity"](spark, "/root/testdata/sf0.01").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(text) and all(r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r for r in rows if r.held_out and toxic.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    insults = [r for r in rows if any(w in (text[r.doc_id] or "").lower() for w in ("idiot", "stupid", "moron"))]
    assert sum(r.predicted for r in insults) >= 0.9 * len(insults)
