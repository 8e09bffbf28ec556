import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_packing import check_whole, plain_ids
from truegauge.llm import mixing
from truegauge.llm.queries import QUERIES
from truegauge.llm.shared import stored, table

SMALL = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(seen[name]) == docs.count()
    score = {r.doc_id: r.predicted for r in QUERIES["op1_string_kernel_toxicity"](spark, SMALL).collect()}
    assert seen["toxicity"] == {d: t for d, t in texts.items() if not score[d]}
    components = {r.component_id for r in QUERIES["op8_simhash_near_duplicates"](spark, SMALL).collect()}
    assert set(seen["near_duplicates"]) >= components & set(seen["toxicity"])
    assert seen["secrets"].keys() == seen["near_duplicates"].keys() == seen["mixing"].keys()
    assert seen["secrets"] == seen["mixing"]
    planted = re.compile(r'(?i)token = "[0-9a-f]{16,}"')
    assert any(planted.search(t) for t in seen["near_duplicates"].values()) and not any(planted.search(t) for t in seen["secrets"].values())
    rows = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()]
    assert check_whole(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    pieces = Counter(r["doc_id"] for r in rows)
    assert pieces == {d: -(-(len(plain_ids(t)) + 1) // 4096) for d, t in seen["mixing"].items()}


def test_odd_documents_pass_all_stages(spark, tmp_path):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "a", 0), (None, "only one text here", "x", "a", None), (3, "word " * 30_000, "en", "b", 1)]
    folder = f"file://{tmp_path}/t"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (3, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    # The null and empty texts share fingerprint zero: the smallest id stays, once.
    assert Counter(r.doc_id for r in got) == {1: 1, None: 1, 3: 8}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_sequences_follow_the_mixed_order(spark):
    # Equally many documents of each source, mixed three to one until the first is used up.
    rows = [(i, "word " * (40 + i * 37 % 500), "ab"[i % 2]) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = stored(mixing.interleaved(docs, weights={"a": 3.0, "b": 1.0}, block=4096), "test-mixed")
    got = corpus_pipeline.STAGES[-1][1](spark, mixed, "").orderBy("sequence_id").collect()
    tokens = [(r.length, r.doc_id % 2 == 0) for r in got]
    both = sum(n for n, _ in tokens) * 2 // 3  # all of a and a third of b
    at, shares = 0, [[0, 0] for _ in range(8)]
    for n, is_a in tokens:
        if at < both * 0.9:
            shares[int(at / both * 0.9999 / 0.9 * 8)][is_a] += n
        at += n
    assert all(0.7 < a / (a + b) < 0.8 for b, a in shares)
    assert check_whole([r.asDict() for r in got], 4096) <= 1.01 * at / 4096
