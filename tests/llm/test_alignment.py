import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from truegauge.llm import alignment, queries

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
KNOWN = alignment.Aligner(A, B)
PLAIN = Tokenizer.from_file(A)
PLAIN.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
BYTES = alignment.visible_bytes()


def whole_groups(text):
    """Groups of a whole text, offset by offset."""
    if not text:
        return []
    a, b = PLAIN.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    in_a = [bytes(BYTES[c] for c in PLAIN.id_to_token(i)) for i in a]
    in_b = [bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(PIECES.id_to_piece, b))]
    if b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
        return []
    out, left, right, i, j = [], 0, 0, 0, 0
    group = ([], [])
    while i < len(a) or j < len(b):
        if left <= right and i < len(a):
            group[0].append(a[i])
            left, i = left + len(in_a[i]), i + 1
        else:
            group[1].append(b[j])
            right, j = right + len(in_b[j]), j + 1
        if left == right and group[0] and group[1]:
            out.append(group)
            group = ([], [])
    return out


def expected(texts):
    groups = [whole_groups(t) for t in texts]
    held = defaultdict(int)
    for g in groups:
        for pair in {(x, y) for p, q in g for x in p for y in q}:
            held[pair] += 1
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    rows = []
    for g in groups:
        links = [(x, y) for p, q in g for x in p for y in q]
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        rows.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return rows


PARTS = st.sampled_from(["the", " ", "  ", "\n", "\n\n", "\t", " \n", "don't", "été", "中文字", "🙂", "\x1c", "\x85", "᠎", "　", "\xa0", "<|endoftext|>", "<s>", "<0x41>", "▁", "x1,000", "'ll", "...", "\x00"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=6)), max_size=14))
def test_units_give_the_groups_of_the_whole_text(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert groups_of(KNOWN.units(text)) == whole_groups(text)


def groups_of(units):
    if units == [" "]:
        return []
    found = []
    for record in KNOWN.records(list(dict.fromkeys(units))) if units else []:
        n_a, n_b, n, *rest = np.frombuffer(record, "<i4").tolist()
        if n < 0:
            return []
        a, b, in_a, in_b = rest[:n_a], rest[n_a : n_a + n_b], rest[n_a + n_b : n_a + n_b + n], rest[n_a + n_b + n :]
        groups = []
        for x, y in zip(in_a, in_b):
            groups.append((a[:x], b[:y]))
            a, b = a[x:], b[y:]
        assert not a and not b
        found.append(groups)
    number = {u: i for i, u in enumerate(dict.fromkeys(units))}
    return [g for u in units for g in found[number[u]]]


def test_a_unit_that_is_not_spelled_leaves_the_others_alone():
    text = "one ▁two three four"
    by_unit = dict(zip(KNOWN.units(text), KNOWN.align(KNOWN.units(text))))
    assert [np.frombuffer(by_unit[u], "<i4")[2] < 0 for u in by_unit] == ["▁" in u for u in by_unit]
    assert groups_of([" one", " three", " four"]) == whole_groups("one three four")


@pytest.mark.parametrize("texts", [["the cat  ", " 中 sat"], ["one\n", "\nbar"], ["x ", "  y"], ["a\t", " \tb c ", "  中"]])
def test_blanks_at_the_ends_of_neighbouring_texts_stay_apart(texts):
    units = [alignment.Aligner.units(KNOWN, t) for t in texts]
    KNOWN.clear()
    KNOWN.records(list(dict.fromkeys(u for x in units for u in x)))
    assert [groups_of(x) for x in units] == [whole_groups(t) for t in texts]


def test_links_by_blocks_are_wide_enough_to_number_pairs(monkeypatch):
    units = [" unbelievable", " été", " 中文字", "\nx", " cat"]
    records = KNOWN.align(units)
    told = alignment.Units(np.frombuffer(b"".join(records), "<i4"), np.array([len(r) // 4 for r in records]))
    unit, code = told.links()
    monkeypatch.setattr(alignment, "BLOCK", 2)
    again = told.links()
    assert unit.dtype == code.dtype == np.int64 and len(unit) == (told.in_a * told.in_b).sum()
    assert unit.tolist() == again[0].tolist() and code.tolist() == again[1].tolist()


def test_both_encoders_of_a_agree():
    slow = alignment.Aligner._encoder(A, {"merges": [["x", "y"]], "vocab": {}}, {})
    for text in ("The cat", " don't  <|endoftext|>\n\n été 中文 🙂", " 1234567 x" * 50):
        assert KNOWN.encode_a(text) == slow(text)


def digests(found):
    return {r.doc_id: tuple(r)[1:] for r in queries.alignment_digests(found).collect()}


@pytest.mark.parametrize("chunk", [200, 3_000_000])
def test_counts_over_the_corpus_by_brute_force(spark, chunk):
    texts = ["The cat sat.", "the cat sat on the mat", "the cat sat", None, "", " ", "a ▁ b", "unbelievable éèê", "<|endoftext|> x", "línea\nuna\n\ndos", "z" * 5000, "中文 mixed 🙂" * 40, "the cat sat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("chunk", F.lit("clash")).withColumn("n", F.lit(None))
    found = digests(alignment.alignments(docs.repartition(3), A, B, chunk=chunk))
    assert found == {i: row for i, row in enumerate(expected(texts))}


def test_pair_table_marks_the_usual_partner(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cat", "cat", "cats"])], "doc_id long, text string")
    rows = {(r.a_id, r.b_id): (r.documents, r.best) for r in alignment.pair_counts(docs, A, B).collect()}
    pair = (PLAIN.encode(" cat").ids[0], PIECES.encode("cat")[0])
    assert rows[pair][0] >= 2 and rows[pair][1]


def test_empty_table_null_and_repeated_keys(spark):
    schema = "doc_id long, text string"
    assert alignment.alignments(spark.createDataFrame([], schema), A, B).count() == 0
    rows = alignment.alignments(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], schema), A, B).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and {r.count_sum for r in rows} == {6}


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], expected([d.text for d in docs])))
    rows = queries.QUERIES["op11_tokenizer_alignment"](spark, data).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(docs)
