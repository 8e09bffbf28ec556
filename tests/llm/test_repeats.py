import re

from truegauge.llm import repeats


def brute(rows, least):
    """(key, start, length) to remove, by comparing every unit with all before it."""
    docs = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for key, text in docs:
        at, run, blank = 0, [], []
        for part in re.split(r"(?<=\n)|(?<=[.!?] )", text) + [None]:
            words = None if part is None else part.lower().split()
            if words or words is None:
                body = words and " ".join(words)
                if words and body in seen:
                    run.append((key, at, len(part), len(words)))
                else:
                    if sum(r[3] for r in run) >= least:
                        out += [r[:3] for r in run]
                    run = []
                    seen.add(body)
            at += len(part or "")
    return sorted(out, key=repr)


PASSAGE = "The quick brown fox jumps over the lazy dog. It then sits down near the old river bank. Nobody knows why it does so every day."
ROWS = [
    (5, f"Intro words of five here. {PASSAGE} Tail of five."),
    (2, f"{PASSAGE}\n\nOther line here."),
    (7, "Totally clean text without any repeats at all. Yes. No."),
    (8, "Yes. No. Another clean one that says yes."),
    (9, f"mid sentence {PASSAGE.upper()}  \n  and  THE quick brown fox jumps over the lazy dog."),
    (10, f"{PASSAGE}\n{PASSAGE}\n"),
    (11, None), (12, ""), (13, " \n \n"), (None, PASSAGE), (2, f"{PASSAGE}\n\nOther line here."),
    (14, "long line of words that goes on and on " * 4000),
]


def table(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, doc int, _spans string")


def test_equals_brute_force(spark):
    for least in (1, 8, 20):
        got = repeats.removed_units(table(spark), min_words=least).collect()
        assert sorted(((r.key, r.start, r.length) for r in got), key=repr) == brute(ROWS, least)


def test_texts_without_repeats(spark):
    kept = repeats.without_repeats(table(spark))
    assert kept.columns == ["doc_id", "text", "doc", "_spans"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    gone = brute(ROWS, repeats.MIN_WORDS)
    want = []
    for key, text in ROWS:
        for _, start, length in sorted((g for g in gone if g[0] == key), reverse=True, key=lambda g: g[1]):
            text = text[:start] + text[start + length :]
        want.append((key, text))
    assert got == sorted(want, key=repr)
    assert repeats.without_repeats(table(spark).limit(0)).count() == 0


def test_clean_documents_are_left_alone(spark):
    got = {r.key for r in repeats.removed_units(table(spark)).collect()}
    assert got.isdisjoint({7, 8, 11, 12, 13, 14}) and {5, 10} <= got
