"""Phrase collocations: Apriori candidates counted by broadcast double-array tries.

1. Tasks gather documents in chunks of about ``CHUNK`` words. Words are counted by plain
   grouping; those that are frequent in their language get numbers, the others, and the
   ends of pieces, are gaps that no phrase crosses.
2. A phrase can only be frequent if its shorter parts are. So phrases are found size by
   size: each frequent one gets a number, and one that is a word longer is the pair of the
   numbers at two neighbouring positions. Such pairs are keys, spread evenly and one to
   one. Chunks send the distinct ones, packed, to ranges of keys, which add up, number
   those that are frequent, and answer; a range states each frequent phrase once.
3. The distinct candidates become double-array tries of bounded size (``TRIE`` phrases),
   dealt by their first two words. Up to ``BROADCAST`` bytes of tries are broadcast per
   pass over the chunks; more candidates are more passes. In a pass the states of all
   positions of a chunk advance together, one word further at each level, and accepting
   states are counted by bincount. Tasks send counts in slices, which are added up.
4. Scores, nested phrases and the first of each language are DataFrame functions.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from truegauge.llm.lm import expand, expand_sorted, squeeze, squeeze_sorted
from truegauge.llm.shared import stored, tasks_for

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has this part of its count, in hundredths.
NESTED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Parts of a language that are ranked on their own first.
PARTS = 32
#: Words of a chunk, positions per range of keys, phrases of a trie, bytes of tries per
#: pass, and states of a slice.
CHUNK, RANGE, TRIE, BROADCAST, SLICE = 1 << 20, 1 << 20, 1 << 18, 1 << 25, 1 << 15

_MARK = b"\xff"
#: A-Z to lower case, signs and line ends to the mark, which no UTF-8 text holds.
_TABLE = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, with the mark between pieces and at the end."""
    body = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(_MARK, b" \xff ")
    # Of the characters that split() parts at, only blank and tab are left.
    return [*body.split(), _MARK]


# ------------------------------------------------------------------ words to numbers


def chunked(docs: DataFrame, text: str, lang: str, chunk: int) -> DataFrame:
    """Rows of (chunk, tokens, langs, words, counts); 0 in tokens is a mark."""
    names = ["tokens", "langs", "words", "counts"]

    def pack(number: dict[str, dict[bytes, int]], tokens: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        counts = np.bincount(flat, minlength=1 + sum(len(w) - 1 for w in number.values()))
        langs, words, local = [], [], []
        for name, own in number.items():
            own.pop(_MARK)
            langs += [name] * len(own)
            words += [w.decode("utf-8", "replace") for w in own]
            local += own.values()
        order = np.argsort(np.array(local, np.int64))
        columns = [pa.array([squeeze(flat.astype("<i4"))], pa.binary()), *[pa.array([pa.array(x, k).take(pa.array(order))], pa.list_(k)) for x, k in ((langs, pa.string()), (words, pa.string()))], pa.array([counts[1:]], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tokens, size, used = {}, [], 0, itertools.count(1)
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                own = number.setdefault(name.as_py(), {_MARK: 0})
                mine = [own[w] if w in own else own.setdefault(w, next(used)) for w in words_of(value.as_py())]
                tokens.append(np.array(mine, np.int32))
                size += len(mine)
                if size >= chunk:
                    yield pack(number, tokens)
                    number, tokens, size, used = {}, [], 0, itertools.count(1)
        if tokens:
            yield pack(number, tokens)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    rows = rows.mapInArrow(gather, "tokens binary, langs array<string>, words array<string>, counts array<long>")
    return stored(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def frequent_words(chunks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, id, f) of the frequent words, ids from 0 on, and (lang, n) of all words."""
    rows = chunks.select(F.inline(F.arrays_zip("langs", "words", "counts")))
    counts = rows.groupBy(F.col("langs").alias("lang"), F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    counts = stored(counts, "word-counts")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    known = stored(counts.where(F.col("f") >= least).withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33)
    # A number per task: the ids of its words start there.
    per_task = {r["part"]: r["n"] for r in known.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, first = [], 0
    for p in sorted(per_task):
        starts.append((p, first))
        first += per_task[p]
    first_of = known.sparkSession.createDataFrame(starts, "part long, first long")
    numbered = known.withColumn("part", part).join(first_of, "part")
    return stored(numbered.select("lang", "word", (F.col("first") + F.col("at") - F.shiftleft("part", 33)).cast("int").alias("id"), "f"), "word-ids"), sizes


def encoded(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of (chunk, ids): numbers of frequent words, -1 for gaps of any length."""
    asked = chunks.select(F.col("chunk").alias("asking"), F.posexplode(F.arrays_zip("langs", "words")).alias("at", "w"))
    found = asked.select("asking", "at", F.col("w.langs").alias("lang"), F.col("w.words").alias("word")).join(words.select("lang", "word", "id"), ["lang", "word"]).select("asking", "at", "id")

    def encode(_, left: pa.Table, found: pa.Table) -> pa.Table:
        tokens = expand(left.column("tokens")[0].as_py(), "<i4")
        ids = np.full(int(tokens.max(initial=0)) + 1, -1, np.int32)
        ids[found.column("at").to_numpy() + 1] = found.column("id").to_numpy()
        flat = ids[tokens]
        flat = flat[(flat >= 0) | np.concatenate([[True], flat[:-1] >= 0])]
        return pa.table({"chunk": left.column("chunk"), "ids": pa.array([squeeze(flat)], pa.binary()), "positions": [len(flat)]})

    rows = chunks.select("chunk", "tokens").groupBy("chunk").cogroup(found.groupBy("asking")).applyInArrow(encode, "chunk long, ids binary, positions long")
    return stored(rows, "encoded")


# -------------------------------------------------------------------- candidates


def grams_at(ids: np.ndarray, pairs: np.ndarray | None, size: int) -> np.ndarray:
    """Where phrases of ``size`` begin that have no gap and, given ``pairs``, only such pairs."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ok = np.ones(n, bool)
    if pairs is None:
        for k in range(size):
            ok &= ids[k : n + k] >= 0
    else:
        for k in range(size - 1):
            ok &= pairs[k : n + k]
    return np.nonzero(ok)[0]


#: Odd factors that spread keys; each has an inverse.
_MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def spread(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of 2 * ``bits`` bits in an even order, one to one."""
    mask, half = np.uint64((1 << 2 * bits) - 1), np.uint64(bits)
    for odd in _MIX:
        keys = keys * np.uint64(odd) & mask
        keys = keys ^ keys >> half
    return keys


def unspread(keys: np.ndarray, bits: int) -> np.ndarray:
    """The keys that ``spread`` was given."""
    mask, half = np.uint64((1 << 2 * bits) - 1), np.uint64(bits)
    for odd in reversed(_MIX):
        keys = keys ^ keys >> half
        keys = keys * np.uint64(pow(odd, -1, 1 << 64)) & mask
    return keys


def _numbers(data: bytes) -> np.ndarray:
    """Numbers of a chunk's positions, -1 where there is none."""
    numbers = expand(data, "<u4").astype(np.int64)
    numbers[numbers == 0xFFFFFFFF] = -1
    return numbers


def _keys(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbours have numbers, and the spread keys of the two."""
    at = grams_at(numbers, None, 2)
    key = numbers[at].astype(np.uint64) << np.uint64(bits) | numbers[at + 1].astype(np.uint64)
    return at, spread(key, bits)


def longer(rows: DataFrame, used: int, least: int, ranges: int, again: bool) -> tuple[DataFrame, DataFrame | None, int]:
    """From numbers of phrases at positions to those of phrases that are one word longer.

    ``rows`` are (chunk, numbers) with numbers below ``used``; a longer phrase is the key of
    two neighbours. Returns (number, left, right) of all that occur ``least`` times, each
    once; ``rows`` with the new numbers, if asked for ``again``; and how many there are.
    """
    bits = max(1, (used - 1).bit_length())
    if bits > 32:
        raise ValueError(f"{used} phrases of one size; numbers have 32 bits")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = np.unique(_keys(_numbers(data.as_py()), bits)[1], return_counts=True)
                where = (keys >> np.uint64(max(0, 2 * bits - 32))) * np.uint64(ranges) >> np.uint64(min(32, 2 * bits))
                cuts = np.concatenate([[0], np.nonzero(np.diff(where))[0] + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                columns = [pa.array([int(where[a]) for a, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.int64()), pa.array([squeeze_sorted(keys[a:b]) for a, b in spans], pa.binary()), pa.array([squeeze(np.minimum(counts[a:b], least).astype("<u4")) for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "asking", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        keys = [expand_sorted(x.as_py()) for x in group.column("keys")]
        counts = np.concatenate([expand(x.as_py(), "<u4") for x in group.column("counts")])
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        full = np.bincount(of, weights=counts) >= least
        nth = np.cumsum(full).astype(np.uint64) - np.uint64(1)
        span = group.column("range")[0].as_py()
        out = [(None, span, int(full.sum()), squeeze_sorted(distinct[full]), None)]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        for chunk, first, end in zip(group.column("asking").to_pylist(), [0, *ends], ends) if again else ():
            mine = of[first:end]
            out.append((chunk, span, end - first, squeeze_sorted(nth[mine[full[mine]]]), np.packbits(full[mine]).tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])], names=["asking", "range", "n", "data", "bits"])

    asked = rows.select("chunk", "numbers").mapInArrow(ask, "range long, asking long, keys binary, counts binary")
    # As many tasks as there are ranges, whatever the session's number is.
    asked = asked.repartition(ranges, "range")
    answers = stored(asked.groupBy("range").applyInArrow(add_up, "asking long, range long, n long, data binary, bits binary"), "frequent-keys")
    frequent = answers.where("asking is null")
    # A number per range: its phrases are numbered from there on.
    starts, total = {}, 0
    for r in frequent.select("range", "n").orderBy("range").collect():
        starts[r["range"]] = total
        total += r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = unspread(expand_sorted(r["data"]), bits)
                columns = [np.arange(r["n"]) + starts[r["range"]], keys >> np.uint64(bits), keys & np.uint64((1 << bits) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["number", "left", "right"])

    def renumber(_, left: pa.Table, answers: pa.Table) -> pa.Table:
        numbers = _numbers(left.column("numbers")[0].as_py())
        at, keys = _keys(numbers, bits)
        new, parts = np.full(len(numbers), 0xFFFFFFFF, "<u4"), [np.empty(0, "<u4")]
        for r in answers.sort_by("range").to_pylist():
            parts.append(np.full(r["n"], 0xFFFFFFFF, "<u4"))
            full = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool)
            parts[-1][full] = expand_sorted(r["data"]) + np.uint64(starts[r["range"]])
        new[at] = np.concatenate(parts)[np.unique(keys, return_inverse=True)[1]]
        return pa.table({"chunk": left.column("chunk"), "numbers": pa.array([squeeze(new)], pa.binary())})

    found = frequent.select("range", "n", "data").mapInArrow(read, "number long, left long, right long")
    if not again:
        return found, None, total
    answers = answers.where("asking is not null")
    return found, stored(rows.select("chunk", "numbers").groupBy("chunk").cogroup(answers.groupBy("asking")).applyInArrow(renumber, "chunk long, numbers binary"), "numbers"), total


def candidates(chunks: DataFrame, used: int, least: int, longest: int) -> DataFrame:
    """The phrases (w1, ..., -1 beyond the end) that occur ``least`` times or more, each once.

    ``used`` is how many numbers of words there are.
    """
    positions = int(chunks.agg(F.coalesce(F.sum("positions"), F.lit(0))).first()[0])
    ranges = tasks_for(positions, RANGE)
    rows, shorter, sizes = chunks.select("chunk", F.col("ids").alias("numbers")), None, []
    for size in range(2, longest + 1):
        found, rows, used = longer(rows, used, least, ranges, size < longest)
        if shorter is None:
            found = found.select("number", F.col("left").cast("int").alias("w1"), F.col("right").cast("int").alias("w2"))
        else:
            # The words of the left part, then the last one of the right part.
            last = shorter.select(F.col("number").alias("right"), F.col(f"w{size - 1}").alias(f"w{size}"))
            found = found.join(shorter.withColumnRenamed("number", "left"), "left").join(last, "right").drop("left", "right")
        shorter = stored(found, "candidates")
        sizes.append(shorter.select(*[F.col(f"w{k}") if k <= size else F.lit(-1).alias(f"w{k}") for k in range(1, longest + 1)]))
        if not used:
            break
    return functools.reduce(DataFrame.unionByName, sizes)


# -------------------------------------------------------------------------- tries


def build_trie(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array over the rows of ``grams`` (words, -1 beyond the end): symbols, base, check.

    A word is the place of its number among ``symbols``. From state s word c leads to
    base[s] + c if check of that is s; state 0 is the root, and unused states check -1.
    """
    symbols = np.unique(grams[grams >= 0])
    code = np.where(grams >= 0, np.searchsorted(symbols, grams), -1)
    code = code[np.lexsort(code.T[::-1])]
    # Nodes by level: each distinct prefix, with its parent's node and its last word.
    parent, label, node, made = [], [], np.zeros(len(code), np.int64), 1
    for level in range(code.shape[1]):
        has = np.nonzero(code[:, level] >= 0)[0]
        if not len(has):
            break
        edge = np.stack([node[has], code[has, level]], axis=1)
        new = np.concatenate([[True], (edge[1:] != edge[:-1]).any(axis=1)])
        parent.append(edge[new, 0])
        label.append(edge[new, 1])
        node[has] = made + np.cumsum(new) - 1
        made += int(new.sum())
    parent, label = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (parent, label))
    order = np.argsort(parent, kind="stable")
    many = np.bincount(parent, minlength=made)
    starts = np.cumsum(many) - many
    slot = np.zeros(made, np.int64)
    base_of = np.zeros(made, np.int64)
    used = np.zeros(made + len(symbols) + 1024, bool)
    used[0] = True
    low = 1
    # Nodes of several children, widest first, take the first base that fits them all.
    for n in np.argsort(-many, kind="stable")[: int((many > 1).sum())].tolist():
        children = order[starts[n] : starts[n] + many[n]]
        c = label[children]
        span = c - c[0]
        while used[low]:
            low += 1
        at, window = low, max(16, 1024 // len(c))
        while True:
            if at + window + int(span[-1]) >= len(used):
                used = np.concatenate([used, np.zeros(len(used) + window + int(span[-1]), bool)])
            free = np.nonzero(~used[at : at + window])[0] + at
            fits = free[~used[free[:, None] + span].any(axis=1)] if len(free) else free
            if len(fits):
                break
            at, window = at + window, min(2 * window, max(16, 65536 // len(c)))
        places = int(fits[0]) + span
        used[places] = True
        base_of[n] = places[0] - c[0]
        slot[children + 1] = places
    # A node of one child takes any free place for it.
    single = np.nonzero(many == 1)[0]
    free = np.nonzero(~used)[0]
    if len(free) < len(single):
        free = np.concatenate([free, len(used) + np.arange(len(single))])
    free = free[: len(single)]
    child = order[starts[single]]
    slot[child + 1] = free
    base_of[single] = free - label[child]
    size = int(slot.max(initial=0)) + 1
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    base[slot] = base_of
    check[slot[1:]] = slot[parent]
    return symbols.astype(np.int32), base, check


def walk(ids: np.ndarray, symbols: np.ndarray, base: np.ndarray, check: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Per level, the states that positions are in after so many words; dead ones are left out."""
    if not len(symbols) or not len(ids):
        return
    code = np.minimum(np.searchsorted(symbols, ids), len(symbols) - 1)
    code = np.where(symbols[code] == ids, code, -1).astype(np.int64)
    at = np.nonzero(code >= 0)[0]
    state = np.zeros(len(at), np.int64)
    for level in range(longest):
        inside = at + level < len(code)
        at, state = at[inside], state[inside]
        word = code[at + level]
        to = base[state] + word
        alive = (word >= 0) & (to >= 0) & (to < len(check))
        alive[alive] = check[to[alive]] == state[alive]
        at, state = at[alive], to[alive]
        yield state


def spelled(states: np.ndarray, symbols: np.ndarray, base: np.ndarray, check: np.ndarray, longest: int) -> np.ndarray:
    """The words that lead to each state, -1 beyond the end."""
    back, now = [], states.astype(np.int64)
    for _ in range(longest):
        up = np.where(now > 0, check[now], 0).astype(np.int64)
        back.append(np.where(now > 0, symbols[np.where(now > 0, now - base[up], 0)], -1))
        now = up
    words = np.stack(back[::-1], axis=1)
    depth = (words >= 0).sum(axis=1)
    return np.stack([np.where(k < depth, words[np.arange(len(words)), np.minimum(longest - depth + k, longest - 1)], -1) for k in range(longest)], axis=1)


def tries(phrases: DataFrame, longest: int, size: int) -> DataFrame:
    """Rows of (trie, bytes, symbols, base, check) over all ``phrases``."""
    words = [f"w{k + 1}" for k in range(longest)]
    parts = tasks_for(phrases.count(), size)

    def build(group: pa.Table) -> pa.Table:
        arrays = build_trie(np.stack([group.column(w).to_numpy() for w in words], axis=1))
        return pa.table({"trie": group.column("trie")[:1], "bytes": [sum(x.nbytes for x in arrays)], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("symbols", "base", "check"), arrays)}})

    dealt = phrases.withColumn("trie", F.pmod(F.xxhash64("w1", "w2"), F.lit(parts)))
    return stored(dealt.groupBy("trie").applyInArrow(build, "trie long, bytes long, symbols binary, base binary, check binary"), "tries")


def counted(chunks: DataFrame, built: DataFrame, longest: int, least: int, limit: int = BROADCAST) -> DataFrame:
    """(w1, ..., f) of every phrase in the tries that occurs ``least`` times or more."""
    spark = chunks.sparkSession
    words = [f"w{k + 1}" for k in range(longest)]
    bundles: list[list[int]] = [[]]
    room = limit
    # A number and a size per trie.
    for r in built.select("trie", "bytes").orderBy("trie").collect():
        if r["bytes"] > room and bundles[-1]:
            bundles.append([])
            room = limit
        bundles[-1].append(r["trie"])
        room -= r["bytes"]

    def one_pass(bundle: list[int]) -> DataFrame:
        # At most ``limit`` bytes, or one trie of bounded size.
        rows = built.where(F.col("trie").isin(bundle)).select("trie", "symbols", "base", "check").collect()
        sent = spark.sparkContext.broadcast([(r["trie"], *(bytes(r[c]) for c in ("symbols", "base", "check"))) for r in rows])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = [(name, *(np.frombuffer(x, np.int32) for x in rest)) for name, *rest in sent.value]
            totals = [np.zeros(len(a[2]), np.int64) for a in arrays]
            for batch in batches:
                for data in batch.column(0):
                    ids = expand(data.as_py(), "<i4")
                    for (_, symbols, base, check), total in zip(arrays, totals):
                        for level, states in enumerate(walk(ids, symbols, base, check, longest)):
                            # One word alone is no phrase.
                            if level and len(states):
                                found = np.bincount(states)
                                total[: len(found)] += found
            for (name, *_), total in zip(arrays, totals):
                for first in range(0, len(total), SLICE):
                    part = total[first : first + SLICE]
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first // SLICE]), pa.array([squeeze(part)], pa.binary())], ["trie", "slice", "counts"])

        return stored(chunks.select("ids").mapInArrow(count, "trie long, slice long, counts binary"), "shard-counts")

    def add_up(group: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in group.column("counts"):
            part = expand(x.as_py(), "<i8")
            total[: len(part)] += part
        at = np.nonzero(total >= least)[0]
        return pa.table({"trie": np.full(len(at), group.column("trie")[0].as_py()), "state": at + group.column("slice")[0].as_py() * SLICE, "f": total[at]})

    def spell(_, left: pa.Table, found: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(left.column(c)[0].as_py(), np.int32) for c in ("symbols", "base", "check")]
        grams = spelled(found.column("state").to_numpy(), *arrays, longest)
        return pa.table({**{w: pa.array(grams[:, k], pa.int32()) for k, w in enumerate(words)}, "f": found.column("f")})

    passes = [one_pass(b) for b in bundles]
    shards = passes[0]
    for more in passes[1:]:
        shards = shards.union(more)
    sums = shards.groupBy("trie", "slice").applyInArrow(add_up, "trie long, state long, f long")
    sums = sums.withColumnRenamed("trie", "of")
    rows = built.select("trie", "symbols", "base", "check").groupBy("trie").cogroup(sums.groupBy("of")).applyInArrow(spell, ", ".join([*(f"{w} int" for w in words), "f long"]))
    return stored(rows, "phrases")


# ------------------------------------------------------------------------- phrases


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, nested: int = NESTED, chunk: int = CHUNK, trie: int = TRIE, broadcast: int = BROADCAST) -> DataFrame:
    """The best phrases of 2 to ``longest`` words per language: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` are the counts of the phrase and of its two parts at the cut of
    the lowest score, ``n`` that of all words of the language. Null texts have no words, a
    null language is ``und``. Repeated rows count as often as they occur. Columns beside
    text and lang are not used. Without a candidate, or without rows, there are no rows.
    """
    chunks = chunked(docs, text, lang, chunk)
    known, sizes = frequent_words(chunks, least)
    texts = encoded(chunks, known)
    found = counted(texts, tries(candidates(texts, known.count(), least, longest), longest, trie), longest, least, broadcast)

    # Phrases and words by their numbers; of all of them the counts are known.
    ids = F.filter(F.array(*[f"w{k + 1}" for k in range(longest)]), lambda w: w >= 0)
    phrases = stored(found.select(ids.alias("gram"), "f"), "counted")
    every = phrases.unionByName(known.select(F.array("id").alias("gram"), "f"))

    size = F.size("gram")
    cuts = phrases.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("gram", "a", "k", F.slice("gram", F.lit(1), F.col("k")).alias("left"), F.slice("gram", F.col("k") + 1, size).alias("right"))
    cuts = cuts.join(every.select(F.col("gram").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("gram").alias("right"), F.col("f").alias("r")), "right")
    exact = F.expr(f"cast((cast({SCALE} as decimal(18,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0)) as long)")
    lowest = cuts.withColumn("score", exact).groupBy("gram").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("gram", "cut.*")

    inner = phrases.where(size > 2).select("gram", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("f", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("m") + 1), lambda i: F.slice("gram", i, F.col("m")))).alias("gram"))
    around = inner.groupBy("gram").agg(F.max("f").alias("longer"))
    kept = lowest.join(around, "gram", "left").where(f"longer is null or cast(100 as decimal(18,0)) * cast(longer as decimal(20,0)) < cast({nested} as decimal(18,0)) * cast(a as decimal(20,0))")

    spelled_out = kept.select("gram", "a", "l", "r", "score", F.posexplode("gram").alias("at", "id")).join(known.select("id", "lang", "word"), "id")
    spelled_out = spelled_out.groupBy("gram", "a", "l", "r", "score", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The first of each part of a language, then of those few: no language in one task.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).orderBy(*order)
    spelled_out = spelled_out.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= top)
    best = Window.partitionBy("lang").orderBy(*order)
    ranked = spelled_out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
