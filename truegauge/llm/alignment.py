"""Alignment of two tokenizers' tokens over the same texts.

A text is encoded by A (byte-level BPE) and by B (pieces). The cumulative ends of A's
tokens and of B's tokens are keys of two dictionaries, end to index; the keys that both
hold, in order, slice both id lists into groups, and every A token of a group is linked
with every B token of it. How often an id pair is linked, counted in documents over the
whole corpus, says which partner of an A id is its usual one.

How it runs: a text falls into units at blanks and line ends between two visible
characters. Neither tokenizer joins anything across those places (for B that is read off
its vocabulary), so both end there, and a unit met before needs no second encoding.
Tasks gather documents in chunks of about ``CHUNK`` characters: the distinct units with
their groups, the documents as unit numbers, and the distinct linked id pairs with the
number of the chunk's documents that hold them. The pairs are added up by plain grouping,
so a pair is one row per chunk however frequent it is, and the totals join back to the
chunks, which sum them over their documents.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.lm import expand, squeeze
from truegauge.llm.shared import stored

CHUNK = 3_000_000
#: A worker remembers about so many units of at most this many characters, and encodes so
#: many new ones at a time.
UNITS, UNIT_CHARS, BATCH = 150_000, 40, 20_000
#: Groups that are expanded to links at a time.
BLOCK = 1 << 15
#: A pair of ids as one number: A's above these bits, B's below.
LOW = 32


def visible_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, back to the byte.

    Printable bytes stand for themselves, the others for the characters from U+0100 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that A and B share, in order, and how many tokens of each end up to there."""
    a_at, b_at = dict(zip(a_ends, itertools.count(1))), dict(zip(b_ends, itertools.count(1)))
    # Ends grow, so the keys of a dictionary are in order.
    common = list(filter(a_at.__contains__, b_at))
    return np.array(common, np.int64), *(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (a_at, b_at))


class Aligner(dict):
    """Unit -> [A tokens, B tokens, groups, A ids, B ids, A's group sizes, B's] as int32 bytes.

    The third number is -1 for a unit whose tokens do not spell it. Units that are not
    known are encoded as one text, in which they are units too; those that would not be,
    as blanks at an end of a text would join others there, are encoded alone.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.b = SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            entries = json.load(file)
        byte = visible_bytes()
        vocabulary = {i: bytes(byte[c] for c in t) for t, i in entries["model"]["vocab"].items() if all(c in byte for c in t)}
        special = {t["id"]: t["content"].encode() for t in entries["added_tokens"]}
        self.encode_a = self._encoder(a_path, entries["model"], {i: t for i, t in vocabulary.items() if i not in special})
        a_bytes = vocabulary | special
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # A line end starts a unit only if no piece holds one, a blank if none has one inside.
        starts = " " * all("▁" not in p.lstrip("▁") for p in pieces) + "\n" * all("\n" not in p for p in pieces)
        # A unit goes on over blanks at which it is not cut; run by run, not by character.
        self.unit = re.compile(rf"\s*\S+(?:(?![{starts}]\S)\s+\S*)*+") if starts else None
        #: What is cut off on both sides wherever it stands between others of its kind.
        self.inner = re.compile(rf"[{starts}]\S(?:.*\S)?", re.DOTALL) if starts else re.compile(r"(?!)")

    @staticmethod
    def _encoder(path: str, model: dict, vocabulary: dict[int, bytes]) -> Callable[[str], list[int]]:
        """Text to ids of A, special strings as plain text.

        Where every merge makes the next id, ids are ranks, and the encoder made for
        ranks gives the same ids several times as fast.
        """
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if all(model["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(pairs)):
            import public_tokenizers
            import tiktoken

            ranks = {t: i for i, t in vocabulary.items()}
            return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return lambda text: whole.encode(text, add_special_tokens=False).ids

    def units(self, text: str) -> list[str]:
        """The units of a blank and ``text``."""
        whole = " " + text
        return self.unit.findall(whole) if self.unit and not whole.isspace() else [whole]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B; None if either does not spell the text."""
        a = self.encode_a(text)
        # B puts a blank before what it encodes. Behind it a line end is a token of its own.
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        body = text.encode()
        for ids, names in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(names.__getitem__, ids)) != body:
                return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, units: list[str]) -> list[bytes]:
        """Records of units that follow one another in a text."""
        found = self.encode("".join(units))
        if found is None:
            if len(units) == 1:
                return [np.array([0, 0, -1], "<i4").tobytes()]
            half = len(units) // 2
            return self.align(units[:half]) + self.align(units[half:])
        a, b = found
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common, a_cuts, b_cuts = common_ends(a_ends.tolist(), b_ends.tolist())
        ends = np.cumsum([len(u.encode()) for u in units])
        to_a, to_b, to_group = (np.searchsorted(x, ends, side="right") for x in (a_ends, b_ends, common))
        n_a, n_b, n = (np.diff(x, prepend=0) for x in (to_a, to_b, to_group))
        size = 3 + n_a + n_b + 2 * n
        at = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), "<i4")
        flat[at], flat[at + 1], flat[at + 2] = n_a, n_b, n
        flat[_ranges(at + 3, n_a)], flat[_ranges(at + 3 + n_a, n_b)] = a, b
        flat[_ranges(at + 3 + n_a + n_b, n)] = np.diff(a_cuts, prepend=0)
        flat[_ranges(at + 3 + n_a + n_b + n, n)] = np.diff(b_cuts, prepend=0)
        body, cuts = flat.tobytes(), (4 * at).tolist()
        return [body[x:y] for x, y in zip(cuts, [*cuts[1:], len(body)])]

    def records(self, units: list[str]) -> list[bytes]:
        """The records of distinct units."""
        found = list(map(self.get, units))
        missing = [i for i, r in enumerate(found) if r is None]
        inner = [i for i in missing if self.inner.fullmatch(units[i])]
        parts = [inner[first : first + BATCH] for first in range(0, len(inner), BATCH)]
        for part in [*parts, *([i] for i in sorted(set(missing).difference(inner)))]:
            for i, record in zip(part, self.align([units[i] for i in part])):
                found[i] = record
                if len(units[i]) <= UNIT_CHARS and len(self) < UNITS:
                    self[units[i]] = record
        # Units of other texts than these, of another language, say.
        if len(self) >= UNITS and 4 * len(missing) > 3 * len(units):
            self.clear()
        return found


def numbering() -> defaultdict[str, int]:
    """Numbers in the order in which units are asked for first."""
    return defaultdict(itertools.count().__next__)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process, so that units are remembered between tasks."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after another."""
    skip = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - skip, lengths)


class Units:
    """The arrays of a chunk's distinct units."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        at = np.cumsum(sizes, dtype=np.int64) - sizes
        self.n_a, self.n_b, groups = (flat[at + i].astype(np.int64) for i in range(3))
        self.bad = groups < 0
        self.n_groups = np.maximum(groups, 0)
        a_at = at + 3
        b_at = a_at + self.n_a
        ga_at = b_at + self.n_b
        self.a, self.b = flat[_ranges(a_at, self.n_a)].astype(np.int64), flat[_ranges(b_at, self.n_b)].astype(np.int64)
        self.in_a, self.in_b = flat[_ranges(ga_at, self.n_groups)].astype(np.int64), flat[_ranges(ga_at + self.n_groups, self.n_groups)].astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(unit, pair code) of every link: per group, each A token with each B token.

        Groups are expanded a block at a time, which bounds what is held beside the result.
        """
        of_group = np.repeat(np.arange(len(self.n_a), dtype=np.int32), self.n_groups)
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        units, codes = [of_group[:0]], [self.a[:0]]
        for at in range(0, len(of_group), BLOCK):
            block = slice(at, at + BLOCK)
            width, many = self.in_b[block], self.in_a[block] * self.in_b[block]
            nth, across = _ranges(np.zeros(len(many), np.int64), many), np.repeat(width, many)
            a = self.a[np.repeat(first_a[block], many) + nth // across]
            b = self.b[np.repeat(first_b[block], many) + nth % across]
            units.append(np.repeat(of_group[block], many))
            codes.append(a << LOW | b)
        # Numbers of units and of codes are multiplied, beyond 32 bits in a full chunk.
        return np.concatenate(units).astype(np.int64), np.concatenate(codes)

    def texts(self) -> list[str]:
        """The groups of each unit as text: ids of A, a bar, ids of B; semicolons between."""
        # One string per id, not one per token.
        name = list(map(str, range(1 + int(max(self.a.max(initial=0), self.b.max(initial=0))))))
        a, b = (list(map(name.__getitem__, x.tolist())) for x in (self.a, self.b))
        parts, i, j = [], 0, 0
        for x, y in zip(self.in_a.tolist(), self.in_b.tolist()):
            parts.append(f"{a[i]}|{b[j]}" if x == y == 1 else f"{','.join(a[i : i + x])}|{','.join(b[j : j + y])}")
            i, j = i + x, j + y
        cuts = np.cumsum(self.n_groups).tolist()
        return [";".join(parts[x:y]) for x, y in zip([0, *cuts], cuts)]


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of these lengths, which may be empty."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - lengths]


def chunked(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, chunk: int) -> DataFrame:
    """Rows of (chunk, keys, lengths, numbers, sizes, units, codes, counts)."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("lengths", "numbers", "sizes", "units")], T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def pack(keys: list, numbers: list[np.ndarray], records: list[bytes], key_type: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(r) // 4 for r in records], "<i4")
        flat = np.frombuffer(b"".join(records), "<i4")
        units = Units(flat, sizes.astype(np.int64))
        # One unit that the tokens do not spell leaves the whole document without tokens.
        numbers = [n[:0] if units.bad[n].any() else n for n in numbers]
        lengths = np.array([len(n) for n in numbers], "<i4")
        every = np.concatenate([*numbers, np.empty(0, np.int32)])
        unit, code = units.links()
        codes, code = np.unique(code, return_inverse=True)
        both = np.unique(unit * max(1, len(codes)) + code)
        unit, code = both // max(1, len(codes)), both % max(1, len(codes))
        starts, many = np.searchsorted(unit, np.arange(len(records))), np.bincount(unit, minlength=len(records))
        held = np.unique(np.repeat(np.arange(len(keys)), lengths) * max(1, len(records)) + every)
        doc, unit = held // max(1, len(records)), held % max(1, len(records))
        linked = np.repeat(doc, many[unit]) * max(1, len(codes)) + code[_ranges(starts[unit], many[unit])]
        counts = np.bincount(np.unique(linked) % max(1, len(codes)), minlength=len(codes))
        columns = [pa.array([keys], pa.list_(key_type)), *[pa.array([squeeze(x)], pa.binary()) for x in (lengths, every.astype("<i4"), sizes, flat)], *[pa.array([x], pa.list_(pa.int64())) for x in (codes[counts > 0], counts[counts > 0])]]
        return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key_type = aligner(a_path, b_path), pa.null()
        keys, numbers, number, chars = [], [], numbering(), 0
        for batch in batches:
            key_type = batch.column(0).type
            for k, value in zip(batch.column(0), batch.column(1)):
                body = value.as_py() or ""
                mine = list(map(number.__getitem__, known.units(body))) if body else []
                keys.append(k.as_py())
                numbers.append(np.array(mine, np.int32))
                chars += len(body)
                if chars >= chunk:
                    records, number = known.records(list(number)), numbering()
                    yield pack(keys, numbers, records, key_type)
                    keys, numbers, records, chars = [], [], [], 0
        if keys:
            yield pack(keys, numbers, known.records(list(number)), key_type)

    rows = docs.select(F.col(key), F.col(text)).mapInArrow(gather, schema)
    return stored(rows.withColumn("chunk", F.monotonically_increasing_id()), "aligned")


def _pair_counts(chunks: DataFrame) -> DataFrame:
    """(code, n, best): how many documents hold a pair linked; best if no pair of its A id is in more."""
    rows = chunks.select(F.inline(F.arrays_zip("codes", "counts")))
    totals = rows.groupBy(F.col("codes").alias("code")).agg(F.sum("counts").alias("n"))
    # An A id has at most as many partners as B has ids.
    of_a = Window.partitionBy("a")
    marked = totals.withColumn("a", F.shiftright("code", LOW)).withColumn("best", F.col("n") == F.max("n").over(of_a))
    return stored(marked.select("code", "a", "n", "best"), "pair-counts")


def pair_counts(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The corpus-wide table of linked ids: a_id, b_id, documents, best."""
    counts = _pair_counts(chunked(docs, a_path, b_path, key, text, chunk))
    return counts.select(F.col("a").cast("int").alias("a_id"), F.expr(f"cast(code - (a << {LOW}) as int)").alias("b_id"), F.col("n").alias("documents"), "best")


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: key, groups, n_a, n_b, n_groups, n_links, n_best, count_sum.

    ``groups`` is the alignment as text: ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and
    texts that the tokens of A or B do not spell (one with U+2581, say), have no tokens:
    empty groups and zeros. Repeated rows are documents of their own, null keys too.
    Other columns are not used. An empty table gives an empty table.
    """
    chunks = chunked(docs, a_path, b_path, key, text, chunk)
    counts = _pair_counts(chunks)
    asked = chunks.select(F.col("chunk").alias("asking"), F.explode("codes").alias("code"))
    answers = asked.join(counts.select("code", "n", "best"), "code")
    kind = docs.schema[key].dataType
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([T.StructField(key, kind), T.StructField("groups", T.StringType()), *[T.StructField(c, T.LongType()) for c in names]])

    def total(_, left: pa.Table, found: pa.Table) -> pa.Table:
        # The worker may be one that has encoded; nothing is encoded from here on.
        _ALIGNERS.clear()
        row = {c: left.column(c)[0].as_py() for c in ("lengths", "numbers", "sizes", "units")}
        lengths, every = expand(row["lengths"], "<i4").astype(np.int64), expand(row["numbers"], "<i4")
        units = Units(expand(row["units"], "<i4"), expand(row["sizes"], "<i4").astype(np.int64))
        found = found.sort_by("code")
        codes, n, best = (found.column(c).to_numpy() for c in ("code", "n", "best"))
        unit, code = units.links()
        if len(codes):
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            # A pair that only units of documents without tokens hold has no answer.
            held = codes[at] == code
            per_link = [held.astype(np.int64), held & best[at].astype(bool), np.where(held, n[at], 0)]
        else:
            per_link = [np.zeros(len(code), np.int64)] * 3
        many = np.bincount(unit, minlength=len(units.n_a))
        per_unit = [units.n_a, units.n_b, units.n_groups, *(_sums(x, many) for x in per_link)]
        texts, numbers = units.texts(), every.tolist()
        ends = np.cumsum(lengths).tolist()
        groups = [";".join(map(texts.__getitem__, numbers[x:y])) for x, y in zip([0, *ends], ends)]
        keys = left.column("keys").combine_chunks().flatten()
        return pa.Table.from_arrays([keys, pa.array(groups, pa.string()), *[pa.array(_sums(x[every], lengths)) for x in per_unit]], schema.fieldNames())

    return chunks.select("chunk", "keys", "lengths", "numbers", "sizes", "units").groupBy("chunk").cogroup(answers.groupBy("asking")).applyInArrow(total, schema)
