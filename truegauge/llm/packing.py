"""Best-fit packing of tokenised documents by hierarchical residual packing.

1. Every text becomes token ids with the end id; longer ones are cut to the capacity.
2. Pieces are dealt by hash to groups of bounded size, or, if the order of the documents
   is to be kept, by contiguous ranges of it. Each group packs its pieces best fit,
   longest first, and closes the bins that are nearly full.
3. The underfull bins of ``FAN_IN`` groups are the items of the next round, and so on up
   a tree until one group is left. A group passes on its ``CARRY`` emptiest bins at most
   and closes the others, so no round gathers an unbounded number of items.
4. Offsets add up along the tree: piece in bin, bin in bin of the next round. A bin has
   the number of its first and longest piece, so sequences are numbered in piece order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.shared import stored, tasks_for

CAPACITY = 4096
END_ID = 1
#: Items of a first-round group, groups merged per round, open bins passed on by a group,
#: and the room up to which a bin counts as full.
GROUP, FAN_IN, CARRY, NEARLY_FULL = 50_000, 8, 8192, 16
#: Items of a first-round group where the order counts: a piece moves no further in it,
#: unless its bin is left underfull.
ORDERED_GROUP = 1000
#: A worker remembers the ids of about so many words of at most this many bytes.
WORDS, WORD_BYTES = 600_000, 48
#: Byte-level vocabularies write each byte as a visible character: itself where that is
#: printable, else the next free one from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
VISIBLE = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes; ``of`` does whole texts.

    The tokenizer lower-cases, never joins anything across ASCII white space and always
    parts punctuation from letters. So a text's ids are those of its words in turn, and
    a word met before needs no second encoding. Letter words skip the tokenizer's
    normaliser, which has nothing to do there. Strings of special tokens are taken out of
    a text first, as the tokenizer does.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Only as they are written; "<|ENDOFTEXT|>" in lower case is still ordinary text.
        self.tokenizer.encode_special_tokens = True
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.any_special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.merge = self.tokenizer.model.tokenize

    def encode(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            ids = [t.id for t in self.merge(word.decode())]
        else:
            text = word.decode("utf-8", "replace")
            plain = text.isalpha() and max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text)
            if plain:
                ids = [t.id for t in self.merge(word.decode("latin-1").translate(VISIBLE))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        body = word.rstrip(b".,;:!?|#%*&$")
        if len(body) < len(word) and body[-1:].isalnum():
            ids = self[body] + self[word[len(body) :]]
        elif word.isascii() and not word.islower() and word.lower() != word:
            ids = self[word.lower()]
        else:
            ids = self.encode(word)
        if len(word) <= WORD_BYTES:
            self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if len(self) > WORDS:
            self.clear()
        if text and self.any_special and self.any_special.search(text):
            parts = self.any_special.split(text)
            return b"".join(self.special[part] if n % 2 else self.plain(part) for n, part in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per worker process, so that words are remembered between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: key, piece, start, length, ids_crc32, and ids if asked for.

    A null text is an empty one, whose one piece is the end id. Repeated rows give
    repeated pieces. ``ids`` are little-endian and unsigned, of two bytes each where the
    vocabulary has no larger id, else of four; ``ids_crc32`` is always that of four bytes.
    """
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")], *[T.StructField("ids", T.BinaryType())] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        short = words.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        for batch in batches:
            rows, number, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                encoded = words.of(text.as_py()) + end
                for at in range(0, len(encoded), width):
                    part = encoded[at : at + width]
                    rows.append(row)
                    number.append(at // width)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("<u2").tobytes() if short else part)
            columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * with_ids], schema.fieldNames())

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in order, and the fill of each bin.

    Bins are kept by the room they have left; the set bits of one integer say which
    rooms there are, so the tightest bin is the lowest set bit at or above the size.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = chosen, fills[chosen]
        fills[chosen] += size
        left = room - size
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(chosen)
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, number: int, groups: int, capacity: int, nearly_full: int, carry: int, total: int | None) -> DataFrame:
    """One round over ``items`` (id, size): id, bin, offset, fill and whether the bin is closed."""
    last = groups == 1

    def pack(group: pa.Table) -> pa.Table:
        ids, sizes = group.column("id").to_numpy(), group.column("size").to_numpy()
        order = np.lexsort((ids, -sizes))
        ids, sizes = ids[order], sizes[order]
        bins, offsets, fills = best_fit(sizes, capacity)
        closed = (fills >= capacity - nearly_full) | last
        fullest = np.argsort(fills[~closed], kind="stable")[carry:]
        closed[np.nonzero(~closed)[0][fullest]] = True
        # Bins are numbered as they are opened, so these are their first items in turn.
        name = ids[offsets == 0][bins]
        return pa.table({"id": ids, "bin": name, "offset": offsets, "fill": fills[bins], "closed": closed[bins]})

    hashed = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(groups))
    group = hashed if total is None else F.floor(F.col("id") / F.lit(-(-total // groups)))
    dealt = items.select("id", "size", group.cast("long").alias("group"))
    return dealt.groupBy("group").applyInArrow(pack, "id long, bin long, offset long, fill long, closed boolean")


def place(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan_in: int = FAN_IN, carry: int = CARRY, nearly_full: int = NEARLY_FULL, ordered: bool = False) -> DataFrame:
    """``items`` (id, size from 1 to ``capacity``) to rows (id, sequence_id, offset).

    ``ordered`` takes the ids, which then are 0, 1, 2 and so on, for an order to keep.
    """
    total = items.count()
    groups, number = tasks_for(total, group), 0
    placed = None
    while True:
        done = stored(_round(items, number, groups, capacity, nearly_full, carry, total if ordered and total else None), "packing-round")
        if placed is None:
            placed = done.select("id", "bin", "offset")
        else:
            moved = done.select(F.col("id").alias("bin"), F.col("bin").alias("parent"), F.col("offset").alias("more"))
            placed = placed.join(moved, "bin", "left").select("id", F.coalesce("parent", "bin").alias("bin"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        if groups == 1:
            return placed.select("id", F.col("bin").alias("sequence_id"), "offset")
        items = done.where("offset = 0 and not closed").select(F.col("bin").alias("id"), F.col("fill").alias("size"))
        groups, number = tasks_for(groups, fan_in), number + 1


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, **tree: int) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset`` there.

    Columns of ``docs`` other than key and text are not needed and not kept. An empty
    table gives an empty table. Sequences are gapless from offset 0.
    """
    row = "row_number"
    cut = stored(pieces(docs, tokenizer, key, text, capacity, end_id, with_ids).withColumn(row, F.monotonically_increasing_id()), "pieces")
    placed = place(cut.select(F.col(row).alias("id"), F.col("length").alias("size")), capacity, **tree)
    return cut.join(placed, F.col(row) == F.col("id")).drop(row, "id")


def pack_in_order(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, **tree: int) -> DataFrame:
    """:func:`pack` of a table as it was written, sequences numbered in its order.

    ``docs`` is read from Parquet files; their order is that of the tasks that wrote them
    and of the rows inside. Sequences made within a group hold neighbouring documents.
    """
    file = docs.metadataColumn("_metadata")
    # part-<task>-<job>.c<file of the task>; readers take files by size, not by name. Files
    # of other names, and of several writes, come in the order of their names.
    part, nth = (F.coalesce(F.regexp_extract(file["file_name"], p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"[-.]c(\d+)\."))
    where = F.struct(part.alias("part"), nth.alias("nth"), file["file_path"].alias("file"), file["row_index"].alias("row"))
    marked = docs.select(F.struct(F.col(key).alias("key"), where.alias("where")).alias("marked"), F.col(text).alias("text"))
    cut = stored(pieces(marked, tokenizer, "marked", "text", capacity, end_id, with_ids), "pieces")

    at = cut.select("marked.where.*", "piece", "length")
    sizes = at.groupBy("part", "nth", "file").agg(F.count(F.lit(1)).alias("n"))
    # One row per written file.
    earlier = Window.orderBy("part", "nth", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("file").orderBy("row", "piece"))
    numbered = at.withColumn("id", inside - 1).join(starts, "file")
    numbered = stored(numbered.select("file", "row", "piece", "length", (F.col("id") + F.col("first")).alias("id")), "piece-order")
    placed = place(numbered.select("id", F.col("length").alias("size")), capacity, ordered=True, **{"group": ORDERED_GROUP, **tree})
    places = numbered.drop("length").join(placed, "id").drop("id").withColumnRenamed("piece", "number")
    same = [F.col(f"marked.where.{c}") == F.col(c) for c in ("file", "row")]
    joined = cut.join(places, [*same, F.col("piece") == F.col("number")])
    return joined.select(F.col("marked.key").alias(key), *[c for c in cut.columns if c != "marked"], "sequence_id", "offset")
