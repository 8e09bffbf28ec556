"""Substring deduplication by hashing the units of lines.

A line is cut behind each sentence end, so a passage is found wherever it stands in a
line. Units are normalised (lower case, single blanks) and hashed to 128 bits; digests
that occur once in the whole corpus are set aside by a count that is combined before the
shuffle. Of the others the earliest ranked occurrence stays and the rest form runs of
neighbouring units; runs of at least ``MIN_WORDS`` words are removed, with the offsets
that they have in the original text. Shorter runs are chance repeats and stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.llm.shared import fresh, stored

#: Words that a run of repeated units needs to be removed.
MIN_WORDS = 20
_CUTS = re.compile(r"(?<=\n)|(?<=[.!?] )")
_LOW = (1 << 64) - 1


def units(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, length, words, digest, digest) of every unit with words, in order."""
    at = 0
    for part in _CUTS.split(text):
        words = part.lower().encode("utf-8", "surrogatepass").split()
        if words:
            digest = xxhash.xxh3_128_intdigest(b" ".join(words))
            yield at, len(part), len(words), digest >> 64, digest & _LOW
        at += len(part)


def _exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per unit; ``doc`` tells texts of one key apart."""
    numbers = [("doc", T.LongType()), ("unit", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("words", T.IntegerType()), ("d1", T.LongType()), ("d2", T.LongType())]
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, k) for n, k in numbers]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows, doc, number, found = [], [], [], []
                for row, value in enumerate(part.column(1)):
                    whole = value.as_py()
                    if whole:
                        mine = list(units(whole))
                        found += mine
                        rows += [row] * len(mine)
                        doc += [xxhash.xxh64_intdigest(whole.encode("utf-8", "surrogatepass"))] * len(mine)
                        number += range(len(mine))
                start, length, words, d1, d2 = zip(*found) if found else ((),) * 5
                longs = [np.array(x, np.uint64).view(np.int64) for x in (doc, d1, d2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(longs[0]), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(words, pa.int32()), pa.array(longs[1]), pa.array(longs[2])],
                    schema.fieldNames(),
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)


def removed_units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit to remove: key, doc, start, length, words, kept_key and kept_start.

    Occurrences are ranked by key (nulls last), text and place; the first one stays.
    Rows that repeat both key and text are one document. Null, empty and blank texts
    have no units. Offsets and lengths count characters of the original text.
    """
    found = _exploded(docs, key, text)
    common = stored(found.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2"), "repeated-units")
    again = stored(found.join(common, ["d1", "d2"], "left_semi").dropDuplicates(["key", "doc", "unit"]), "repeats")
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "doc", "unit", "start")
    # Written first, so that the join shuffles both sides anew and can split a unit that
    # very many documents hold.
    first = stored(again.groupBy("d1", "d2").agg(F.min(rank).alias("first")), "first-units")
    later = again.join(first, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first")))
    place = Window.partitionBy("key", "doc").orderBy("unit")
    runs = later.withColumn("run", F.col("unit") - F.row_number().over(place))
    whole = F.sum("words").over(Window.partitionBy("key", "doc", "run"))
    kept = runs.withColumn("run_words", whole).where(F.col("run_words") >= min_words)
    return kept.select("key", "doc", "start", "length", "words", F.col("first.key").alias("kept_key"), F.col("first.start").alias("kept_start"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``; all rows and columns stay."""
    spans, doc = fresh(docs, "_spans"), fresh(docs, "_doc")
    gone = removed_units(docs, key, text, min_words)
    by_doc = gone.groupBy("key", "doc").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(spans))

    @F.pandas_udf("long")
    def digest(texts):
        return texts.map(lambda t: xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"))).astype("uint64").astype("int64")

    @F.pandas_udf("string")
    def cut(texts, removed):
        def one(t, parts):
            out, at = [], 0
            for p in parts:
                out.append(t[at : p["start"]])
                at = p["start"] + p["length"]
            return "".join([*out, t[at:]])

        return texts.combine(removed, lambda t, parts: t if parts is None else one(t, parts))

    marked = docs.withColumn(doc, digest(F.col(text)))
    by_doc = by_doc.withColumnRenamed("key", fresh(marked, "_key")).withColumnRenamed("doc", fresh(marked, "_hash"))
    k, h, _ = by_doc.columns
    joined = marked.join(by_doc, F.col(key).eqNullSafe(F.col(k)) & (F.col(doc) == F.col(h)), "left")
    cleaned = F.when(F.col(spans).isNotNull(), cut(F.col(text), F.col(spans))).otherwise(F.col(text))
    return joined.select(*[cleaned.alias(c) if c.lower() == text.lower() else F.col(c) for c in docs.columns])
