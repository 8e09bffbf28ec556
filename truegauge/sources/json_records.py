"""Records of JSON documents as VARIANT values, and the columns they have together."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of objects that wrap a list of records, in order.
WRAPPER_KEYS = ["data", "records", "results", "items"]


def documents(spark: SparkSession, path: str | list[str], lines: bool | None = None) -> DataFrame:
    """``file, value``: the JSON texts of files, without their leading blanks.

    A file in which every line is a JSON text holds one document per line, and its lines
    stay where they are. The lines of any other file are put together to one document.
    ``lines`` says which kind all files are and skips the comparison.
    """
    text = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"),
    )
    text = text.where(F.trim("value") != "")
    own = text.select("file", F.regexp_replace("value", r"^\s+", "").alias("value"))
    if lines:
        return own
    torn = text.groupBy("file").agg(F.bool_or(F.get_json_object("value", "$").isNull()).alias("torn"))
    if lines is None and torn.where("torn").isEmpty():
        return own
    marked = text.join(torn.select("file", F.lit(True).alias("torn") if lines is False else "torn"), "file")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n")
    whole = marked.where("torn").groupBy("file").agg(F.regexp_replace(joined, r"^\s+", "").alias("value"))
    return marked.where("not torn").select("file", F.regexp_replace("value", r"^\s+", "").alias("value")).unionByName(whole)


def records(docs: DataFrame) -> DataFrame:
    """One row per record: ``file, record, listed, broken``.

    A document that is a list holds the records; of an object the first wrapper key that
    holds a list does, and an object without one is a record itself. Nulls in a list are
    none. ``broken`` rows stand for documents that are neither. A document without
    records gives one row with a null record.
    """
    value = F.col("value")
    wrapped = F.coalesce(*[F.when(w.startswith("["), w) for w in (F.get_json_object(value, f"$.{k}") for k in WRAPPER_KEYS)])
    listed = F.when(value.startswith("["), value).otherwise(wrapped)
    broken = F.get_json_object(value, "$").isNull() | ~value.rlike(r"^[\[{]")
    told = docs.select("file", "value", listed.alias("list"), broken.alias("broken"))
    items = F.when(F.col("list").isNull(), F.array(F.try_parse_json("value"))).otherwise(F.from_json("list", "array<variant>"))
    torn = F.col("broken") | items.isNull() | F.exists(items, lambda x: x.isNull()) & F.col("list").isNull()
    kept = F.filter(items, lambda x: x.isNotNull() & ~F.is_variant_null(x))
    rows = told.select("file", F.col("list").isNotNull().alias("listed"), torn.alias("broken"), F.when(~torn, kept).alias("kept"))
    return rows.select("file", F.explode_outer("kept").alias("record"), "listed", "broken")


def facts() -> list[Column]:
    """Aggregates over ``records``; they merge, so they serve one data set or many by key."""
    return [
        F.count(F.lit(1)).alias("documents"),
        F.count_if("broken").alias("broken"),
        F.count("record").alias("records"),
        F.schema_of_variant_agg("record").alias("shape"),
    ]


def shape_type(spark: SparkSession, shape: str) -> T.DataType:
    """The type that a shape names. What differs between records, and nulls, are text."""
    ddl = re.sub(r"(`(?:[^`]|``)*`)|\bOBJECT<", lambda m: m[1] or "STRUCT<", shape)
    return _readable(spark.sql(f"select cast(null as {ddl}) as x").schema["x"].dataType)


def _readable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _readable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_readable(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, (T.VariantType, T.NullType)):
        return T.StringType()
    return kind


def leaves(kind: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Paths and types of the dotted columns of nested objects; a list stays one cell."""
    out = []
    for field in kind.fields:
        path = (*prefix, field.name)
        out += leaves(field.dataType, path) if isinstance(field.dataType, T.StructType) else [(path, field.dataType)]
    return out


def columns(rows: DataFrame, kind: T.StructType) -> DataFrame:
    """``rows`` of records as columns; a value that is not of its column's type is null."""

    def step(key: str) -> str:
        return "['" + key.replace("'", "\\'") + "']" if '"' in key else f'["{key}"]'

    return rows.where("record is not null").select(*[F.try_variant_get("record", "$" + "".join(map(step, path)), t.simpleString()).alias(".".join(path).strip()) for path, t in leaves(kind)])
