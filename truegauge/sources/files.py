"""Datasets from CSV, JSON and Parquet files."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.operators.checks import quoted
from truegauge.sources import csv_records, json_records

# Fixed values of the readers.
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_CHARS = 4096
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
OVERFLOW = "_overflow"
CORRUPT = "_corrupt_record"

EMPTY_FILE = "The uploaded file is completely empty."
NO_COLUMNS = "The CSV file has no columns or data."
NO_RECORDS = "The uploaded JSON file is empty or contains no records."
NOT_RECORDS = "JSON must contain an array of objects."
BROKEN_JSON = "Invalid JSON format: the text cannot be parsed as JSON objects"
NOT_TABULAR = "The JSON file has no parsable tabular structure."

PROFILE_SCHEMA = (
    "path STRING, name STRING, status STRING, row_count BIGINT, column_count INT, "
    "column_names STRING, dtypes MAP<STRING, STRING>, error STRING"
)


class InvalidInput(ValueError):
    """The file holds no readable table; the message says why."""


@dataclass(frozen=True)
class Layout:
    """How a CSV is written."""

    delimiter: str
    encoding: str
    multi_line: bool


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the first lines most evenly; a comma when none does."""
    head, size = [], 0
    # No more lines, and no more of a line, than the inspected characters can hold.
    opening = _lines(spark, path).select(F.substring("value", 1, SNIFF_CHARS).alias("value"))
    for row in opening.limit(SNIFF_CHARS).toLocalIterator():
        head.append(row["value"])
        size += len(row["value"]) + 1
        if size >= SNIFF_CHARS:
            break
    text = "\n".join(head)[:SNIFF_CHARS]
    rows = [r for r in text.split("\n") if r.strip()]
    if size > SNIFF_CHARS and len(rows) > 1:
        rows = rows[:-1]

    def evenness(delimiter: str) -> tuple[float, int]:
        counts = [_outside_quotes(r, delimiter) for r in rows]
        first = counts[0] if counts else 0
        if not first:
            return (0.0, 0)
        return (sum(c == first for c in counts) / len(counts), first)

    best = max(DELIMITERS, key=evenness)
    return best if evenness(best)[0] > 0 else ","


def _outside_quotes(line: str, delimiter: str) -> int:
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def detect_layout(spark: SparkSession, path: str) -> Layout:
    """Delimiter, encoding and whether quoted fields span lines.

    Encoding and quoting need every line, so both are answered by one distributed
    pass over the splittable text: bytes that are not UTF-8 mean Latin-1, and a line
    with an odd number of quotes, one of which opens a field, means that the field
    continues on the next line. A lone inch mark inside a field opens nothing.
    """
    value = F.col("value")
    quotes = F.when(
        value.rlike('(^|[,;\t|])\\s*"'), F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    ).otherwise(0)
    seen = _lines(spark, path).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.is_valid_utf8(value)).alias("foreign"),
        F.count_if(quotes % 2 == 1).alias("open"),
    ).first()
    if seen["lines"] == 0:
        raise InvalidInput(EMPTY_FILE)
    encoding = "ISO-8859-1" if seen["foreign"] else "UTF-8"
    return Layout(detect_delimiter(spark, path), encoding, seen["open"] > 0)


def detect_encoding(spark: SparkSession, path: str) -> str:
    return detect_layout(spark, path).encoding


def header_names(values: list[str | None]) -> list[str]:
    """Names out of a header: trimmed, numbered where there is none, told apart where two are equal."""
    unique: list[str] = []
    for n, value in enumerate(values):
        name = candidate = str(value).strip() if value is not None else f"Unnamed: {n}"
        repeat = 0
        while candidate in unique:
            repeat += 1
            candidate = f"{name}.{repeat}"
        unique.append(candidate)
    return unique


def _text_rows(spark: SparkSession, path: str, layout: Layout) -> tuple[DataFrame, list[str]]:
    """All fields as text, for the lines without surplus fields, and the header names.

    A line is too long if it has more fields than the header, be they empty. The parser
    marks lines of another length than its schema; the schema has one field more than
    the header, so unmarked lines are too long and the fields of marked ones are counted.
    """
    reader = (
        spark.read.option("sep", layout.delimiter)
        .option("encoding", layout.encoding)
        .option("multiLine", layout.multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )
    first = reader.option("header", False).csv(path).limit(1).first()
    unique = header_names(list(first) if first else [])
    if not unique:
        raise InvalidInput(NO_COLUMNS)
    positions = [f"c{n}" for n in range(len(unique))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*positions, OVERFLOW, CORRUPT)])
    if layout.multi_line:
        # Read by lines, so that one file is many tasks; records are put together first.
        found = csv_records.records(spark, path, layout.delimiter, layout.encoding).where(~F.col("first"))
        options = {"sep": layout.delimiter, "quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT}
        ddl = ", ".join(f"{f.name} STRING" for f in schema.fields)
        rows = found.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
    else:
        marked = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
        rows = marked.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    # A doubled quote ends one quoted part and starts the next. An alternation here would
    # recurse once per character and overflow the stack on a long field.
    outside = F.regexp_replace(F.col(CORRUPT), r'"[^"]*"', "")
    fields = F.length(outside) - F.length(F.replace(outside, F.lit(layout.delimiter), F.lit(""))) + 1
    return rows.where(F.col(OVERFLOW).isNull() & (fields <= len(unique))).drop(OVERFLOW, CORRUPT), unique


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    layout: Layout | None = None,
    infer: bool = True,
) -> DataFrame:
    """CSV with a header.

    Lines with too many fields are dropped, short ones padded with null, null tokens
    become null, names are trimmed. Give ``schema`` to skip the pass that infers
    types, and ``layout`` to skip the one that inspects the text.
    """
    rows, names = _text_rows(spark, path, layout or detect_layout(spark, path))
    clean = rows.select(
        *[
            F.when(~F.col(f"c{n}").isin(NA_TOKENS), F.col(f"c{n}")).alias(name)
            for n, name in enumerate(names)
        ]
    )
    if schema is not None:
        return clean.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return infer_types(clean) if infer else clean


def type_facts(name: str) -> Column:
    """What a text column holds, as an aggregate that merges: which types fit all of it."""
    whole = r"^\s*[+-]?\d{1,19}\s*$"
    number = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
    flag = r"^(True|False|TRUE|FALSE|true|false)$"
    text = quoted(name)

    def all_match(pattern: str) -> Column:
        return F.count_if(text.isNotNull() & ~text.rlike(pattern)) == 0

    return F.struct(
        F.count(text).alias("filled"),
        # Nineteen digits may or may not fit a long.
        (all_match(whole) & (F.count(F.trim(text).try_cast("long")) == F.count(text))).alias("whole"),
        all_match(number).alias("number"),
        all_match(flag).alias("flag"),
    )


def type_name(seen) -> str:
    """The narrowest type that fits: integers, then floats, then booleans, else text."""
    if not seen["filled"]:
        return "string"
    return "bigint" if seen["whole"] else "double" if seen["number"] else "boolean" if seen["flag"] else "string"


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns typed by their content: integers, then floats, then booleans.

    One aggregate decides for all columns; the schema is fixed from then on.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    facts = df.agg(*[type_facts(n).alias(f"f{i}") for i, n in enumerate(text)]).first()

    def typed(name: str) -> Column:
        if name not in text:
            return quoted(name)
        kind = type_name(facts[f"f{text.index(name)}"])
        return quoted(name) if kind == "string" else F.trim(quoted(name)).cast(kind).alias(name)

    return df.select(*[typed(c) for c in df.columns])


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns of any depth; arrays stay one cell."""

    def leaves(prefix: str, field: T.StructField, column: Column) -> list[Column]:
        name = f"{prefix}{field.name}"
        if not isinstance(field.dataType, T.StructType):
            return [column.alias(name)]
        return [
            leaf
            for inner in field.dataType.fields
            for leaf in leaves(f"{name}.", inner, column.getField(inner.name))
        ]

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves("", f, quoted(f.name))])


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool | None = None
) -> DataFrame:
    """JSON records: lists of objects, objects wrapping such a list, or single objects.

    Files in which every line is a JSON text hold one document per line and are read in
    parallel; ``lines=True`` says so and skips the check. Any other file is one document,
    which cannot be split. What a document holds is decided for each on its own, so all
    kinds may be mixed in one folder: of an object the first wrapper key that holds a
    list gives the records, and an object without one is a record itself. One pass finds
    the columns; a key whose values differ in type between records is text.
    """
    rows = json_records.records(json_records.documents(spark, path, lines))
    seen = rows.agg(*json_records.facts()).first()
    problem = json_problem(seen)
    if problem:
        raise InvalidInput(problem)
    kind = schema if schema is not None else json_records.shape_type(spark, seen["shape"])
    return json_records.columns(rows, kind)


def json_problem(seen) -> str | None:
    """Why the records with these facts are no table."""
    if not seen["documents"]:
        return EMPTY_FILE
    if seen["broken"]:
        return BROKEN_JSON
    if not seen["records"]:
        return NO_RECORDS
    if not seen["shape"].startswith("OBJECT<"):
        return NOT_RECORDS
    return NOT_TABULAR if seen["shape"] == "OBJECT<>" else None


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reader chosen by file extension."""
    kind = file_type(path)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "json":
        return read_json(spark, path, schema)
    return spark.read.parquet(path)


def file_type(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower().lstrip(".")
    if suffix not in ("csv", "json", "parquet"):
        raise InvalidInput(f"Unsupported file type: {suffix or 'none'}")
    return suffix


def dataset_name(path: str) -> str:
    return PurePosixPath(path).stem


def profile(df: DataFrame) -> DataFrame:
    """Row count, column count, ordered names and types, in one row."""
    types = [F.lit(v) for pair in df.dtypes for v in pair]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(json.dumps(df.columns)).alias("column_names"),
        (F.create_map(*types) if types else F.create_map()).alias("dtypes"),
    )
