"""Profiles of many files at once, keyed by data set.

Text files are read as lines with the file they come from, whatever their columns are.
Layout, header, types and shapes are aggregates by data set, so the number of jobs does
not depend on the number of files. Only one row per data set reaches the driver. Parquet
files are counted in one pass too; their columns come from their footers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from truegauge.session import scratch_dir
from truegauge.sources import csv_records, files, json_records
from truegauge.sources.files import InvalidInput, dataset_name, file_type

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"
#: Path, rows, columns with their types, and why there are none.
Row = tuple[str, int | None, list[tuple[str, str]] | None, str | None]


def profile_many(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """One profile row per path; status PENDING, or ERROR with the reason."""
    paths = list(paths)
    found: dict[str, Row] = {}
    kinds: dict[str, list[str]] = {"csv": [], "json": [], "parquet": []}
    for path in dict.fromkeys(paths):
        try:
            kinds[file_type(path)].append(path)
        except InvalidInput as problem:
            found[path] = (path, None, None, str(problem))
    for kind, profile in (("csv", _csv), ("json", _json), ("parquet", _parquet)):
        for row in _readable(spark, kinds[kind], profile):
            found[row[0]] = row
    rows = []
    for path in paths:
        _, n, columns, problem = found[path]
        if problem is not None:
            rows.append((path, dataset_name(path), "ERROR", None, None, None, None, problem))
        else:
            rows.append((path, dataset_name(path), "PENDING", n, len(columns), json.dumps([c for c, _ in columns]), dict(columns), None))
    return spark.createDataFrame(rows, files.PROFILE_SCHEMA)


def _readable(spark: SparkSession, paths: list[str], profile: Callable[[SparkSession, list[str]], list[Row]]) -> list[Row]:
    """All paths at once; if one cannot be opened, by halves until that one is alone."""
    if not paths:
        return []
    try:
        return profile(spark, paths)
    except AnalysisException as problem:
        if len(paths) == 1:
            return [(paths[0], None, None, str(problem).splitlines()[0])]
        half = len(paths) // 2
        return _readable(spark, paths[:half], profile) + _readable(spark, paths[half:], profile)


def _datasets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, path``: every file with the path among ``paths`` that it lies in or is."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    names = listed.select(F.col("_metadata.file_path").alias("file"))
    parts = F.split(F.regexp_replace("file", _SCHEME, "/"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = spark.createDataFrame([(re.sub(_SCHEME, "/", p).rstrip("/"), p) for p in paths], "plain string, path string")
    # Written once, so that its size is known: joined to lines, it need not be listed again.
    return _kept(names.withColumn("plain", F.explode(above)).join(known, "plain").select("file", "path"))


def _kept(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "datasets")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- JSON ------------------------------------------------------------------


def _json(spark: SparkSession, paths: list[str]) -> list[Row]:
    rows = json_records.records(json_records.documents(spark, paths)).join(_datasets(spark, paths), "file")
    seen = {r["path"]: r for r in rows.groupBy("path").agg(*json_records.facts()).collect()}
    out: list[Row] = []
    for path in paths:
        problem = files.json_problem(seen[path]) if path in seen else files.EMPTY_FILE
        if problem:
            out.append((path, None, None, problem))
            continue
        shape = json_records.shape_type(spark, seen[path]["shape"])
        columns = [(".".join(name).strip(), kind.simpleString()) for name, kind in json_records.leaves(shape)]
        out.append((path, seen[path]["records"], columns, None))
    return out


# --- Parquet ---------------------------------------------------------------


def _parquet(spark: SparkSession, paths: list[str]) -> list[Row]:
    # A column that no file has: rows are counted without reading any.
    rows = spark.read.schema("_none string").option("recursiveFileLookup", True).parquet(*paths)
    named = rows.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count()
    counts = named.join(_datasets(spark, paths), "file").groupBy("path").agg(F.sum("count").alias("n"))
    seen = {r["path"]: r["n"] for r in counts.collect()}
    return [(p, seen.get(p, 0), spark.read.parquet(p).dtypes, None) for p in paths]


# --- CSV -------------------------------------------------------------------


def _csv(spark: SparkSession, paths: list[str]) -> list[Row]:
    rows = csv_records.lines(spark, paths, "UTF-8").join(_datasets(spark, paths), "file")
    layouts = _layouts(rows).collect()
    known = {r["path"]: r for r in layouts}
    if not known:
        return [(p, None, None, files.EMPTY_FILE) for p in paths]
    width = max(r["fields"] for r in layouts)
    table = spark.createDataFrame([(r["path"], r["delimiter"], r["foreign"], r["torn"]) for r in layouts], "path string, delimiter string, foreign boolean, torn boolean")
    decoded = F.when(F.col("foreign"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    laid = rows.join(table, "path").withColumn("value", decoded).drop("foreign")
    records = _records(laid, {r["torn"] for r in layouts})
    parsed = records.select("path", "file", "first", _values(width).alias("values"), _fields().alias("fields"))
    first = F.struct("file", "fields", "values")
    heads = parsed.where("first").groupBy("path").agg(F.min(first).alias("head")).select("path", F.col("head.fields").alias("wide"), F.col("head.values").alias("names"))
    names = {r["path"]: r for r in heads.collect()}
    wide = spark.createDataFrame([(p, r["wide"]) for p, r in names.items()], "path string, wide int")
    kept = parsed.where("not first").join(wide, "path").where("fields <= wide")
    # Every record has a first field, so its cells tell the number of records too.
    cells = kept.select("path", "wide", F.posexplode("values").alias("pos", "text")).where("pos < wide")
    clean = cells.select("path", "pos", F.when(~F.col("text").isin(files.NA_TOKENS), F.col("text")).alias("text"))
    kinds = {(r["path"], r["pos"]): r for r in clean.groupBy("path", "pos").agg(F.count(F.lit(1)).alias("n"), files.type_facts("text").alias("f")).collect()}
    out: list[Row] = []
    for path in paths:
        if path not in names:
            out.append((path, None, None, files.EMPTY_FILE if path not in known else files.NO_COLUMNS))
            continue
        columns = files.header_names(names[path]["names"][: names[path]["wide"]])
        typed = [(c, files.type_name(kinds[path, n]["f"]) if (path, n) in kinds else "string") for n, c in enumerate(columns)]
        out.append((path, kinds[path, 0]["n"] if (path, 0) in kinds else 0, typed, None))
    return out


def _records(laid: DataFrame, torn: set[bool]) -> DataFrame:
    """Records of all data sets; only those with lines that leave a field open are put together."""
    also = ["path", "delimiter"]
    parts = []
    if True in torn:
        parts.append(csv_records.assemble(laid.where("torn").drop("torn"), F.col("delimiter"), also))
    if False in torn:
        plain = laid.where("not torn")
        parts.append(csv_records.whole_lines(plain, _kept(csv_records.first_lines(plain)), also))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _layouts(rows: DataFrame) -> DataFrame:
    """``path, delimiter, foreign, fields, torn``: the delimiter that splits the first lines of
    a data set most evenly, whether its text is not UTF-8, the fields of its first line, and
    whether a line may leave a quoted field open (of text that is not UTF-8 this is not asked)."""
    opened = [F.bool_or(csv_records.opens(F.col("value"), d)) for d in files.DELIMITERS]
    whole = rows.groupBy("path").agg(F.min("file").alias("file"), F.bool_or(~F.is_valid_utf8("value")).alias("foreign"), F.array(*opened).alias("opened"))
    in_file = Window.partitionBy("path", "file").orderBy("at")
    opening = rows.where("block = 0").withColumn("nth", F.row_number().over(in_file)).where(F.col("nth") <= files.SNIFF_CHARS)
    size = F.length("value") + 1
    opening = opening.withColumn("before", F.coalesce(F.sum(size).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    opening = opening.where(F.col("before") < files.SNIFF_CHARS).join(whole.select("path", "file"), ["path", "file"])
    # A line that the inspected characters cut off says nothing, unless it is the only one.
    cut = F.col("before") + F.length("value") > files.SNIFF_CHARS
    lines = opening.where((F.trim("value") != "") & (~cut | (F.col("nth") == 1)))
    outside = F.regexp_replace(F.substring("value", 1, files.SNIFF_CHARS), r'"[^"]*("|$)', "")
    counts = [F.length(outside) - F.length(F.replace(outside, F.lit(d), F.lit(""))) for d in files.DELIMITERS]
    listed = F.array_sort(F.collect_list(F.struct("nth", F.array(*counts).alias("n"))))
    heads = lines.groupBy("path").agg(listed.alias("lines"))

    def evenness(k: int) -> Column:
        first = F.col("lines")[0]["n"][k]
        same = F.size(F.filter("lines", lambda x: x["n"][k] == first)) / F.size("lines")
        return F.struct(F.when(first > 0, same).otherwise(0.0).alias("same"), first.alias("first"), F.lit(-k).alias("rank"))

    best = F.greatest(*[evenness(k) for k in range(len(files.DELIMITERS))])
    chosen = F.when(best["same"] > 0, -best["rank"]).otherwise(0)
    told = heads.withColumn("k", chosen).join(whole.drop("file"), "path")
    delimiter = F.element_at(F.array(*[F.lit(d) for d in files.DELIMITERS]), (F.col("k") + 1).cast("int"))
    return told.select("path", delimiter.alias("delimiter"), "foreign", (F.col("lines")[0]["n"][F.col("k")] + 1).alias("fields"), (F.col("foreign") | F.get("opened", F.col("k").cast("int"))).alias("torn"))


def _values(width: int) -> Column:
    """The fields of a record as an array, by the parser of the delimiter it has."""
    ddl = ", ".join(f"c{n} STRING" for n in range(width))

    def parse(delimiter: str) -> Column:
        r = F.from_csv("record", ddl, {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"})
        return F.array(*[r[f"c{n}"] for n in range(width)])

    out = parse(files.DELIMITERS[0])
    for d in files.DELIMITERS[1:]:
        out = F.when(F.col("delimiter") == d, parse(d)).otherwise(out)
    return out


def _fields() -> Column:
    outside = F.regexp_replace("record", r'"[^"]*"', "")
    return F.length(outside) - F.length(F.replace(outside, F.col("delimiter"), F.lit(""))) + 1
