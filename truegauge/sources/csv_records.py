"""Records of CSV files whose quoted fields span lines, put together by many tasks.

Whether a line starts a record depends on all lines before it: it does unless a quoted
field is open. Read from either state, open or closed, a line ends in one of the two, so
it is one of four functions on two states. Such functions compose, and a composition is
told by its last constant function and by how many swaps follow it. So the state before
each line comes from running sums within a slice of its file split, and from one row per
slice carried over the slices of its file. A slice has at most ``SLICE_LINES`` lines, and
many tasks share a split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block", "slice"]
#: Lines of a slice, as a power of two.
SLICE_LINES = 12


def lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """``value, file, block, at, slice``: lines, their order within each split of a file,
    and the slice of it that they belong to, in the same order."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return text.select(
        value.alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).withColumn("slice", F.shiftright("at", SLICE_LINES))


def _ends_open(text: Column, delimiter: Column) -> Column:
    """Whether a field is open at the end of a text that begins outside of quotes."""
    field = F.concat(F.lit(r"(^|\Q"), delimiter, F.lit(r"\E)"))
    rest = F.regexp_replace(text, F.concat(field, F.lit('"[^"]*"')), F.lit("$1"))
    return F.regexp_like(rest, F.concat(field, F.lit('"')))


def line_functions(rows: DataFrame, delimiter: Column) -> DataFrame:
    """``rows`` with ``constant`` (the state it always ends in, true if open, or null) and ``swap``."""
    # A doubled quote inside a field and an empty quoted field both leave the state alone.
    body = F.replace("value", F.lit('""'), F.lit(""))
    quote = F.instr(body, '"')
    # Behind the closing quote no field begins before the next delimiter.
    rest = F.concat(F.lit("x"), F.substring(body, quote + 1, F.length(body)))
    from_closed = (quote > 0) & _ends_open(body, delimiter)
    from_open = (quote == 0) | _ends_open(rest, delimiter)
    seen = rows.withColumn("from_closed", from_closed).withColumn("from_open", from_open)
    constant = F.when(F.col("from_closed") == F.col("from_open"), F.col("from_open"))
    swap = F.col("from_closed") & ~F.col("from_open")
    return seen.select(*rows.columns, constant.alias("constant"), swap.cast("int").alias("swap"))


def _state(start: Column, constant: Column, swaps: Column) -> Column:
    """State behind a composition: its last constant ``(v, s)`` and all its swaps."""
    odd = (swaps - F.coalesce(constant["s"], F.lit(0))) % 2 == 1
    return F.coalesce(constant["v"], start) != odd


def _within(rows: DataFrame) -> DataFrame:
    """``rows`` with the composition of the lines before them in their slice."""
    order = Window.partitionBy(*SPLIT).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("swaps", F.sum("swap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("constant").isNotNull(), F.struct(F.col("constant").alias("v"), F.col("swaps").alias("s")))
    marked = summed.withColumn("fixed", fixed)
    return marked.withColumn("fixed_before", F.last("fixed", ignorenulls=True).over(before))


def _splits(rows: DataFrame) -> DataFrame:
    """One row per slice: ``start`` (open or not), ``owner``, the record it begins in, and
    ``head``, the first line of its file that is not blank."""
    closed, opened = (_state(F.lit(s), F.col("fixed_before"), F.col("swaps") - F.col("swap")) for s in (False, True))
    per_split = _within(rows).groupBy(*SPLIT).agg(
        F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.col("at"))).alias("fixed"),
        F.sum("swap").alias("swaps"),
        F.max(F.when(~closed, F.col("at"))).alias("last_if_closed"),
        F.max(F.when(~opened, F.col("at"))).alias("last_if_open"),
        F.min(F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("at"))).alias("filled"),
    )
    order = Window.partitionBy("file").orderBy("block", "slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A slice as a whole is again a constant, a swap or neither.
    whole = F.when(F.col("fixed").isNotNull(), _state(F.lit(False), F.col("fixed"), F.col("swaps")))
    seen = per_split.withColumn("whole", whole).withColumn("own", F.when(F.col("whole").isNull(), F.col("swaps") % 2).otherwise(0))
    seen = seen.withColumn("sum", F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("whole").isNotNull(), F.struct(F.col("whole").alias("v"), F.col("sum").alias("s"))), ignorenulls=True)
    started = seen.withColumn("start", _state(F.lit(False), last.over(before), F.col("sum") - F.col("own")))
    latest = F.when(F.col("start"), F.col("last_if_open")).otherwise(F.col("last_if_closed"))
    owner = F.last(F.when(latest.isNotNull(), F.struct("block", latest.alias("at"))), ignorenulls=True)
    head = F.min("filled").over(Window.partitionBy("file"))
    return started.withColumn("latest", latest).select(*SPLIT, "start", owner.over(before).alias("owner"), head.alias("head"))


def records(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame:
    """``record, first``: every record with its line ends as they are, and whether it is
    its file's first one (the header)."""
    return assemble(lines(spark, path, encoding), F.lit(delimiter)).select("record", "first")


def assemble(rows: DataFrame, delimiter: Column, also: Sequence[str] = ()) -> DataFrame:
    """``record, first, file`` and the columns ``also``, which are the same in all of a file.

    A record of one line passes as it is; only lines of longer ones are gathered. A record
    that never ends reaches to the end of its file. Blank lines between records are none.
    """
    rows = line_functions(rows, delimiter)
    placed = _within(rows).join(_splits(rows), SPLIT)
    before = _state(F.col("start"), F.col("fixed_before"), F.col("swaps") - F.col("swap"))
    after = F.coalesce("constant", before != (F.col("swap") == 1))
    order = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    first = (F.col("block") == 0) & (F.col("at") == F.col("head"))
    told = placed.withColumn("starts", ~before).withColumn("open", after).withColumn("first", first)
    own = F.last(F.when(F.col("starts"), F.struct("block", "at")), ignorenulls=True).over(order)
    told = told.withColumn("owner", F.coalesce(own, "owner"))

    single = told.where("starts and not open").select("value", "first", "file", *also)
    parts = told.where("not starts or open").select("file", "owner", "first", *also, F.struct("block", "at", "value").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]), "\n")
    joined = parts.groupBy("file", "owner", *also).agg(text.alias("value"), F.bool_or("first").alias("first"))
    return _named(single.unionByName(joined.select("value", "first", "file", *also)), also)


def _named(rows: DataFrame, also: Sequence[str]) -> DataFrame:
    record = F.regexp_replace("value", "\r$", "")
    first = F.coalesce("first", F.lit(False)).alias("first")
    return rows.where(F.trim(record) != "").select(record.alias("record"), first, "file", *also)


def opens(value: Column, delimiter: str) -> Column:
    """Whether a line that begins outside of quotes ends in an open field."""
    body = F.replace(value, F.lit('""'), F.lit(""))
    return value.contains('"') & _ends_open(body, F.lit(delimiter))


def first_lines(rows: DataFrame) -> DataFrame:
    """``file, head``: the first line of every file that is not blank, if it is in the first split."""
    return rows.where((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min("at").alias("head"))


def whole_lines(rows: DataFrame, heads: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """What ``assemble`` gives for files none of whose lines leaves a field open: its lines."""
    first = (F.col("block") == 0) & (F.col("at") == F.col("head"))
    told = rows.join(heads, "file", "left").select("value", first.alias("first"), "file", *also)
    return _named(told, also)
