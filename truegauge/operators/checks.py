"""Validation checks compiled to Column expressions.

Every rule becomes an aggregate over the dataset. All row-wise rules share one
``agg`` (one scan, one job, however many rules there are); each UNIQUE field adds
one two-step aggregate, which combines equal values before the shuffle so that a
value filling a third of the table still travels as one row per task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from truegauge.functions.keyed import pick_top, semi_join_by_count
from truegauge.operators.rules import RULE_TYPES, Rule, as_rules

SAMPLE_ROWS = 5
# Aggregates per ``agg``: more would outgrow one generated method.
RULES_PER_PASS = 150
# Working columns of UNIQUE, named so that no dataset column is shadowed.
VALUE, COUNT = "_value", "_count"

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf(inity)?|Inf(inity)?|INF(INITY)?)\s*$"
ISO_MOMENT = (
    r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"
)

RESULT_SCHEMA = "rule_id BIGINT, passed BOOLEAN, failed_rows BIGINT, total_rows BIGINT, details STRING"


def row_count() -> Column:
    return F.count(F.lit(1))



@dataclass(frozen=True)
class Outcome:
    """Result columns of one rule while its row is being put together."""

    failed: Column
    passed: Column
    none_numeric: Column

    def count_text(self, tail: str) -> Column:
        return F.concat(self.failed.cast("string"), F.lit(tail))


@dataclass(frozen=True)
class Check:
    """A compiled rule.

    ``failing`` marks single rows (null when the rule has no row mask);
    ``failed`` and ``passed`` are aggregates; ``details`` builds the message from
    the outcome they produced.
    """

    rule: Rule
    failed: Column
    passed: Column
    details: Callable[["Outcome"], Column]
    failing: Column | None = None
    unique: bool = False
    needs_number: Column | None = None


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def as_number(value: Column, dtype: T.DataType) -> Column:
    """The value as a double, null where it is not a number."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(dtype, T.StringType):
        # The pattern keeps out what only Java reads as a number, such as "1d".
        return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))
    return F.lit(None).cast("double")


def as_moment(value: Column, dtype: T.DataType, fmt: str | None) -> Column:
    if isinstance(dtype, T.StringType):
        if fmt:
            return F.try_to_timestamp(value, F.lit(fmt))
        return F.when(value.rlike(ISO_MOMENT), F.trim(value).try_cast("timestamp"))
    return value


def java_pattern(pattern: str) -> str:
    """Start-anchored pattern in Java's dialect, with Unicode classes."""
    return r"(?dU)\A(?:" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)) + ")"


def pattern_problem(df: DataFrame, pattern: str) -> str | None:
    """Why a pattern cannot be used, or None."""
    try:
        re.compile(pattern)
    except re.error as problem:
        return str(problem)
    jvm = df.sparkSession._jvm if hasattr(df.sparkSession, "_jvm") else None
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
        except Exception as problem:
            return str(problem).splitlines()[0]
    return None


def _row_rule(rule: Rule, failing: Column, tail: str) -> Check:
    failed = F.count_if(failing)
    return Check(rule, failed, failed == 0, lambda o: o.count_text(tail), failing)


def _all_fail(rule: Rule, details: str) -> Check:
    return Check(rule, row_count(), F.lit(False), lambda o: F.lit(details))


def _type_check(rule: Rule, value: Column, dtype: T.DataType) -> Check:
    name, expected = rule.field_name, str(rule.parameters.get("expected_type", "str"))
    wanted = expected.lower()
    if wanted == "str":
        return Check(rule, F.lit(0), F.lit(True), lambda o: F.lit("String type always match"))
    if wanted == "numeric":
        failing = as_number(value, dtype).isNull()
        return _row_rule(rule, failing, " non-numeric values found")
    if wanted == "datetime":
        failing = is_missing(as_moment(value, dtype, rule.parameters.get("format")), dtype)
        return _row_rule(rule, failing, " invalid datetime values found")

    nulls = F.count_if(value.isNull())
    integral = isinstance(dtype, T.IntegralType)
    fits = {
        "int": (nulls == 0) if integral else F.lit(False),
        "float": F.lit(True)
        if isinstance(dtype, (T.FractionalType,))
        else (((nulls > 0) if integral else F.lit(False)) | ((nulls == row_count()) & (nulls > 0))),
        "bool": (nulls == 0) if isinstance(dtype, T.BooleanType) else F.lit(False),
    }.get(wanted, F.lit(False))
    return Check(
        rule,
        F.when(fits, 0).otherwise(row_count()),
        fits,
        lambda o: F.when(o.passed, f"All values in {name} are {expected}").otherwise(
            f"Field {name} is not of type {expected}"
        ),
    )


def _range_check(rule: Rule, value: Column, dtype: T.DataType) -> Check:
    low, high = rule.parameters.get("min"), rule.parameters.get("max")
    number = as_number(value, dtype)
    failing = number.isNull()
    if low is not None:
        failing = failing | (number < float(low))
    if high is not None:
        failing = failing | (number > float(high))
    failing = F.coalesce(failing, F.lit(True))
    tail = f" values outside range [{low}, {high}] or non-numeric"
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return _row_rule(rule, failing, tail)
    # Text of which nothing reads as a number fails as a whole, even when empty.
    none_numeric = F.count(number) == 0
    failed = F.when(none_numeric, row_count()).otherwise(F.count_if(failing))
    return Check(
        rule,
        failed,
        ~none_numeric & (F.count_if(failing) == 0),
        lambda o: F.when(o.none_numeric, f"Field {rule.field_name} is not numeric").otherwise(o.count_text(tail)),
        failing,
        needs_number=number,
    )


def _regex_check(df: DataFrame, rule: Rule, value: Column, null_text: str | None) -> Check:
    pattern = rule.parameters.get("pattern", "")
    if not pattern:
        return _all_fail(rule, "No pattern provided")
    problem = pattern_problem(df, pattern)
    if problem:
        return _all_fail(rule, f"Invalid regex pattern: {problem}")
    text = value.cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    failing = ~F.coalesce(text.rlike(java_pattern(pattern)), F.lit(False))
    return _row_rule(rule, failing, f" values do not match pattern {pattern}")


def compile_rule(df: DataFrame, rule: Rule, null_text: str | None = None) -> Check:
    """One rule against one schema. ``null_text`` is what a null reads as for REGEX."""
    name = rule.field_name
    known = {f.name: f.dataType for f in df.schema.fields}
    if (name or rule.rule_type in RULE_TYPES) and name not in known:
        return _all_fail(rule, f"Field {name} not found in dataset")
    if rule.rule_type not in RULE_TYPES:
        return Check(rule, F.lit(0), F.lit(False), lambda o: F.lit(f"Unknown rule_type: {rule.rule_type}"))

    value, dtype = quoted(name), known[name]
    if rule.rule_type == "NOT_NULL":
        missing = is_missing(value, dtype)
        failed = F.count_if(missing)
        return Check(
            rule,
            failed,
            failed == 0,
            lambda o: F.when(o.passed, f"No null values in {name}").otherwise(
                o.count_text(f" null values found in {name}")
            ),
            missing,
        )
    if rule.rule_type == "DATA_TYPE":
        return _type_check(rule, value, dtype)
    if rule.rule_type == "RANGE":
        return _range_check(rule, value, dtype)
    if rule.rule_type == "REGEX":
        return _regex_check(df, rule, value, null_text)
    tail = f" duplicate values found in {name}"
    return Check(rule, F.lit(0), F.lit(False), lambda o: o.count_text(tail), unique=True)


def compile_rules(df: DataFrame, rules: DataFrame | Iterable[Rule], null_text: str | None = None) -> list[Check]:
    return [compile_rule(df, rule, null_text) for rule in as_rules(rules)]


# --- results ---------------------------------------------------------------


def _row_wise_results(df: DataFrame, checks: Sequence[Check], keys: Sequence[str]) -> DataFrame:
    """All row-wise rules in one aggregate, turned to one row per rule."""
    aggregates = [row_count().alias("_total")]
    for i, check in enumerate(checks):
        aggregates += [
            check.failed.cast("long").alias(f"_failed_{i}"),
            check.passed.cast("boolean").alias(f"_passed_{i}"),
            (F.lit(False) if check.needs_number is None else F.count(check.needs_number) == 0).alias(f"_none_{i}"),
        ]
    wide = df.groupBy(*[quoted(k) for k in keys]).agg(*aggregates)
    entries = F.array(
        *[
            _entry(
                check, Outcome(F.col(f"_failed_{i}"), F.col(f"_passed_{i}"), F.col(f"_none_{i}")), F.col("_total")
            )
            for i, check in enumerate(checks)
        ]
    )
    return wide.select(*[quoted(k) for k in keys], F.inline(entries))


def _entry(check: Check, outcome: Outcome, total: Column) -> Column:
    return F.struct(
        F.lit(check.rule.id).cast("long").alias("rule_id"),
        outcome.passed.alias("passed"),
        outcome.failed.alias("failed_rows"),
        total.alias("total_rows"),
        check.details(outcome).alias("details"),
    )


def _unique_results(df: DataFrame, checks: Sequence[Check], keys: Sequence[str]) -> DataFrame:
    """UNIQUE rules on one field: every member of a repeated value fails."""
    counted = value_counts(df, checks[0].rule.field_name, keys)
    per_group = counted.groupBy(*[quoted(k) for k in keys]).agg(
        F.coalesce(F.sum(F.when(F.col(COUNT) > 1, F.col(COUNT))), F.lit(0)).alias("_failed"),
        F.coalesce(F.sum(COUNT), F.lit(0)).alias("_total"),
    )
    outcome = Outcome(F.col("_failed"), F.col("_failed") == 0, F.lit(False))
    entries = F.array(*[_entry(check, outcome, F.col("_total")) for check in checks])
    return per_group.select(*[quoted(k) for k in keys], F.inline(entries))


def comparable(df: DataFrame, field: str) -> Column:
    """A field's value as UNIQUE compares it: NaN counts as null, and nulls are equal."""
    value = quoted(field)
    if isinstance(df.schema[field].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def value_counts(df: DataFrame, field: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per key group and value of a field (columns ``_value`` and ``_count``)."""
    return df.groupBy(*[quoted(k) for k in keys], comparable(df, field).alias(VALUE)).agg(row_count().alias(COUNT))


def run_checks_by(
    df: DataFrame, rules: DataFrame | Iterable[Rule], keys: Sequence[str], null_text: str | None = None
) -> DataFrame:
    """One result row per rule and key group (dataset, batch day, ...)."""
    checks = compile_rules(df, rules, null_text)
    row_wise = [c for c in checks if not c.unique]
    parts = [
        _row_wise_results(df, row_wise[i : i + RULES_PER_PASS], keys)
        for i in range(0, len(row_wise), RULES_PER_PASS)
    ]
    fields = dict.fromkeys(c.rule.field_name for c in checks if c.unique)
    parts += [_unique_results(df, [c for c in checks if c.unique and c.rule.field_name == f], keys) for f in fields]
    if not parts:
        schema = T.StructType([df.schema[k] for k in keys]).simpleString()[7:-1]
        spark = df.sparkSession
        head = ", ".join(p.replace(":", " ", 1) for p in schema.split(",")) if keys else ""
        return spark.createDataFrame([], (head + ", " if head else "") + RESULT_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_checks(df: DataFrame, rules: DataFrame | Iterable[Rule], null_text: str | None = None) -> DataFrame:
    """One result row per rule over the whole dataset."""
    return run_checks_by(df, rules, (), null_text)


# --- failing rows ----------------------------------------------------------


def violations(df: DataFrame, rules: DataFrame | Iterable[Rule], null_text: str | None = None) -> DataFrame:
    """Failing rows, once per rule they fail, tagged with ``rule_id``.

    Rules that fail a dataset as a whole (missing field, wrong column type, bad
    pattern, text without any number) mark no single rows.
    """
    checks = compile_rules(df, rules, null_text)
    masked = [c for c in checks if c.failing is not None]
    texts = [c for c in masked if c.needs_number is not None]
    # A text without any number fails as a whole. One row tells, read with the rows.
    seen = df.agg(F.struct(*[F.count(c.needs_number).alias(f"n{i}") for i, c in enumerate(texts)])).scalar() if texts else None
    numeric = {id(c): seen[f"n{i}"] > 0 for i, c in enumerate(texts)}
    tagged = []
    if masked:
        hits = F.array(*[F.when(c.failing & numeric.get(id(c), F.lit(True)), F.lit(c.rule.id).cast("long")) for c in masked])
        tagged.append(df.withColumn("rule_id", F.explode(F.array_compact(hits))))
    for check in (c for c in checks if c.unique):
        field = check.rule.field_name
        repeated = value_counts(df, field).where(F.col(COUNT) > 1)
        rows = semi_join_by_count(df.withColumn(VALUE, comparable(df, field)), repeated, [VALUE], COUNT)
        tagged.append(rows.drop(VALUE).withColumn("rule_id", F.lit(check.rule.id).cast("long")))
    if not tagged:
        return df.where(F.lit(False)).withColumn("rule_id", F.lit(None).cast("long"))
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out


def samples(
    df: DataFrame,
    rules: DataFrame | Iterable[Rule],
    order: Sequence[str] | None = None,
    n: int = SAMPLE_ROWS,
    null_text: str | None = None,
) -> DataFrame:
    """First ``n`` failing rows per rule: ``rule_id, sample_no, sample`` (JSON).

    ``order`` names the columns that give the row order; without it the order of
    the files is used. Spark keeps ``n`` rows per rule and task before shuffling.
    """
    columns = df.columns
    if order is None:
        df = df.withColumn("_position", F.monotonically_increasing_id())
        order = ["_position"]
    bad = violations(df, rules, null_text)
    top = pick_top(bad, ["rule_id"], [quoted(c) for c in order], n, "sample_no")
    return top.select(
        "rule_id",
        "sample_no",
        F.to_json(F.struct(*[quoted(c) for c in columns]), {"ignoreNullFields": "false"}).alias("sample"),
    )


def results_with_samples(
    df: DataFrame, rules: DataFrame | Iterable[Rule], order: Sequence[str] | None = None, null_text: str | None = None
) -> DataFrame:
    """Result rows with ``samples``: at most five JSON rows each."""
    rules = as_rules(rules)
    picked = (
        samples(df, rules, order, null_text=null_text)
        .groupBy("rule_id")
        .agg(F.array_sort(F.collect_list(F.struct("sample_no", "sample"))).alias("picked"))
        .select("rule_id", F.transform("picked", lambda s: s["sample"]).alias("samples"))
    )
    return (
        run_checks(df, rules, null_text)
        .join(picked, "rule_id", "left")
        .withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    )
