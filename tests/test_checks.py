"""Golden cases of the five checks, scoring and parameters."""

import math

import pytest
from pyspark.sql import functions as F

from truegauge.operators import checks, rules, scoring
from truegauge.operators.rules import Rule


def one(df, rule, **options):
    return checks.run_checks(df, [rule], **options).first()


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"f {kind}")


def dtype_rule(expected, **more):
    return Rule(1, "f", "DATA_TYPE", parameters={"expected_type": expected, **more})


def test_not_null(spark):
    r = one(column(spark, ["Alice", None, "Carol"]), Rule(1, "f", "NOT_NULL"))
    assert (r.passed, r.failed_rows, r.total_rows) == (False, 1, 3)
    assert r.details == "1 null values found in f"
    assert one(column(spark, ["a"]), Rule(1, "f", "NOT_NULL")).details == "No null values in f"


def test_nan_is_null(spark):
    assert one(column(spark, [1.0, math.nan, None], "double"), Rule(1, "f", "NOT_NULL")).failed_rows == 2


def test_missing_field(spark):
    r = one(column(spark, ["x"]), Rule(1, "nope", "NOT_NULL"))
    assert (r.passed, r.failed_rows, r.details) == (False, 1, "Field nope not found in dataset")


def test_dotted_field(spark):
    df = spark.createDataFrame([(1,), (None,)], "`a.b` int")
    assert one(df, Rule(1, "a.b", "NOT_NULL")).failed_rows == 1


@pytest.mark.parametrize(
    "values, kind, expected, failed",
    [
        ([1.5, 2.5, 3.5], "double", "int", 3),
        ([1, 2, 3], "bigint", "int", 0),
        ([1, None, 3], "bigint", "int", 3),
        ([1, None, 3], "bigint", "float", 0),
        ([None, None], "string", "float", 0),
        ([1.0, None], "double", "float", 0),
        ([True, False], "boolean", "bool", 0),
        ([True, None], "boolean", "bool", 2),
        (["a", "b"], "string", "STR", 0),
        (["abc", "def", "ghi"], "string", "numeric", 3),
        (["1", " 2.5 ", "1e3", "1d", "1f", None, "inf", "-.5", "NaN"], "string", "numeric", 4),
        ([True, False], "boolean", "numeric", 0),
        (["not-a-date", "also-not"], "string", "datetime", 2),
        (["2024-01-31", "2024-01-31T10:00:00Z", "2024-02-30", None], "string", "datetime", 2),
        ([1, 2], "bigint", "datetime", 0),
        (["a"], "string", "money", 1),
    ],
)
def test_types(spark, values, kind, expected, failed):
    r = one(column(spark, values, kind), dtype_rule(expected))
    assert (r.failed_rows, r.passed) == (failed, failed == 0)


def test_datetime_format(spark):
    assert one(column(spark, ["31/01/2024", "2024-01-31"]), dtype_rule("datetime", format="dd/MM/yyyy")).failed_rows == 1


@pytest.mark.parametrize(
    "values, kind, bounds, failed, passed",
    [
        ([10, 30, 100], "bigint", {"min": 18, "max": 65}, 2, False),
        ([5, 15, 25], "bigint", {"min": 10}, 1, False),
        ([5, 15, 25], "bigint", {"max": 20}, 1, False),
        ([18, 65], "bigint", {"min": 18, "max": 65}, 0, True),
        ([1.0, None, math.nan], "double", {"min": 0}, 2, False),
        ([math.inf], "double", {"min": 0}, 0, True),
        ([math.inf], "double", {"max": 5}, 1, False),
        (["10", "x", None, "70"], "string", {"max": 65}, 3, False),
        (["a", "b"], "string", {"min": 1}, 2, False),
        ([], "string", {"min": 1}, 0, False),
        ([], "bigint", {"min": 1}, 0, True),
    ],
)
def test_range(spark, values, kind, bounds, failed, passed):
    r = one(column(spark, values, kind), Rule(1, "f", "RANGE", parameters=bounds))
    assert (r.failed_rows, r.passed) == (failed, passed)


def test_range_messages(spark):
    r = one(column(spark, [1, 9], "int"), Rule(1, "f", "RANGE", parameters={"min": 2}))
    assert r.details == "1 values outside range [2, None] or non-numeric"
    assert one(column(spark, ["a"]), Rule(1, "f", "RANGE")).details == "Field f is not numeric"


@pytest.mark.parametrize(
    "values, kind, failed",
    [([1, 2, 2, 3, 3], "int", 4), ([None, None, 1], "int", 2), ([math.nan, None, 1.0], "double", 2), ([1, 2], "int", 0), ([], "int", 0)],
)
def test_unique(spark, values, kind, failed):
    r = one(column(spark, values, kind), Rule(1, "f", "UNIQUE"))
    assert (r.failed_rows, r.total_rows, r.passed) == (failed, len(values), failed == 0)


@pytest.mark.parametrize(
    "values, pattern, failed",
    [
        (["a@b.c", "bad", "x@y.z"], r".+@.+\..+", 1),
        (["abc", "xabc"], "abc", 1),
        (["abcd"], "ab|x", 0),
        (["b", "xb"], "a|b", 1),
        (["été1"], r"\w+\d$", 0),
        (["aa", "ab"], r"(?P<first>a)(?P=first)", 1),
        (["a", None], ".+", 1),
        (["x\ny"], "x$", 1),
    ],
)
def test_regex(spark, values, pattern, failed):
    assert one(column(spark, values), Rule(1, "f", "REGEX", parameters={"pattern": pattern})).failed_rows == failed


def test_regex_null_text(spark):
    rule = Rule(1, "f", "REGEX", parameters={"pattern": ".+"})
    assert one(column(spark, ["a", None]), rule, null_text="nan").failed_rows == 0


def test_bad_patterns(spark):
    df = column(spark, ["a", "b"])
    assert one(df, Rule(1, "f", "REGEX")).details == "No pattern provided"
    r = one(df, Rule(1, "f", "REGEX", parameters={"pattern": "("}))
    assert r.failed_rows == 2 and r.details.startswith("Invalid regex pattern:")


def test_unknown_rule_type(spark):
    r = one(column(spark, ["a", "b"]), Rule(1, "f", "CHECKSUM"))
    assert (r.passed, r.failed_rows, r.total_rows) == (False, 0, 2)


def test_mixed_frame(spark):
    df = spark.createDataFrame(
        [
            (1, "Alice", "25", "85", "2024-01-01", "a@b.com"),
            (2, None, "30", "105", "2024-01-02", "b@b.com"),
            (3, "Carol", "invalid", "70", "not-a-date", "c@c.com"),
            (3, "Dan", "40", "60", "2024-01-04", "d@d"),
        ],
        "id int, name string, age string, score string, day string, email string",
    )
    many = [
        Rule(1, "name", "NOT_NULL"),
        Rule(2, "age", "DATA_TYPE", parameters={"expected_type": "numeric"}),
        Rule(3, "score", "RANGE", parameters={"min": 0, "max": 100}),
        Rule(4, "day", "DATA_TYPE", parameters={"expected_type": "datetime"}),
        Rule(5, "email", "REGEX", parameters={"pattern": r"^[^@]+@[^@]+\.[^@]+$"}),
        Rule(6, "id", "UNIQUE"),
        Rule(7, "gone", "NOT_NULL"),
    ]
    failed = {r.rule_id: r.failed_rows for r in checks.run_checks(df, many).collect()}
    assert failed == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 4}
    rows = checks.results_with_samples(df, many, order=["id", "name"]).collect()
    picked = {r.rule_id: r.samples for r in rows}
    assert len(picked[6]) == 2 and picked[7] == [] and '"name":null' in picked[1][0]
    bad = {(r.rule_id, r.id) for r in checks.violations(df, many).collect()}
    assert bad == {(1, 2), (2, 3), (3, 2), (4, 3), (5, 3), (6, 3)}


def test_text_without_numbers_has_no_violations(spark):
    df = column(spark, ["a", "b"])
    assert checks.violations(df, [Rule(1, "f", "RANGE", parameters={"min": 1})]).count() == 0


def test_samples_stop_at_five_in_order(spark):
    df = spark.range(100).withColumn("v", F.lit(None).cast("int"))
    got = checks.samples(df, [Rule(1, "v", "NOT_NULL")], order=["id"]).orderBy("sample_no").collect()
    assert [r["sample"] for r in got] == [f'{{"id":{i},"v":null}}' for i in range(5)]


def test_one_job_for_all_row_rules(spark):
    """The plan reads the data once, however many row-wise rules there are."""
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    many = [Rule(n, "v", "RANGE", parameters={"max": n}) for n in range(40)]
    plan = checks.run_checks(df, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 50") == 1


def test_more_rules_than_one_pass(spark):
    df = column(spark, ["1", "2"])
    many = [Rule(n, "f", "NOT_NULL") for n in range(checks.RULES_PER_PASS + 5)]
    assert checks.run_checks(df, many).count() == len(many)


def test_unique_keeps_the_row_as_it_is(spark):
    df = spark.createDataFrame([(1, 10.0, 5), (1, 20.0, 6), (2, 30.0, 7)], "k int, value double, n int")
    got = sorted(tuple(r) for r in checks.violations(df, [Rule(4, "k", "UNIQUE")]).collect())
    assert got == [(1, 10.0, 5, 4), (1, 20.0, 6, 4)]
    grouped = checks.run_checks_by(df, [Rule(4, "k", "UNIQUE")], ["value", "n"]).collect()
    assert len(grouped) == 3 and {r.failed_rows for r in grouped} == {0}


def test_no_rules(spark):
    assert checks.run_checks(column(spark, ["a"]), []).count() == 0
    assert checks.run_checks_by(column(spark, ["a"]), [], ["f"]).columns[0] == "f"


# --- scores ----------------------------------------------------------------


def score(spark, outcome, severities):
    rows = [(n, failed == 0, failed, total) for n, (failed, total) in outcome.items()]
    results = spark.createDataFrame(rows, "rule_id bigint, passed boolean, failed_rows bigint, total_rows bigint")
    return scoring.score_results(results, [Rule(n, "f", "NOT_NULL", s) for n, s in severities.items()]).first()


def test_scores(spark):
    assert score(spark, {1: (0, 10), 2: (10, 10)}, {1: "HIGH", 2: "LOW"}).score == 75.0
    assert score(spark, {1: (4, 4), 2: (0, 4), 3: (0, 4)}, {1: "HIGH", 2: "MEDIUM", 3: "LOW"}).score == 50.0
    r = score(spark, {1: (2, 10)}, {1: "HIGH"})
    assert (r.score, r.total_rules, r.passed_rules, r.failed_rules) == (80.0, 1, 0, 1)
    r = score(spark, {1: (0, 10)}, {1: "HIGH", 2: "LOW"})
    assert (r.score, r.failed_rules) == (75.0, 1)


def test_no_rules_scores_100(spark):
    r = score(spark, {1: (1, 1)}, {})
    assert (r.score, r.total_rules, r.passed_rules, r.failed_rules) == (100.0, 0, 0, 0)


def test_score_per_dataset(spark):
    datasets = spark.createDataFrame([(1, "csv"), (2, "JSON"), (3, "parquet")], "id bigint, file_type string")
    catalogue = spark.createDataFrame(
        [(1, "HIGH", "csv", True), (2, "LOW", "all", True), (3, "HIGH", "json", False), (4, "MEDIUM", "json", True)],
        "id bigint, severity string, dataset_type string, is_active boolean",
    )
    results = spark.createDataFrame(
        [(1, 1, True, 0, 10), (1, 2, False, 10, 10), (2, 2, True, 0, 0), (2, 3, False, 5, 5)],
        "dataset_id bigint, rule_id bigint, passed boolean, failed_rows bigint, total_rows bigint",
    )
    got = {r.dataset_id: (r.score, r.total_rules, r.failed_rules) for r in scoring.quality_score(datasets, catalogue, results).collect()}
    assert got == {1: (75.0, 2, 1), 2: (33.33, 2, 1), 3: (0.0, 1, 1)}
    none = scoring.quality_score(datasets, catalogue.where("false"), results)
    assert {r.score for r in none.collect()} == {100.0}


def test_audit_trigger_is_checked(spark):
    with pytest.raises(ValueError):
        scoring.audit_rows(spark.range(1), "sometimes")


# --- parameters ------------------------------------------------------------


def test_parameter_repair(spark):
    given = ["", "  ", '{"min": 1}', r'{"pattern": "^\d+$"}', r'{"pattern": "a\\b"}', "{oops", None]
    df = column(spark, given)
    got = [r[0] for r in df.select(rules.parse_parameters(F.col("f"))).collect()]
    assert got == ["", "  ", '{"min": 1}', r'{"pattern": "^\\d+$"}', r'{"pattern": "a\\b"}', None, ""]
    assert rules.repair_parameters(r'{"pattern": "^\d+$"}') == r'{"pattern": "^\\d+$"}'
    with pytest.raises(ValueError):
        rules.repair_parameters("{oops")


def test_rules_from_rows(spark):
    df = spark.createDataFrame(
        [(2, "f", "RANGE", "HIGH", '{"max": 5}'), (1, "f", "NOT_NULL", None, "")],
        "id int, field_name string, rule_type string, severity string, parameters string",
    )
    first, second = rules.read_rules(df)
    assert (first.id, first.severity, first.parameters) == (1, "MEDIUM", {})
    assert second.parameters == {"max": 5}
    assert checks.run_checks(column(spark, [4, 9], "int"), df).count() == 2


def test_check_run_without_an_eligible_dataset(spark, data):
    from truegauge.plans import check_run
    from truegauge.plans.history import Inputs

    inputs = Inputs(spark, data)
    rows = inputs.lineitem.withColumn("dataset_id", F.lit(1).cast("long"))
    done = check_run.run(rows, inputs.datasets.where("false"), inputs.rules, inputs.alert_configs, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    assert [df.count() for df in (done.scores, done.results, done.audit, done.alerts)] == [0, 0, 0, 0]


def test_text_without_numbers_marks_no_row_and_runs_nothing_early(spark):
    df = spark.createDataFrame([(1, "a", "1"), (2, "b", "x")], "id bigint, words string, some string")
    rules = [Rule(1, "words", "RANGE", "HIGH", {"min": 0}), Rule(2, "some", "RANGE", "HIGH", {"min": 0})]
    group = "violations-plan"
    spark.sparkContext.setJobGroup(group, group)
    found = checks.violations(df, rules)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.id, r.rule_id) for r in found.collect()] == [(2, 2)]
