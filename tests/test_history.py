"""Star schema, loading, integrity, pipeline and state: golden and re-run cases."""

import glob
import uuid
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from truegauge.operators import analytics, extract, integrity, load, star
from truegauge.operators.analytics import Selection
from truegauge.operators.extract import History
from truegauge.operators.load import StarStore
from truegauge.operators.star import Star
from truegauge.plans import pipeline
from truegauge.sources import exports, relational, state

T0 = datetime(2026, 3, 9, 10, 0)
RESULTS = "id bigint, dataset_id bigint, rule_id bigint, passed boolean, failed_rows bigint, total_rows bigint, checked_at timestamp_ntz"
RULES = "id bigint, name string, rule_type string, severity string, field_name string, dataset_type string, is_active boolean"
DATASETS = "id bigint, name string, file_type string, row_count bigint, column_count int, uploaded_at timestamp_ntz, status string"


def history(spark, extra=()):
    results = [
        (1, 1, 1, True, 0, 100, T0),
        (2, 1, 2, False, 25, 500, T0 + timedelta(days=1)),
        (3, 2, 3, True, 0, 200, T0 + timedelta(days=3)),
        *extra,
    ]
    rules = [
        (1, "r1", "NOT_NULL", "HIGH", "email", "csv", True),
        (2, "r2", "RANGE", "MEDIUM", "age", "csv", True),
        (3, "r3", "UNIQUE", "LOW", "id", "all", False),
    ]
    datasets = [(1, "d1", "csv", 100, 5, T0, "VALIDATED"), (2, "d2", "json", 200, 3, T0, "PENDING")]
    return History(
        spark.createDataFrame(results, RESULTS), spark.createDataFrame(rules, RULES), spark.createDataFrame(datasets, DATASETS)
    )


def test_transform(spark):
    made = star.transform(extract.base_extract(history(spark)))
    tables = made.star
    assert (tables.dim_datasets.count(), tables.dim_rules.count(), tables.dim_date.count()) == (2, 3, 4)
    facts = {r["id"]: r for r in tables.facts.collect()}
    assert facts[2]["score"] == 95.0 and facts[2]["date_key"] == 20260310
    first = tables.dim_date.orderBy("date_key").first()
    assert (first.date_key, first.day_of_week, first.quarter) == (20260309, 0, 1)
    assert made.warnings.count() == 0


def test_dimensions_need_one_row_per_dataset_and_rule(spark):
    # A dataset that holds most results; results that know no rule, no dataset or no time.
    rows = [(100 + n, 2, 3 - n % 2, True, 0, 10, T0 - timedelta(hours=n % 7)) for n in range(400)]
    rows += [(5, 1, 9, True, 0, 10, T0 - timedelta(days=9)), (6, 9, 1, True, 0, 10, T0), (7, None, None, True, 0, 10, T0), (8, 1, 3, True, 0, 10, None)]
    h = history(spark, rows)
    # Keys that come twice, with other values.
    h = History(h.check_results, h.rules.union(h.rules.withColumn("severity", F.lit("LOW"))), h.datasets.union(h.datasets.withColumn("name", F.lit("a"))))
    raw, met = extract.base_extract(h), extract.dimension_extract(h)
    assert raw.count() > 1600 and met.count() == 4 * 5
    plain, reduced = star.build_star(raw), star.build_star(raw, met)
    for table in ("dim_datasets", "dim_rules", "dim_date", "facts"):
        one, other = getattr(plain, table), getattr(reduced, table)
        assert one.schema == other.schema and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert reduced.dim_date.count() == 4
    nothing = extract.dimension_extract(History(h.check_results.where("checked_at is null"), h.rules, h.datasets))
    assert star.build_dim_date(nothing).count() == 0 and star.build_dim_rules(nothing).count() == 1


def test_transform_warnings(spark):
    rows = [(4, 1, 1, True, 0, 0, T0), (5, 1, 1, False, 1, 10, T0), (6, 2, 1, True, 0, 5, None)]
    made = star.transform(extract.base_extract(history(spark, rows)))
    found = {r["check"]: r["n"] for r in made.warnings.collect()}
    assert found == {"NULL_CHECKED_AT": 1, "EMPTY_CHECK": 1, "DUPLICATE": 2, "INVALID_DATE_KEY": 1}
    facts = {r["id"]: r for r in made.star.facts.collect()}
    assert set(facts) == {2, 3, 5, 6} and facts[6]["date_key"] == 0


def test_empty_and_missing(spark):
    empty = extract.base_extract(history(spark)).where("false")
    tables = star.transform(empty).star
    assert tables.dim_date.count() == 0 and tables.facts.count() == 0
    with pytest.raises(star.SchemaError, match="total_rows"):
        star.transform(empty.drop("total_rows"))
    assert star.check_schema(empty, star.REQUIRED, "raw")[0].startswith("raw: Extra columns")


def test_half_even_scores(spark):
    df = spark.createDataFrame([(3, 800), (1, 800), (5, 800), (0, 0), (7, -1)], "failed bigint, total bigint")
    got = [r[0] for r in df.select(star.fact_score(F.col("failed"), F.col("total"))).collect()]
    assert got == [99.62, 99.88, 99.38, 0.0, 0.0]


def test_watermark_extract(spark):
    h = history(spark)
    utc = timezone.utc
    rows, newest, mode = extract.extract_with_watermark(h, None)
    assert (rows.count(), newest, mode) == (3, (T0 + timedelta(days=3)).replace(tzinfo=utc), "full")
    rows, _, mode = extract.extract_with_watermark(h, (T0 + timedelta(days=1)).replace(tzinfo=utc))
    assert (rows.count(), mode) == (2, "incremental")
    _, _, mode = extract.extract_with_watermark(h, (T0 + timedelta(days=9)).replace(tzinfo=utc))
    assert mode == "full"
    with pytest.raises(ValueError):
        extract.build_extract(h, "sideways")


def facts_of(spark, rows):
    return spark.createDataFrame(
        rows,
        "dataset_id bigint, rule_id bigint, date_key int, passed boolean, failed_rows bigint, total_rows bigint, score double, checked_at timestamp_ntz",
    )


GOOD = (1, 1, 20260309, True, 0, 100, 100.0, T0)


def star_with(spark, facts):
    made = star.transform(extract.base_extract(history(spark))).star
    return Star(made.dim_datasets, made.dim_rules, made.dim_date, facts_of(spark, facts))


@pytest.mark.parametrize(
    "fault, check, severity",
    [
        ((99, 1, 20260309, True, 0, 1, 100.0, T0), "FK_DATASET", "ERROR"),
        ((1, 99, 20260309, True, 0, 1, 100.0, T0), "FK_RULE", "ERROR"),
        ((1, 1, 20300101, True, 0, 1, 100.0, T0 + timedelta(hours=1)), "FK_DATE", "ERROR"),
        ((1, 2, 20260309, True, 0, 1, 100.5, T0), "INVALID_SCORE", "ERROR"),
        ((1, 2, 20260309, True, 0, 1, -0.1, T0), "INVALID_SCORE", "ERROR"),
        (GOOD, "DUPLICATE_FACTS", "WARNING"),
    ],
)
def test_integrity_faults(spark, fault, check, severity):
    tables = star_with(spark, [GOOD, fault])
    found = integrity.validate(tables.facts, tables)
    assert [(r["check"], r["severity"]) for r in found.collect()] == [(check, severity)]
    verdict = integrity.verdict(found).first()
    assert verdict.passed == (severity != "ERROR")
    if severity == "ERROR":
        with pytest.raises(integrity.IntegrityError):
            integrity.validate_with_guard(tables.facts, tables)
        with pytest.raises(Exception, match="validation failed"):
            integrity.guarded(found).collect()
    else:
        assert len(integrity.validate_with_guard(tables.facts, tables)) == 1


def test_row_count_mismatch_is_a_warning(spark):
    tables = star_with(spark, [GOOD])
    (row,) = integrity.validate(history(spark).check_results, tables).collect()
    assert (row["check"], row["severity"], row["details"]) == ("ROW_COUNT", "WARNING", '{"source":3,"target":1,"delta":-2}')


def test_summary_of_nothing_and_of_zeros(spark):
    empty = integrity.summary_statistics(facts_of(spark, [])).first()
    assert (empty.total_records, empty.success_rate, empty.avg_score, empty.max_score) == (0, 0.0, 0.0, 100.0)
    zero = integrity.summary_statistics(facts_of(spark, [(1, 1, 20260309, False, 5, 5, 0.0, T0)])).first()
    assert zero.max_score == 0.0


def test_load_twice_is_load_once(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    batch = star.transform(extract.base_extract(history(spark))).star
    first = store.load(batch)
    assert (first.dim_datasets, first.dim_rules, first.dim_date, first.fact_quality_checks) == (2, 3, 4, 3)
    second = store.load(batch)
    assert (second.fact_quality_checks, second.skipped) == (0, 3)
    tables = store.star()
    assert [t.count() for t in (tables.dim_datasets, tables.dim_rules, tables.dim_date, tables.facts)] == [2, 3, 4, 3]
    assert store.read("agg_daily_quality").count() == 3
    assert sorted(integrity.row_counts(batch.facts, tables.facts).first()) == [0, 3, 3]


def test_load_nothing(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    batch = star.transform(extract.base_extract(history(spark)).where("false")).star
    assert store.load(batch).total_loaded == 0


def test_incremental_load_touches_only_its_days(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    store.load(star.transform(extract.base_extract(history(spark))).star)
    days = tmp_path / "star" / "fact_quality_checks"
    before = {p: p.stat().st_mtime_ns for p in days.rglob("*.parquet")}
    late = history(spark, [(4, 2, 1, False, 2, 4, T0 + timedelta(days=3, hours=2))])
    more = star.transform(extract.build_extract(late, "incremental", T0 + timedelta(days=3))).star
    assert store.load(more).fact_quality_checks == 1
    after = {p: p.stat().st_mtime_ns for p in days.rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items())
    assert {p.parent.name for p in set(after) - set(before)} == {"date_key=20260312"}
    daily = {r["date_key"]: r for r in store.read("agg_daily_quality").where("dataset_id = 2").collect()}
    assert (daily[20260312]["total_checks"], daily[20260312]["avg_score"], daily[20260312]["high_severity_failures"]) == (2, 75.0, 1)


def test_append_then_dedupe(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    facts = star.transform(extract.base_extract(history(spark))).star.facts
    assert store.append_then_dedupe(facts).duplicates_removed == 0
    again = store.append_then_dedupe(facts.withColumn("score", F.lit(1.0)))
    assert (again.fact_quality_checks, again.duplicates_removed) == (3, 3)
    assert store.read("fact_quality_checks").where("score = 1.0").count() == 0


def test_append_then_dedupe_keeps_the_smallest_id(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    one = star.transform(extract.base_extract(history(spark))).star.facts.limit(1)
    batch = one.withColumn("id", F.lit(1)).withColumn("score", F.lit(50.0)).unionByName(one.withColumn("id", F.lit(2)).withColumn("score", F.lit(10.0)))
    store.append_then_dedupe(batch.withColumn("id", F.col("id").cast("long")))
    assert [r["score"] for r in store.read("fact_quality_checks").collect()] == [50.0]


def test_upsert_overwrites_dimensions(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    batch = star.transform(extract.base_extract(history(spark))).star
    store.load(batch)
    renamed = Star(batch.dim_datasets.where("id = 1").withColumn("name", F.lit("new")), batch.dim_rules, batch.dim_date, batch.facts)
    store.load(renamed)
    assert {r["id"]: r["name"] for r in store.read("dim_datasets").collect()} == {1: "new", 2: "d2"}


def test_daily_rows_follow_a_changed_severity(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    batch = star.transform(extract.base_extract(history(spark))).star
    store.load(batch)
    one_day = batch.facts.where(F.col("date_key") == batch.facts.agg(F.max("date_key")).first()[0])
    rules = batch.dim_rules.withColumn("severity", F.lit("LOW"))
    store.load(Star(batch.dim_datasets, rules, batch.dim_date, one_day))
    want = load.daily_aggregate(store.read("fact_quality_checks"), store.read("dim_rules"))
    got = store.read("agg_daily_quality").select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_unfinished_version_is_ignored(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    store.load(star.build_star(extract.base_extract(history(spark))))
    # A job that died after writing its folder, before announcing it.
    store.read("dim_rules").limit(1).write.parquet(store.path("dim_rules") + "/v2-dead")
    assert store.read("dim_rules").count() == 3
    store.replace("dim_rules", store.read("dim_rules").where("id < 3"))
    assert store.read("dim_rules").count() == 2


def test_days_can_be_swapped_again(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    store.load(star.build_star(extract.base_extract(history(spark))))
    before = sorted(map(tuple, store.read("agg_daily_quality").collect()))
    staged = glob.glob(store.path("agg_daily_quality") + "__staged/*")
    store.swap_days("agg_daily_quality", staged[-1])
    assert sorted(map(tuple, store.read("agg_daily_quality").collect())) == before


def test_pipeline_runs(spark, tmp_path):
    root = str(tmp_path / "run")
    h = history(spark)
    dry = pipeline.run(spark, h, root, dry_run=True)
    assert dry.success and dry.records_extracted == 3 and not StarStore(spark, f"{root}/star").exists("dim_rules")
    full = pipeline.run(spark, h, root)
    assert full.success and full.validation_passed and full.summary.fact_quality_checks == 3
    kept = state.load_state(spark, f"{root}/_state")
    assert kept.high_watermark == (T0 + timedelta(days=3)).replace(tzinfo=timezone.utc) and kept.last_run_id == full.run_id
    more = history(spark, [(4, 1, 1, True, 0, 10, T0 + timedelta(days=4))])
    inc = pipeline.run(spark, more, root, mode="incremental")
    assert (inc.records_extracted, inc.summary.fact_quality_checks, inc.summary.skipped) == (2, 1, 1)
    log = spark.read.parquet(f"{root}/etl_run_log").orderBy("started_at").collect()
    assert [(r["mode"], r["status"], r["records_loaded"]) for r in log] == [("full", "success", 3), ("incremental", "success", 1)]


def scans(folder):
    return len(glob.glob(f"{folder}/*"))


def watched(df, folder):
    """``df`` from a source that leaves a file behind each time it is read."""
    folder.mkdir(exist_ok=True)

    def read(batches):
        (folder / uuid.uuid4().hex).touch()
        yield from batches

    return df.coalesce(1).mapInArrow(read, df.schema)


def test_a_run_reads_the_source_once(spark, tmp_path):
    h, root = history(spark), str(tmp_path / "run")
    for n, mode in enumerate(("full", "incremental")):
        marks = tmp_path / mode
        more = history(spark, [(4, 1, 1, True, 0, 10, T0 + timedelta(days=4))]) if n else h
        results = watched(more.check_results, marks)
        run = pipeline.run(spark, History(results, more.rules, more.datasets), root, mode=mode)
        assert run.success and run.validation_passed and run.summary.fact_quality_checks == (1 if n else 3)
        assert scans(marks) == 1
    kept = state.load_state(spark, f"{root}/_state")
    assert (kept.source_rows, kept.rows_at_mark) == (4, 1) and run.findings == []


def test_watermark_ahead_of_the_source_means_a_full_run(spark, tmp_path):
    root = str(tmp_path / "run")
    state.save_state(spark, f"{root}/_state", state.State(datetime(2099, 1, 1, tzinfo=timezone.utc), "x", "x"))
    run = pipeline.run(spark, history(spark), root, mode="incremental")
    assert (run.records_extracted, run.summary.fact_quality_checks) == (3, 3)
    assert state.load_state(spark, f"{root}/_state").high_watermark == (T0 + timedelta(days=3)).replace(tzinfo=timezone.utc)


def test_source_rows_without_a_rule_count_but_do_not_load(spark, tmp_path):
    stray = history(spark, [(4, 1, 99, True, 0, 10, T0 + timedelta(days=2))])
    run = pipeline.run(spark, stray, str(tmp_path / "run"))
    assert run.records_extracted == 3 and [f["check"] for f in run.findings] == ["ROW_COUNT"]
    assert "Source: 4, Target: 3" in run.findings[0]["message"]


def test_validation_of_increments_equals_the_full_one(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    batch = star.transform(extract.base_extract(history(spark))).star
    days = sorted(r.date_key for r in batch.facts.select("date_key").distinct().collect())
    known = batch.dim_rules.where("id <> 3")
    for n, day in enumerate(days):
        part = batch.facts.where(F.col("date_key") == day)
        # A repeated fact and a score out of range come with the first day.
        part = part.unionByName(part.withColumn("id", F.col("id") + 100).withColumn("score", F.lit(150.0))) if n == 0 else part
        summary = store.load(Star(batch.dim_datasets, known, batch.dim_date, part))
        store.append_facts(part.where("score > 100"))
        got = store.refresh_validation(summary.days).first()
        want = integrity.totals(integrity.day_figures(store.star())).first()
        assert got == want
    # The missing rule arrives with a batch of another day: its orphans are gone.
    assert got.orphan_rules > 0
    summary = store.load(Star(batch.dim_datasets, batch.dim_rules, batch.dim_date, batch.facts.where(F.col("date_key") == days[0])))
    got = store.refresh_validation(summary.days).first()
    assert got.orphan_rules == 0 and got == integrity.totals(integrity.day_figures(store.star())).first()
    assert got.duplicate_groups >= 1 and got.invalid_scores >= 1


def test_validation_reads_only_the_given_days(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    batch = star.transform(extract.base_extract(history(spark))).star
    summary = store.load(batch)
    store.refresh_validation(summary.days)
    before = {r.date_key: r.asDict() for r in store.read("validation_by_day").collect()}
    files = set(glob.glob(store.path("validation_by_day") + "/date_key=*/*.parquet"))
    store.refresh_validation(summary.days[:1])
    after = {r.date_key: r.asDict() for r in store.read("validation_by_day").collect()}
    changed = files ^ set(glob.glob(store.path("validation_by_day") + "/date_key=*/*.parquet"))
    assert before == after and {f.split("date_key=")[1].split("/")[0] for f in changed} == {str(summary.days[0])}


def test_upsert_without_changes_writes_nothing(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    rules = spark.range(500).select("id", F.concat(F.lit("r"), "id").alias("name"), F.lit(None).cast("string").alias("note"))
    store.replace("dim_rules", rules)

    def files():
        return set(glob.glob(store.path("dim_rules") + "/**/*.parquet", recursive=True))

    before = files()
    store._upsert("dim_rules", rules)
    assert files() == before
    one = rules.where("id = 7").withColumn("note", F.lit("new"))
    store._upsert("dim_rules", one.unionByName(spark.createDataFrame([(1000, "r1000", None)], rules.schema)))
    # Two rows changed: at most two buckets were written.
    assert 1 <= len(files() - before) <= 2
    rows = {r.id: r.note for r in store.read("dim_rules").collect()}
    assert len(rows) == 501 and rows[7] == "new" and rows[8] is None
    store.replace("dim_rules", rules.where("id < 0"))
    assert store.read("dim_rules").count() == 0 and store.read("dim_rules").columns == rules.columns
    store._upsert("dim_rules", one)
    assert [tuple(r) for r in store.read("dim_rules").collect()] == [(7, "r7", "new")]


def test_loads_send_no_table_to_the_driver(spark, tmp_path):
    h = history(spark)
    store = StarStore(spark, str(tmp_path))
    store.load(star.build_star(extract.base_extract(h)))
    rules, facts = store.read("dim_rules"), store.read("fact_quality_checks")
    joins = {
        "upsert": (load.upsert(rules, rules.where("id > 1")), 3),
        "insert_ignore": (load.insert_ignore(rules.where("id > 1"), rules, ["id"]), 1),
        "new_facts": (load.new_facts(facts.where("rule_id > 1"), facts), 1),
        "changed_rows": (load.changed_rows(rules, rules.withColumn("severity", F.lit("LOW"))), 2),
    }
    for name, (df, n) in joins.items():
        plan = df._jdf.queryExecution().executedPlan()
        before = plan.toString()
        assert len(df.collect()) == n, name
        assert "Broadcast" not in before and "Broadcast" not in plan.toString(), name


def test_compaction_leaves_few_files_and_the_same_facts(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    facts = star.transform(extract.base_extract(history(spark))).star.facts
    store.append_facts(facts.withColumn("rule_id", F.lit(77).cast("long")))
    busy = facts.where("id = 1")
    for n in range(12):
        store.append_facts(busy.withColumn("rule_id", F.lit(n).cast("long")))
    day = busy.first().date_key

    def files(d):
        return len(glob.glob(f"{store.path('fact_quality_checks')}/date_key={d}/*.parquet"))

    before = sorted(map(repr, store.read("fact_quality_checks").collect()))
    assert files(day) == 13
    others = {d.date_key: files(d.date_key) for d in facts.where("id <> 1").select("date_key").collect()}
    assert store.compact(most=4) == [day]
    assert files(day) == 1 and {d: files(d) for d in others} == others
    assert sorted(map(repr, store.read("fact_quality_checks").collect())) == before
    assert store.compact(most=4) == []


def test_pipeline_failure_keeps_watermark(spark, tmp_path):
    root = str(tmp_path / "bad")
    broken = history(spark, [(4, 1, 1, True, -50, 10, T0 + timedelta(days=4))])
    result = pipeline.run(spark, broken, root)
    assert result.success and not result.validation_passed
    assert state.load_state(spark, f"{root}/_state").high_watermark is None
    with pytest.raises(integrity.IntegrityError):
        pipeline.run(spark, broken, root, strict=True)


def test_pipeline_without_data(spark, tmp_path):
    h = history(spark)
    empty = History(h.check_results.where("false"), h.rules, h.datasets)
    result = pipeline.run(spark, empty, str(tmp_path / "none"))
    assert result.success and result.warnings == ["No data to process"]


def test_selection():
    chosen = Selection.of(["1", 2, "x"], date(2026, 3, 1), date(2026, 3, 2), ["HIGH", "URGENT"])
    assert (chosen.datasets, chosen.severities) == ([1, 2], ("HIGH",))
    for ids, severities in ((["x"], ["HIGH"]), ([1], ["URGENT"])):
        with pytest.raises(ValueError):
            Selection.of(ids, date(2026, 3, 1), date(2026, 3, 2), severities)


def test_dashboard_by_ids(spark):
    tables = star.transform(extract.base_extract(history(spark))).star
    sel = Selection.of([1], date(2026, 3, 1), date(2026, 3, 31), ["HIGH", "MEDIUM", "LOW"])
    kpi = analytics.kpi_derived(tables, sel).first()
    assert (kpi.total_checks, kpi.failed_checks, kpi.avg_score, kpi.pass_rate, kpi.status) == (2, 1, 97.5, 50.0, "Healthy")
    none = Selection.of([77], date(2026, 3, 1), date(2026, 3, 31), ["HIGH"])
    empty = analytics.kpi_derived(tables, none).first()
    assert (empty.total_checks, empty.pass_rate, empty.avg_score) == (0, 0.0, None)
    assert analytics.trend_change(tables, sel).first().trend == -5.0


def test_exports(spark, tmp_path):
    store = StarStore(spark, str(tmp_path / "star"))
    store.load(star.build_star(extract.base_extract(history(spark))))
    tables = store.star()
    sel = Selection.of(None, date(2026, 3, 1), date(2026, 3, 31), ["HIGH", "MEDIUM", "LOW"])
    written = exports.export_report(tables, sel, str(tmp_path / "report"))
    assert written == ["kpi_summary", "quality_trends", "failure_analysis", "dataset_comparison", "field_issues", "day_of_week"]
    again = spark.read.option("header", True).csv(str(tmp_path / "report" / "section=dataset_comparison"))
    assert again.columns == ["dataset", "avg_score", "total_checks", "passed", "failed", "score_std"]
    passing = Selection.of([2], date(2026, 3, 1), date(2026, 3, 31), ["LOW"])
    assert "field_issues" not in exports.export_report(tables, passing, str(tmp_path / "short"))
    text = exports.report_summary(tables, sel, datetime(2026, 4, 1, tzinfo=timezone.utc)).first()[0]
    assert '"overall_health":{"status":"Healthy","avg_score":98.3}' in text and '"pass_rate":66.7' in text


def test_jdbc_options_split_the_table():
    one = relational.jdbc_options("jdbc:x", "datasets")
    assert one == {"url": "jdbc:x", "dbtable": "datasets", "fetchsize": "1000"}
    many = relational.jdbc_options("jdbc:x", "check_results", "id", (1, 900), 16, driver="d")
    assert (many["partitionColumn"], many["lowerBound"], many["upperBound"], many["numPartitions"]) == ("id", "1", "900", "16")


def test_state_is_tolerant(spark, tmp_path):
    assert state.load_state(spark, str(tmp_path / "absent")) == state.State()
    assert state.parse_watermark("nonsense") is None
    assert state.parse_watermark("2026-03-09T10:00:00") == T0.replace(tzinfo=timezone.utc)
