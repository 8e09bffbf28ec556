"""Extract, star schema, load, integrity and analytics (groups G to K)."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from truegauge.operators import analytics, extract, integrity, load, star
from truegauge.operators.analytics import Selection
from truegauge.operators.star import Star
from truegauge.plans.history import Inputs
from truegauge.plans.registry import query
from truegauge.session import scratch_dir
from truegauge.plans.warehouse import stored

AS_OF = datetime(2024, 1, 20, 6, 0)

# --- comparison text -------------------------------------------------------

EXTRACT = """
extract as (
  select r.id, r.dataset_id, r.rule_id, r.passed, r.failed_rows, r.total_rows, r.checked_at,
         u.name as rule_name, u.rule_type, u.severity, u.field_name, u.dataset_type, u.is_active,
         d.name as dataset_name, d.file_type, d.row_count as dataset_row_count, d.column_count, d.uploaded_at,
         d.status as dataset_status
  from check_results r join rules u on r.rule_id = u.id join datasets d on r.dataset_id = d.id)"""

_SCORE = "case when total_rows > 0 then round_even(cast(total_rows - failed_rows as double) / total_rows * 100, 2) else 0.0 end"
_DATE_KEY = "coalesce(cast(year(checked_at) * 10000 + month(checked_at) * 100 + day(checked_at) as int), 0)"


def _facts(name: str, source: str, order: str | None = "id desc") -> str:
    only = f"qualify row_number() over (partition by dataset_id, rule_id, checked_at order by {order}) = 1" if order else ""
    return f"""
{name} as (
  select id, dataset_id, rule_id, {_DATE_KEY} as date_key, passed, failed_rows, total_rows, {_SCORE} as score, checked_at
  from {source} {only})"""


DIMS = """
dim_datasets as (select distinct dataset_id as id, dataset_name as name, file_type, dataset_row_count as row_count,
                        column_count, dataset_status as status, uploaded_at from extract),
dim_rules as (select distinct rule_id as id, rule_name as name, field_name, rule_type, severity, dataset_type, is_active from extract),
dim_date as (
  select cast(year(d) * 10000 + month(d) * 100 + day(d) as int) as date_key, d as full_date,
         cast(isodow(d) - 1 as int) as day_of_week, cast(month(d) as int) as month, cast(quarter(d) as int) as quarter,
         cast(year(d) as int) as year
  from (select cast(unnest(generate_series(cast(min(cast(checked_at as date)) as timestamp), cast(max(cast(checked_at as date)) as timestamp), interval 1 day)) as date) as d
        from extract))"""

STAR = "with " + EXTRACT + "," + _facts("facts", "extract") + "," + DIMS
# Facts of every check result, known rule or not, repeats kept: what a broken load leaves.
RAW_STAR = "with " + EXTRACT + "," + _facts("facts", "check_results", None) + "," + DIMS

SELECTED = """,
sel as (
  select f.*, d.full_date, d.day_of_week, u.rule_type, u.severity, u.field_name, s.name as dataset_name,
         cast(round(f.score * 100) as bigint) as cents
  from facts f join dim_date d on f.date_key = d.date_key join dim_rules u on f.rule_id = u.id
  join dim_datasets s on f.dataset_id = s.id
  where d.full_date between date '2024-01-03' and date '2024-01-28' and u.severity in ('HIGH', 'MEDIUM')
    and f.dataset_id in (select id from datasets where status <> 'ERROR'))
"""


def half_up(num: str, den: str, digits: int) -> str:
    """Exact decimal rounding of num/den (non-negative integers)."""
    scale = 10**digits
    return f"((2 * cast({num} as hugeint) * {scale} + {den}) // (2 * {den})) / {float(scale)}"


MEAN1 = half_up("sum(cents)", "(count(*) * 100)", 1)
RATE1 = half_up("count(*) filter (where not passed) * 100", "count(*)", 1)


# --- inputs on the Spark side ----------------------------------------------


def raw(i: Inputs):
    return extract.base_extract(i.history)


def met(i: Inputs):
    return extract.dimension_extract(i.history)


def built(i: Inputs) -> Star:
    return star.build_star(raw(i), met(i))


def once(i: Inputs, df):
    """``df`` written to the scratch folder and read back: what a query uses several times."""
    path = scratch_dir(i.spark, "star")
    df.write.parquet(path)
    return i.spark.read.schema(df.schema).parquet(path)


def raw_star(i: Inputs) -> Star:
    rows = met(i)
    facts = star.build_facts(i.check_results, dedupe=False)
    return Star(star.build_dim_datasets(rows), star.build_dim_rules(rows), star.build_dim_date(rows), facts)


def selection(i: Inputs) -> Selection:
    chosen = i.datasets.where("status <> 'ERROR'").select("id")
    return Selection.of(chosen, date(2024, 1, 3), date(2024, 1, 28), ["HIGH", "MEDIUM", "URGENT"])


def _dated(df):
    return df.withColumn("full_date", F.col("full_date").cast("date"))


# --- G: extract ------------------------------------------------------------


@query("g01_base_extract", "with " + EXTRACT + " select * from extract")
def _base(i: Inputs):
    return raw(i)


@query(
    "g02_incremental_extract",
    "with " + EXTRACT + " select * from extract where checked_at >= timestamp '2024-01-20 06:00:00'",
)
def _incremental(i: Inputs):
    return extract.build_extract(i.history, "incremental", AS_OF)


@query("g03_high_watermark", "select max(checked_at) as high_watermark from check_results")
def _watermark(i: Inputs):
    return extract.high_watermark(i.check_results)


@query(
    "g04_record_count", "select count(*) as records from check_results where checked_at >= timestamp '2024-01-20 06:00:00'"
)
def _records(i: Inputs):
    return extract.record_count(i.check_results, "incremental", AS_OF)


@query("g05_extract_after_watermark", "with " + EXTRACT + " select * from extract where checked_at >= timestamp '2024-01-20 06:00:00'")
def _after(i: Inputs):
    return extract.extract_with_watermark(i.history, AS_OF.replace(tzinfo=timezone.utc))[0]


# --- H: transform ----------------------------------------------------------

# An extract with gaps: some results lose their time, their rule or all their rows.
_GAPS = """
gaps as (select id, dataset_id, case when failed_rows = 13 then null else rule_id end as rule_id, passed, failed_rows,
                case when failed_rows = 17 then null else total_rows end as total_rows,
                case when total_rows = 300 then null else checked_at end as checked_at from check_results)"""


def _gaps(i: Inputs):
    return i.check_results.selectExpr(
        "id",
        "dataset_id",
        "case when failed_rows = 13 then null else rule_id end as rule_id",
        "passed",
        "failed_rows",
        "case when failed_rows = 17 then null else total_rows end as total_rows",
        "case when total_rows = 300 then null else checked_at end as checked_at",
    )


@query(
    "h01_raw_problems",
    "with "
    + _GAPS
    + """, n as (
    select 'NULL_RULE_ID' as check, count(*) filter (where rule_id is null) as n from gaps
    union all select 'NULL_TOTAL_ROWS', count(*) filter (where total_rows is null) from gaps
    union all select 'NULL_CHECKED_AT', count(*) filter (where checked_at is null) from gaps
    union all select 'NULL_DATASET_ID', count(*) filter (where dataset_id is null) from gaps
    union all select 'EMPTY_CHECK', count(*) filter (where total_rows <= 0) from gaps
    union all select 'DUPLICATE', cast(sum(c - 1) as bigint) from (select count(*) as c from gaps group by dataset_id, rule_id, checked_at))
    select * from n where n > 0""",
)
def _problems(i: Inputs):
    return star.raw_problems(_gaps(i)).select("check", "n")


@query(
    "h02_null_counts",
    "with "
    + _GAPS
    + """ select count(*) filter (where rule_id is null) as null_rule_id, count(*) filter (where total_rows is null) as null_total_rows,
    count(*) filter (where checked_at is null) as null_checked_at from gaps""",
)
def _nulls(i: Inputs):
    found = star.raw_problems(_gaps(i))
    return found.agg(
        *[
            F.max(F.when(F.col("check") == f"NULL_{c.upper()}", F.col("n"))).alias(f"null_{c}")
            for c in ("rule_id", "total_rows", "checked_at")
        ]
    )


@query("h03_empty_checks", "with " + _GAPS + " select count(*) as n from gaps where total_rows <= 0")
def _empty(i: Inputs):
    return star.raw_problems(_gaps(i)).where("check = 'EMPTY_CHECK'").select("n")


@query(
    "h04_surplus_duplicates",
    "select cast(sum(c - 1) as bigint) as duplicates from (select count(*) as c from check_results group by dataset_id, rule_id, checked_at)",
)
def _surplus(i: Inputs):
    return star.surplus_duplicates(i.check_results)


@query(
    "h05_to_utc",
    """select id, case when length(details) > 10 then null else checked_at end as moment from check_results""",
)
def _utc(i: Inputs):
    text = F.when(F.length("details") > 10, F.concat(F.lit("bad "), "details")).otherwise(F.col("checked_at").cast("string"))
    return i.check_results.select("id", star.to_utc(text).cast("timestamp_ntz").alias("moment"))


@query("h06_dim_datasets", STAR + " select * from dim_datasets")
def _dim_datasets(i: Inputs):
    return star.build_dim_datasets(met(i))


@query("h07_dim_rules", STAR + " select * from dim_rules")
def _dim_rules(i: Inputs):
    return star.build_dim_rules(met(i))


@query("h08_dim_date", STAR + " select * from dim_date")
def _dim_date(i: Inputs):
    return star.build_dim_date(met(i))


@query("h09_fact_scores", f"select id, {_SCORE} as score from check_results")
def _scores(i: Inputs):
    return star.build_facts(i.check_results, dedupe=False).select("id", "score")


@query("h10_date_keys", "with " + _GAPS + f" select id, {_DATE_KEY} as date_key from gaps")
def _date_keys(i: Inputs):
    return star.build_facts(_gaps(i), dedupe=False).select("id", "date_key")


@query("h11_facts", STAR + " select * from facts")
def _facts_query(i: Inputs):
    return built(i).facts


@query(
    "h12_date_key_problems",
    "with "
    + EXTRACT
    + ","
    + _GAPS
    + ","
    + _facts("facts", "gaps")
    + """, known as (select distinct cast(year(checked_at) * 10000 + month(checked_at) * 100 + day(checked_at) as int) as k
                     from extract where checked_at < timestamp '2024-01-25')
    select 'INVALID_DATE_KEY' as check, count(*) as n from facts where date_key = 0
    union all select 'ORPHAN_DATE_KEY', count(distinct date_key) from facts where date_key <> 0 and date_key not in (select k from known)""",
)
def _date_problems(i: Inputs):
    early = i.check_results.where("checked_at < timestamp_ntz '2024-01-25'")
    known = star.build_dim_date(extract.dimension_extract(extract.History(early, i.rules, i.datasets)))
    return star.date_key_problems(star.build_facts(_gaps(i)), known).select("check", "n")


@query(
    "h13_schema_contract",
    "select 'check_results' as name, '[''details'', ''id'', ''quality_score_id'']' as extra, count(*) as n from check_results",
)
def _contract(i: Inputs):
    df = i.check_results
    wanted = [c for c in df.columns if c not in ("id", "details", "quality_score_id")]
    note = star.check_schema(df, wanted, "check_results")[0]
    return df.agg(F.lit("check_results").alias("name"), F.lit(note.split(": ", 2)[2]).alias("extra"), F.count(F.lit(1)).alias("n"))


@query(
    "h14_transform_warnings",
    STAR
    + """ select 'EMPTY_CHECK' as check, count(*) as n from extract where total_rows <= 0 having count(*) > 0
    union all select 'DUPLICATE', (select count(*) from extract) - (select count(*) from facts)
    union all select 'INVALID_DATE_KEY', count(*) from facts where date_key = 0 having count(*) > 0""",
)
def _warnings(i: Inputs):
    return star.transform(raw(i)).warnings.select("check", "n")


# --- I: load (the tables that result) --------------------------------------

# A table loaded up to the 20th, then a batch from the 18th on with renamed dimensions.
_SPLIT = (
    STAR
    + """,
old_facts as (select * from facts where checked_at < timestamp '2024-01-20 00:00:00'),
batch as (select * from facts where checked_at >= timestamp '2024-01-18 00:00:00')"""
)


def _old(i: Inputs):
    return built(i).facts.where("checked_at < timestamp_ntz '2024-01-20'")


def _batch(i: Inputs):
    return built(i).facts.where("checked_at >= timestamp_ntz '2024-01-18'")


@query(
    "i01_upsert_datasets",
    STAR
    + """ select id, upper(name) as name, file_type, row_count + 1 as row_count, column_count, status, uploaded_at from dim_datasets where status <> 'ERROR'
    union all select * from dim_datasets where status = 'ERROR'""",
)
def _upsert_datasets(i: Inputs):
    target = once(i, built(i).dim_datasets)
    source = target.where("status <> 'ERROR'").withColumn("name", F.upper("name")).withColumn("row_count", F.col("row_count") + 1)
    return load.upsert(target, source)


@query(
    "i02_upsert_rules",
    STAR
    + """ select id, name, field_name, rule_type, 'LOW' as severity, dataset_type, is_active from dim_rules where rule_type = 'RANGE'
    union all select * from dim_rules where rule_type <> 'RANGE'""",
)
def _upsert_rules(i: Inputs):
    target = once(i, built(i).dim_rules)
    return load.upsert(target, target.where("rule_type = 'RANGE'").withColumn("severity", F.lit("LOW")))


@query("i03_insert_dates", STAR + " select * from dim_date where full_date > date '2024-01-20'")
def _insert_dates(i: Inputs):
    dates = once(i, built(i).dim_date)
    return load.insert_ignore(dates.where("full_date <= date '2024-01-20'"), dates, ["date_key"])


@query("i04_append_facts", _SPLIT + " select * exclude (id) from old_facts union all select * exclude (id) from batch")
def _append(i: Inputs):
    columns = star.FACT_COLUMNS
    return _old(i).select(*columns).unionByName(_batch(i).select(*columns))


@query(
    "i05_dedupe_facts",
    "with "
    + EXTRACT
    + ","
    + _facts("facts", "extract", "id")
    + " select * from facts",
)
def _dedupe(i: Inputs):
    return load.dedupe_facts(star.build_facts(raw(i), dedupe=False))


@query(
    "i05_append_then_dedupe",
    "with "
    + EXTRACT
    + ","
    + _facts("facts", "extract", "id")
    + " select * exclude (id) from facts",
)
def _append_dedupe(i: Inputs):
    """Even ids come first, then the odd ones and, again, the even ones with another score."""
    facts = star.build_facts(raw(i), dedupe=False)
    store = load.StarStore(i.spark, scratch_dir(i.spark, "dedupe"))
    oldest = load.dedupe_facts(facts)
    store.append_then_dedupe(oldest.where("id % 2 = 0"))
    late = facts.withColumn("score", F.lit(-1.0)).withColumn("id", F.col("id") + 1_000_000_000)
    store.append_then_dedupe(oldest.where("id % 2 <> 0").unionByName(late))
    return store.read("fact_quality_checks").select(*star.FACT_COLUMNS)


@query(
    "i06_new_facts",
    _SPLIT + " select * from batch b where not exists (select 1 from old_facts o where o.dataset_id = b.dataset_id and o.rule_id = b.rule_id and o.checked_at = b.checked_at)",
)
def _new(i: Inputs):
    return load.new_facts(_old(i), _batch(i))


@query(
    "i09_daily_aggregate",
    STAR
    + """ select f.date_key, f.dataset_id, count(*) as total_checks, count(*) filter (where passed) as passed_checks,
    count(*) filter (where not passed) as failed_checks, round(sum(cast(round(score * 100) as bigint)) / 100.0 / count(*), 6) as avg_score,
    min(score) as min_score, max(score) as max_score,
    count(*) filter (where not passed and severity = 'HIGH') as high_severity_failures,
    count(*) filter (where not passed and severity = 'MEDIUM') as medium_severity_failures,
    count(*) filter (where not passed and severity = 'LOW') as low_severity_failures
    from facts f left join dim_rules u on u.id = f.rule_id group by 1, 2""",
)
def _daily(i: Inputs):
    tables = built(i)
    return load.daily_aggregate(tables.facts, tables.dim_rules).withColumn("avg_score", F.round("avg_score", 6))


# --- J: integrity ----------------------------------------------------------


@query(
    "j01_row_counts",
    STAR
    + """ select (select count(*) from check_results) as source, (select count(*) from facts) as target,
    (select count(*) from facts) - (select count(*) from check_results) as delta""",
)
def _row_counts(i: Inputs):
    return integrity.row_counts(i.check_results, stored(i).star().facts)


@query(
    "j02_orphans",
    RAW_STAR
    + """ select 'dataset' as entity, count(*) as orphans from facts where dataset_id not in (select id from dim_datasets)
    union all select 'rule', count(*) from facts where rule_id not in (select id from dim_rules)
    union all select 'date', count(*) from facts where date_key not in (select date_key from dim_date)""",
)
def _orphans(i: Inputs):
    return integrity.orphans(raw_star(i))


@query("j03_score_range", RAW_STAR + " select count(*) as invalid_scores from facts where score < 80 or score > 99.5")
def _score_range(i: Inputs):
    return integrity.score_range(raw_star(i).facts, 80, 99.5)


@query(
    "j04_duplicate_groups",
    RAW_STAR + " select count(*) as duplicate_groups from (select 1 from facts group by dataset_id, rule_id, checked_at having count(*) > 1)",
)
def _groups(i: Inputs):
    return integrity.duplicate_groups(raw_star(i).facts)


@query(
    "j05_duplicate_rows",
    RAW_STAR + " select count(*) - count(distinct (dataset_id, rule_id, checked_at)) as duplicate_rows from facts",
)
def _rows(i: Inputs):
    return integrity.duplicate_rows(raw_star(i).facts)


@query(
    "j06_summary",
    STAR
    + f""" select count(*) as total_records, count(*) filter (where passed) as passed_count, count(*) filter (where not passed) as failed_count,
    {half_up("count(*) filter (where passed) * 100", "count(*)", 2)} as success_rate,
    {half_up("sum(cents)", "(count(*) * 100)", 2)} as avg_score, round(min(score), 2) as min_score, round(max(score), 2) as max_score
    from (select *, cast(round(score * 100) as bigint) as cents from facts)""",
)
def _summary(i: Inputs):
    return integrity.summary_statistics(stored(i).star().facts)


_DATASET_SUMMARY = """ select d.id as dataset_id, d.name as dataset_name, count(*) as total_checks, count(*) filter (where passed) as passed_checks,
    count(*) filter (where not passed) as failed_checks, round(sum(cast(round(score * 100) as bigint)) / 100.0 / count(*), 6) as avg_score,
    min(score) as min_score, max(score) as max_score,
    round_even(cast(count(*) filter (where passed) as double) / count(*) * 100, 2) as pass_rate
    from facts f join dim_datasets d on d.id = f.dataset_id group by 1, 2"""


@query("j07_dataset_summary", STAR + _DATASET_SUMMARY)
def _dataset_summary(i: Inputs):
    return integrity.dataset_summary(stored(i).star()).withColumn("avg_score", F.round("avg_score", 6))


@query("j08_pass_rate", STAR + f" select dataset_id, pass_rate from ({_DATASET_SUMMARY})")
def _pass_rates(i: Inputs):
    return integrity.dataset_summary(stored(i).star()).select("dataset_id", "pass_rate")


_RULE_SUMMARY = """ select u.id as rule_id, u.name as rule_name, u.severity, count(*) as total_checks,
    count(*) filter (where not passed) as failure_count,
    round_even(cast(count(*) filter (where not passed) as double) / count(*) * 100, 2) as failure_rate
    from facts f join dim_rules u on u.id = f.rule_id group by 1, 2, 3"""


@query("j09_rule_failures", STAR + _RULE_SUMMARY)
def _rule_failures(i: Inputs):
    return integrity.rule_failure_summary(stored(i).star())


@query("j10_high_failure_rules", STAR + f" select * from ({_RULE_SUMMARY}) where failure_rate > 28")
def _high_failures(i: Inputs):
    return integrity.high_failure_rules(stored(i).star(), 28)


@query(
    "j11_validate",
    RAW_STAR
    + """ select * from (
    select 'ROW_COUNT' as check, 'WARNING' as severity, (select count(*) from extract) <> (select count(*) from facts) as hit
    union all select 'FK_DATASET', 'ERROR', exists (select 1 from facts where dataset_id not in (select id from dim_datasets))
    union all select 'FK_RULE', 'ERROR', exists (select 1 from facts where rule_id not in (select id from dim_rules))
    union all select 'FK_DATE', 'ERROR', exists (select 1 from facts where date_key not in (select date_key from dim_date))
    union all select 'INVALID_SCORE', 'ERROR', exists (select 1 from facts where score < 0 or score > 99)
    union all select 'DUPLICATE_FACTS', 'WARNING', exists (select 1 from facts group by dataset_id, rule_id, checked_at having count(*) > 1)) x
    where hit""",
)
def _validate(i: Inputs):
    found = integrity.validate(raw(i), raw_star(i), 0.0, 99.0)
    return found.select("check", "severity", F.lit(True).alias("hit"))


@query(
    "j11_verdict",
    RAW_STAR
    + """ select count(*) filter (where e) as error_count, count(*) filter (where not e) as warning_count, count(*) filter (where e) = 0 as passed from (
    select true as e where exists (select 1 from facts where dataset_id not in (select id from dim_datasets))
    union all select true where exists (select 1 from facts where rule_id not in (select id from dim_rules))
    union all select true where exists (select 1 from facts where date_key not in (select date_key from dim_date))
    union all select true where exists (select 1 from facts where score < 0 or score > 99)
    union all select false where exists (select 1 from facts group by dataset_id, rule_id, checked_at having count(*) > 1)
    union all select false where (select count(*) from extract) <> (select count(*) from facts))""",
)
def _verdict(i: Inputs):
    return integrity.verdict(integrity.validate(raw(i), raw_star(i), 0.0, 99.0))


@query(
    "j12_guard",
    STAR + " select 'ROW_COUNT' as check, 'WARNING' as severity where (select count(*) from facts) <> (select count(*) from check_results)",
)
def _guard(i: Inputs):
    """A sound star passes the guard with warnings only."""
    return integrity.guarded(integrity.validate(i.check_results, stored(i).star())).where("length(message) > 0").select("check", "severity")


# --- K: analytics ----------------------------------------------------------


def dashboard(name: str, sql: str, head: str = STAR + SELECTED):
    """Register a query over (star, selection)."""

    def register(build):
        query(name, head + sql)(lambda i: build(stored(i).star(), selection(i)))
        return build

    return register


@dashboard(
    "k00_star_filter", " select dataset_id, rule_id, checked_at, score, full_date, day_of_week, rule_type, severity, field_name from sel"
)
def _star_filter(tables, sel):
    return analytics.star_filter(tables, sel).select(
        "dataset_id", "rule_id", "checked_at", "score", "full_date", "day_of_week", "rule_type", "severity", "field_name"
    )


@query("k01_datasets", STAR + " select distinct id, name from dim_datasets")
def _datasets(i: Inputs):
    return analytics.datasets(stored(i).star())


@query("k02_date_range", STAR + " select min(full_date) as min_d, max(full_date) as max_d from dim_date")
def _date_range(i: Inputs):
    return analytics.date_range(stored(i).star())


KPI = """select count(*) as total_checks, count(*) filter (where passed) as passed_checks, round(sum(cents) / 100.0 / count(*), 6) as avg_score,
          min(score) as min_score, max(score) as max_score from sel"""


@dashboard("k03_kpi", KPI)
def _kpi(tables, sel):
    return analytics.kpi_overview(tables, sel).withColumn("avg_score", F.round("avg_score", 6))


@dashboard("k04_daily_average", f"select full_date, {MEAN1} as avg_score from sel group by 1")
def _daily_average(tables, sel):
    return analytics.daily_average(tables, sel)


TRENDS = "select full_date, dataset_name, round(sum(cents) / 100.0 / count(*), 6) as avg_score, count(*) as check_count from sel group by 1, 2"


@dashboard("k05_quality_trends", TRENDS)
def _trends(tables, sel):
    return analytics.quality_trends(tables, sel).withColumn("avg_score", F.round("avg_score", 6))


BY_TYPE = f"select rule_type, count(*) as total, count(*) filter (where not passed) as failed, {RATE1} as failure_rate from sel group by 1"


@dashboard("k06_failure_by_rule_type", BY_TYPE)
def _by_type(tables, sel):
    return analytics.failure_by_rule_type(tables, sel)


@dashboard(
    "k07_failure_by_severity",
    "select severity, count(*) as total, count(*) filter (where not passed) as failed from sel group by 1",
)
def _by_severity(tables, sel):
    return analytics.failure_by_severity(tables, sel)


_COMPARISON = f"""select dataset_name as dataset, {MEAN1} as avg_score, count(*) as total_checks, count(*) filter (where passed) as passed,
    count(*) filter (where not passed) as failed,
    case when count(*) > 1 then round(sqrt(cast(count(*) * sum(cents::hugeint * cents) - sum(cents)::hugeint * sum(cents) as double) / cast(count(*) * (count(*) - 1) as double)) / 100, 2) end as score_std
    from sel group by 1"""


@dashboard("k08_dataset_comparison", _COMPARISON)
def _comparison(tables, sel):
    return analytics.dataset_comparison(tables, sel)


FIELDS = f"""select field_name, rule_type, severity, count(*) as total_checks, count(*) filter (where not passed) as failures, {RATE1} as failure_rate
    from sel where not passed group by 1, 2, 3 order by failures desc, field_name, rule_type, severity limit 10"""


@dashboard("k09_field_issues", FIELDS)
def _fields(tables, sel):
    return analytics.field_issues(tables, sel)


WEEKDAYS = f"select day_of_week, {MEAN1} as avg_score, count(*) as check_count from sel group by 1"


@dashboard("k10_weekdays", WEEKDAYS)
def _weekdays(tables, sel):
    return analytics.quality_by_weekday(tables, sel)


_STATUS = "case when {0} >= 90 then 'Healthy' when {0} >= 70 then 'Warning' else 'Critical' end"


@query("k11_quality_status", STAR + " select dataset_id, rule_id, checked_at, score, " + _STATUS.format("score") + " as status from facts")
def _status(i: Inputs):
    return stored(i).star().facts.select("dataset_id", "rule_id", "checked_at", "score", analytics.quality_status(F.col("score")).alias("status"))


@dashboard(
    "k12_kpi_derived",
    f"""select *, total_checks - passed_checks as failed_checks, round(passed_checks::double / total_checks * 100, 6) as pass_rate,
    round(passed_checks::double / total_checks * 100 - 90, 6) as delta_to_target,
    round((total_checks - passed_checks)::double / total_checks * 100, 6) as failed_share, {_STATUS.format("avg_score")} as status from ({KPI})""",
)
def _kpi_derived(tables, sel):
    df = analytics.kpi_derived(tables, sel)
    for c in ("avg_score", "pass_rate", "delta_to_target", "failed_share"):
        df = df.withColumn(c, F.round(c, 6))
    return df


@dashboard(
    "k13_kpi_long",
    f"""select m as metric, v as value from (select unnest(['Total Checks', 'Passed', 'Failed', 'Pass Rate %', 'Avg Score', 'Min Score', 'Max Score']) as m,
    unnest([total_checks::double, passed_checks::double, (total_checks - passed_checks)::double, round_even(passed_checks::double / total_checks * 100, 1),
            round_even(avg_score, 1), round_even(min_score, 1), round_even(max_score, 1)]) as v from ({KPI}))""",
)
def _kpi_long(tables, sel):
    return analytics.kpi_long(tables, sel)


_CHANGE = f"""select dataset_name, round(case when count(*) < 2 or arg_min(avg_score, full_date) = 0 then 0.0
    else (arg_max(avg_score, full_date) - arg_min(avg_score, full_date)) / arg_min(avg_score, full_date) * 100 end, 4) as trend,
    arg_max(avg_score, full_date) as latest from ({TRENDS}) group by 1"""


@dashboard("k14_trend_change", _CHANGE)
def _change(tables, sel):
    df = analytics.trend_change(tables, sel)
    return df.withColumn("trend", F.round("trend", 4) + 0.0).withColumn("latest", F.round("latest", 6))


@dashboard(
    "k15_trend_labels",
    f"""select *, case when trend > 5 then 'Improving' when trend < -5 then 'Declining' else 'Stable' end as direction,
    latest < 70 as below_critical from ({_CHANGE})""",
)
def _labels(tables, sel):
    df = analytics.trend_labels(tables, sel)
    return df.withColumn("trend", F.round("trend", 4) + 0.0).withColumn("latest", F.round("latest", 6))


@dashboard(
    "k16_failure_bands",
    f"select *, case when failure_rate >= 30 then 'critical' when failure_rate >= 10 then 'warning' else 'healthy' end as band from ({BY_TYPE})",
)
def _bands(tables, sel):
    return analytics.failure_bands(tables, sel)


@dashboard(
    "k16_worst_rule_type",
    f"""select rule_type as worst_rule, failure_rate as max_rate, case when failure_rate > 30 then 'High failure rate'
    when failure_rate > 10 then 'Elevated rate' else 'All rules healthy' end as insight from ({BY_TYPE}) order by failure_rate desc, rule_type limit 1""",
)
def _worst(tables, sel):
    return analytics.worst_rule_type(tables, sel)


@dashboard(
    "k17_severity_view",
    """select severity, count(*) as total, count(*) filter (where not passed) as failed, count(*) filter (where passed) as passed,
    (severity = 'HIGH' and count(*) filter (where not passed) > 0) or (severity = 'MEDIUM' and count(*) filter (where not passed) > 10) as alarm from sel group by 1""",
)
def _severity_view(tables, sel):
    return analytics.severity_view(tables, sel)


@dashboard(
    "k18_comparison_view",
    f"""select *, round_even(passed::double / total_checks * 100, 1) as pass_rate, {_STATUS.format("avg_score")} as quality_status,
    coalesce(score_std > 15, false) as high_spread from ({_COMPARISON})""",
)
def _comparison_view(tables, sel):
    return analytics.comparison_view(tables, sel)


@dashboard(
    "k18_comparison_extremes",
    f"""select (select dataset from c order by avg_score desc, dataset desc limit 1) as best, max(avg_score) as best_score,
    (select dataset from c order by avg_score, dataset limit 1) as worst, min(avg_score) as worst_score from c""",
    head=STAR + SELECTED + f", c as ({_COMPARISON})",
)
def _extremes(tables, sel):
    return analytics.comparison_extremes(tables, sel)


_DAY = "case day_of_week when 0 then 'Mon' when 1 then 'Tue' when 2 then 'Wed' when 3 then 'Thu' when 4 then 'Fri' when 5 then 'Sat' else 'Sun' end"


@dashboard("k19_weekday_view", f"select *, {_DAY} as day_name, {_STATUS.format('avg_score')} as status from ({WEEKDAYS})")
def _weekday_view(tables, sel):
    return analytics.weekday_view(tables, sel)


@dashboard(
    "k19_weekday_extremes",
    f"""select (select {_DAY} from w order by avg_score desc, day_of_week limit 1) as best_day, max(avg_score) as best_score,
    (select {_DAY} from w order by avg_score, day_of_week limit 1) as worst_day, min(avg_score) as worst_score,
    round(stddev_samp(avg_score), 6) as spread, stddev_samp(avg_score) > 5 as high_spread from w""",
    head=STAR + SELECTED + f", w as ({WEEKDAYS})",
)
def _weekday_extremes(tables, sel):
    return analytics.weekday_extremes(tables, sel).withColumn("spread", F.round("spread", 6))


@dashboard(
    "k20_field_hierarchy",
    f"""select field_name, rule_type, cast(sum(failures) as bigint) as failures, cast(grouping(field_name) * 2 + grouping(rule_type) as int) as level
    from ({FIELDS}) group by rollup (field_name, rule_type)""",
)
def _hierarchy(tables, sel):
    return analytics.field_hierarchy(tables, sel)


@dashboard(
    "k20_top_field",
    f"select field_name, failures, failure_rate, severity = 'HIGH' as is_high from ({FIELDS}) order by failures desc, field_name, rule_type, severity limit 1",
)
def _top_field(tables, sel):
    return analytics.top_field_alarm(tables, sel)


@query(
    "k04_from_daily_aggregate",
    STAR + f" select full_date, {MEAN1} as avg_score from (select d.full_date, cast(round(f.score * 100) as bigint) as cents from facts f join dim_date d using (date_key)) group by 1",
)
def _from_daily(i: Inputs):
    store = stored(i)
    return analytics.daily_average_from_aggregate(store.read("agg_daily_quality"), store.read("dim_date"))
