"""Reports, rollups and alerts (groups E, F and L)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from truegauge.functions import paging
from truegauge.functions.bands import score_band
from truegauge.functions.timing import days_back
from truegauge.operators import alerts, reports, rollups
from truegauge.plans.history import Inputs
from truegauge.plans.registry import query

LATEST = """
latest as (select * from quality_scores qualify row_number() over (partition by dataset_id order by checked_at desc, id desc) = 1)"""

VIEW = """
shown as (
  select id, dataset_id, rule_id, passed, failed_rows as fail_count, total_rows - failed_rows as pass_count,
         case when details like '{%' then json_extract_string(replace(details, 'NaN', 'null'), '$.message') else details end as message,
         case when details like '{%' then cast(json_extract(replace(details, 'NaN', 'null'), '$.samples') as json[]) else [] end as samples,
         checked_at
  from check_results)"""

# --- E ---------------------------------------------------------------------


@query("e01_results_of_dataset", "select * from check_results where dataset_id = 7 order by checked_at desc, id desc")
def _results(i: Inputs):
    return reports.check_results_for(i.check_results, 7)


@query(
    "e02_result_view",
    "with " + VIEW + """ select id, dataset_id, rule_id, passed, fail_count, pass_count, message,
    len(samples) as n_samples, replace(cast(samples[1] as varchar), ' ', '') as first_sample, checked_at from shown""",
)
def _view(i: Inputs):
    shown = reports.result_view(i.check_results)
    return shown.select(
        *[c for c in shown.columns if c != "samples"],
        F.size("samples").cast("long").alias("n_samples"),
        F.replace(F.get("samples", F.lit(0)), F.lit(" "), F.lit("")).alias("first_sample"),
    )


@query("e03_latest_report", "select * from quality_scores where dataset_id = 7 order by checked_at desc, id desc limit 1")
def _latest_report(i: Inputs):
    return reports.latest_report(i.quality_scores, 7)


@query("e03_latest_scores", "with " + LATEST + " select * from latest")
def _latest(i: Inputs):
    return reports.latest_scores(i.quality_scores)


@query(
    "e04_report_by_id",
    """select s.*, d.name as dataset_name, d.uploaded_by from quality_scores s join datasets d on d.id = s.dataset_id where s.id = 712""",
)
def _by_id(i: Inputs):
    return reports.report_by_id(i.quality_scores, i.datasets, 712)


_RESULTS_OF = """
linked as (select s.id as report_id, r.id from newest s join check_results r on r.quality_score_id = s.id),
near as (
  select s.id as report_id, r.id from newest s join check_results r on r.dataset_id = s.dataset_id
  and r.checked_at between s.checked_at - interval 5 second and s.checked_at + interval 5 second
  where s.id not in (select quality_score_id from check_results where quality_score_id is not null)),
own as (select * from linked union all select * from near)"""


@query(
    "e05_dataset_reports",
    "with " + LATEST + ", newest as (select * from latest)," + _RESULTS_OF + "," + VIEW + """
    select s.id as report_id, s.dataset_id, s.score, s.total_rules, s.checked_at as report_at, d.name as dataset_name,
           v.id as result_id, v.rule_id, v.pass_count, v.message
    from newest s join datasets d on d.id = s.dataset_id left join own o on o.report_id = s.id left join shown v on v.id = o.id""",
)
def _reports(i: Inputs):
    full = reports.dataset_reports(i.quality_scores, i.datasets, i.check_results)
    return full.select(
        "report_id", "dataset_id", "score", "total_rules", "report_at", "dataset_name", "result_id", "rule_id", "pass_count", "message"
    )


@query(
    "e06_results_near_score",
    "with newest as (select * from quality_scores)," + _RESULTS_OF + " select report_id, id from own",
)
def _near(i: Inputs):
    return reports.score_results(i.quality_scores, i.check_results).select("report_id", "id")


@query(
    "e07_trends",
    "select * from quality_scores where dataset_id = 7 and cast(checked_at as date) between date '2024-01-05' and date '2024-01-20'",
)
def _trends(i: Inputs):
    return reports.trends(i.quality_scores, 7, "2024-01-05", "2024-01-20")


@query(
    "e08_bulk_trends",
    """select * from quality_scores where dataset_id in (select id from datasets where file_type = 'json')
       and cast(checked_at as date) >= date '2024-01-10'""",
)
def _bulk(i: Inputs):
    return reports.bulk_trends(i.quality_scores, i.datasets.where("file_type = 'json'"), "2024-01-10")


@query(
    "e09_missing_ids",
    "select distinct o_custkey as id from orders where o_custkey not in (select id from datasets where uploaded_by = 3)",
)
def _missing(i: Inputs):
    return reports.missing_ids(i.orders.selectExpr("o_custkey as id"), reports.visible(i.datasets, 3))


@query(
    "e10_dashboard",
    "with " + LATEST + """ select d.id as dataset_id, s.id as score_id, s.score, s.total_rules, s.passed_rules, s.failed_rules, s.checked_at
    from datasets d left join latest s on s.dataset_id = d.id""",
)
def _dashboard(i: Inputs):
    return reports.dashboard_summary(i.datasets, i.quality_scores)


@query("e11_visible", "select * from datasets where uploaded_by = 3")
def _visible(i: Inputs):
    return reports.visible(i.datasets, 3)


@query("e12_list_datasets", "select * from datasets where uploaded_by = 5 order by uploaded_at desc, id")
def _list(i: Inputs):
    return reports.list_datasets(i.datasets, 1, "ADMIN", 5)


@query(
    "e13_audit_log",
    """select a.*, d.name as dataset_name from audit_logs a join datasets d on d.id = a.dataset_id
       where a.timestamp >= timestamp '2024-01-10 08:00:00' and a.timestamp <= timestamp '2024-01-20 12:00:00'""",
)
def _audit(i: Inputs):
    return reports.audit_log(i.audit_logs, i.datasets, None, "2024-01-10 08:00:00", "2024-01-20 12:00:00")


@query("e14_paginate", "select *, (select count(*) from datasets) as total from datasets order by id limit 20 offset 40")
def _paginate(i: Inputs):
    return reports.paginate(i.datasets, 3, 20)


@query("e14_paginate_by_index", "select *, (select count(*) from datasets) as total from datasets order by id limit 20 offset 40")
def _paginate_by_index(i: Inputs):
    """The same page by a jump: only rows between two page starts are read and sorted."""
    index = paging.page_index(i.datasets, ["id"], 20)
    return index.page(i.datasets, 3).withColumn("total", F.lit(index.total).cast("long"))


@query(
    "e14_pages_of_audit",
    "select page, id, \"timestamp\" as at from (select *, (row_number() over (order by \"timestamp\", id) - 1) // 50 + 1 as page from audit_logs) where page in (1, 2, 7)",
)
def _audit_pages(i: Inputs):
    """Pages in the order of time: the first, the one after its last row, and a jump."""
    log, order = i.audit_logs, ["timestamp", "id"]
    first = paging.page_after(log, order, 50)
    last = first.orderBy(F.desc("timestamp"), F.desc("id")).first()
    second = paging.page_after(log, order, 50, [last[c] for c in order])
    jump = paging.page_index(log, order, 50).page(log, 7)
    parts = [df.select(F.lit(n).cast("long").alias("page"), "id", F.col("timestamp").alias("at")) for n, df in ((1, first), (2, second), (7, jump))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NAMES = """case when column_names is null then '' when column_names like '["%' then array_to_string(cast(json(column_names) as varchar[]), '|')
    {other} end"""


@query(
    "e15_parse_columns",
    f"""select id, {_NAMES.format(other="else column_names")} as strict,
    {_NAMES.format(other="when column_names like '[%' then 'id|name' else 'id|name|age'")} as lenient from datasets""",
)
def _columns(i: Inputs):
    return i.datasets.select(
        "id",
        F.array_join(reports.parse_columns(F.col("column_names")), "|").alias("strict"),
        F.array_join(reports.parse_columns(F.col("column_names"), lenient=True), "|").alias("lenient"),
    )


# --- F ---------------------------------------------------------------------

SCORED = LATEST + """,
scored as (select d.*, s.score, s.total_rules, s.checked_at as last_checked from datasets d left join latest s on s.dataset_id = d.id)"""


def _mean(expr: str, count: str) -> str:
    return f"coalesce(cast(floor(sum(cast({expr} as decimal(20,12)))::double / nullif({count}, 0) + 0.5) as bigint), 0)"


def _scored(i: Inputs):
    return rollups.current_scores(i.datasets, i.quality_scores)


@query(
    "f01_daily_trend",
    f"""select cast(checked_at as date) as day, {_mean("coalesce(score, 0)", "count(*)")} as score from quality_scores group by 1 order by day desc limit 7""",
)
def _daily(i: Inputs):
    return rollups.daily_trend(i.quality_scores)


@query("f02_average_score", "with " + SCORED + f" select {_mean('score', 'count(score)')} as avg_score from scored")
def _average(i: Inputs):
    return rollups.average_score(_scored(i))


@query(
    "f03_worst_datasets", "with " + SCORED + " select id, name, score from scored where score is not null order by score, id limit 5"
)
def _worst(i: Inputs):
    return rollups.worst_datasets(_scored(i))


@query(
    "f04_active_users",
    "with " + SCORED + f""" select u.id, u.email, count(s.id) as uploads, {_mean("coalesce(s.score, 0)", "count(s.id)")} as avg_score
    from users u left join scored s on s.uploaded_by = u.id group by 1, 2 order by uploads desc, u.id limit 5""",
)
def _active(i: Inputs):
    return rollups.active_users(i.users, _scored(i))


@query(
    "f05_totals",
    """select (select count(*) from datasets) as total_datasets, (select count(*) from users) as total_users,
       (select count(*) from rules) as total_rules, (select count(*) from audit_logs) as total_activity""",
)
def _totals(i: Inputs):
    return rollups.totals(i.datasets, i.users, i.rules, i.audit_logs)


@query(
    "f06_user_stats",
    "with " + SCORED + f""",
    recent as (select uploaded_by, string_agg(cast(id as varchar), ',' order by rn) as ids from (
      select id, uploaded_by, row_number() over (partition by uploaded_by order by uploaded_at desc, id) as rn from datasets) where rn <= 5 group by 1)
    select u.id, coalesce(u.full_name, split_part(u.email, '@', 1)) as name, u.email, count(s.id) as datasets_count,
           {_mean("s.score", "count(s.score)")} as avg_score, case when count(s.id) > 0 then 'Recently' else 'Never' end as last_active,
           max(r.ids) as recent_uploads
    from users u left join scored s on s.uploaded_by = u.id left join recent r on r.uploaded_by = u.id
    where contains(lower(coalesce(u.full_name, split_part(u.email, '@', 1))), '1') or contains(lower(u.email), '1') group by 1, 2, 3""",
)
def _users(i: Inputs):
    return rollups.user_stats(i.users, _scored(i), "1")


_SEGMENTS = ["automobile feed", "building feed", "furniture feed", "household feed", "machinery feed"]


@query(
    "f07_trend_pivot",
    """with last as (select cast(s.checked_at as date) as day, d.name, coalesce(s.score, 0.0) as score from quality_scores s join datasets d on d.id = s.dataset_id
       qualify row_number() over (partition by cast(s.checked_at as date), d.name order by s.checked_at desc, s.id desc) = 1)
    select day, """
    + ", ".join(f"max(score) filter (where name = '{n}') as \"{n}\"" for n in _SEGMENTS)
    + " from last where name in ("
    + ", ".join(f"'{n}'" for n in _SEGMENTS)
    + ") group by 1",
)
def _pivot(i: Inputs):
    return rollups.trend_pivot(i.quality_scores, i.datasets, _SEGMENTS)


@query(
    "f08_trend_stats",
    f"""select {_mean("coalesce(score, 0)", "count(*)")} as avg, max(coalesce(score, 0)) as best, (select count(*) from audit_logs) as total from quality_scores""",
)
def _stats(i: Inputs):
    return rollups.trend_stats(i.quality_scores, i.audit_logs)


@query("f09_rolling_range", "select * from quality_scores where cast(checked_at as date) >= date '2024-01-24'")
def _rolling(i: Inputs):
    start = days_back(7, date(2024, 1, 30), date(2024, 1, 24))
    return reports.bulk_trends(i.quality_scores, i.datasets, start.isoformat())


@query(
    "f10_user_overview",
    "with " + SCORED + f""" select count(*) as total_datasets, {_mean("score", "count(score)")} as avg_score,
    cast(coalesce(sum(total_rules), 0) as bigint) as rules_defined, max(last_checked) as last_check from scored where uploaded_by = 4""",
)
def _overview(i: Inputs):
    return rollups.user_overview(reports.visible(_scored(i), 4))


@query(
    "f11_report_list",
    """select * from (select s.*, coalesce(d.name, 'Dataset #' || s.dataset_id) as dataset_name,
       case when d.id is null then 'Unknown' else coalesce(u.email, 'System User') end as user_email
       from quality_scores s left join datasets d on d.id = s.dataset_id and d.status <> 'PENDING' left join users u on u.id = d.uploaded_by)
       where contains(lower(dataset_name), '#1') or contains(lower(user_email), 'system')""",
)
def _report_list(i: Inputs):
    return rollups.report_list(i.quality_scores, i.datasets.where("status <> 'PENDING'"), i.users, "#1").unionByName(
        rollups.report_list(i.quality_scores, i.datasets.where("status <> 'PENDING'"), i.users, "SYSTEM").where(
            ~F.lower("dataset_name").contains("#1")
        )
    )


@query(
    "f12_rule_pass_percent",
    "select id, case when total_rows > 0 then cast(floor((total_rows - failed_rows)::double / total_rows * 100 + 0.5) as bigint) else 0 end as pct from check_results",
)
def _pass_percent(i: Inputs):
    passed = F.col("total_rows") - F.col("failed_rows")
    return i.check_results.select("id", rollups.rule_pass_percent(passed, F.col("failed_rows")).alias("pct"))


@query(
    "f13_failed_samples",
    "with " + VIEW + """, flat as (select dataset_id, rule_id, id, coalesce(nullif(message, ''), 'Rule validation failed') as reason,
      replace(cast(unnest(samples) as varchar), ' ', '') as data, unnest(range(len(samples))) as pos from shown where fail_count > 0)
    select f.dataset_id, cast(position as int) as position, u.name as rule_name, reason, data from (
      select *, row_number() over (partition by dataset_id order by id, pos) as position from flat) f
    join rules u on u.id = f.rule_id where position <= 10""",
)
def _failed_samples(i: Inputs):
    found = rollups.failed_samples(reports.result_view(i.check_results), i.rules)
    return found.withColumn("data", F.replace("data", F.lit(" "), F.lit("")))


@query(
    "f14_dataset_grid",
    """select d.id, d.name, coalesce(u.email, 'System User') as user, upper(d.file_type) as type, cast(d.uploaded_at as date) as date, d.status
       from datasets d left join users u on u.id = d.uploaded_by
       where (contains(lower(d.name), 'feed') or contains(lower(coalesce(u.email, 'System User')), 'feed') or contains(lower(d.name), '#'))
         and contains(lower(d.name) || lower(coalesce(u.email, 'System User')), '1') and upper(d.file_type) = 'CSV'
         and d.status not in ('PENDING', 'PROCESSING', 'ERROR')""",
)
def _grid(i: Inputs):
    grid = rollups.dataset_grid(i.datasets, i.users, "", "all", "CSV", "checked")
    return grid.where(
        F.concat(F.lower("name"), F.lower("user")).contains("1") & (F.col("name").contains("feed") | F.col("name").contains("#"))
    )


@query("f14_dataset_types", "select distinct upper(file_type) as type from datasets")
def _types(i: Inputs):
    return rollups.dataset_types(i.datasets)


@query(
    "f15_score_band",
    """select id, case when score is null then 'none' when score >= 80 then 'success' when score >= 50 then 'warning' else 'danger' end as band from quality_scores""",
)
def _band(i: Inputs):
    return i.quality_scores.select("id", score_band(F.col("score")).alias("band"))


@query(
    "f16_rule_share",
    """select id, round(passed_rules::double / greatest(total_rules, 1) * 100, 6) as passed_share,
       round(failed_rules::double / greatest(total_rules, 1) * 100, 6) as failed_share from quality_scores""",
)
def _share(i: Inputs):
    total = F.col("total_rules")
    return i.quality_scores.select(
        "id",
        F.round(rollups.rule_share(F.col("passed_rules"), total), 6).alias("passed_share"),
        F.round(rollups.rule_share(F.col("failed_rules"), total), 6).alias("failed_share"),
    )


# --- L ---------------------------------------------------------------------

# Settings that change: from the 15th the threshold moves and some mails are switched off.
CONFIG_HISTORY = """
select dataset_id, threshold, email_notifications, cast(timestamp '2023-01-01 00:00:00' as timestamp) as effective_from from alert_configs
union all
select dataset_id, 100 - threshold / 2, threshold > 60, cast(timestamp '2024-01-15 00:00:00' as timestamp) from alert_configs
"""

_JUDGED_TEXT = """
settings as (
  select *, row_number() over w as epoch, lead(effective_from) over w as valid_to
  from ({settings})
  window w as (partition by dataset_id order by effective_from)),
judged as (
  select s.id, s.dataset_id, s.score, c.threshold, s.checked_at, c.epoch, s.score < c.threshold as breach, c.email_notifications as mail
  from quality_scores s join settings c on c.dataset_id = s.dataset_id and s.checked_at >= c.effective_from
   and (c.valid_to is null or s.checked_at < c.valid_to)
  where s.score is not null),
runs as (
  select *, sum(case when breach then 0 else 1 end) over (partition by dataset_id, epoch order by checked_at, id) as run from judged),
fired as (
  select *, breach and mail and sum(case when breach and mail then 1 else 0 end) over (partition by dataset_id, epoch, run order by checked_at, id) = 1 as fires
  from runs),
events as (
  select *, not breach and coalesce((select bool_or(f.fires) from fired f where f.dataset_id = fired.dataset_id and f.epoch = fired.epoch and f.run = fired.run - 1), false) as recovers
  from fired)"""

def judged_sql(settings: str) -> str:
    """Alert events of the scores, as (id, ..., fires, recovers), for a history of settings."""
    return _JUDGED_TEXT.replace("{settings}", settings)


JUDGED = judged_sql(
    """select dataset_id, threshold::double as threshold, email_notifications, timestamp '2023-01-01 00:00:00' as effective_from from alert_configs
    union all select dataset_id, 100 - threshold / 2.0, threshold > 60, timestamp '2024-01-15 00:00:00' from alert_configs"""
)


def changing_configs(i: Inputs):
    text = CONFIG_HISTORY.replace("from alert_configs", "from {configs}")
    return (
        i.spark.sql(text, configs=i.alert_configs)
        .withColumn("effective_from", F.col("effective_from").cast("timestamp_ntz"))
        .withColumn("threshold", F.col("threshold").cast("double"))
    )


@query(
    "l01_breaches",
    "select s.id, s.dataset_id, s.score, c.threshold, s.checked_at from quality_scores s join alert_configs c on c.dataset_id = s.dataset_id where s.score < c.threshold",
)
def _breaches(i: Inputs):
    return alerts.breaches(i.quality_scores, i.alert_configs)


@query("l02_alerts", "with " + JUDGED + " select id, dataset_id, score, threshold, checked_at from events where fires")
def _alerts(i: Inputs):
    return alerts.alerts(i.quality_scores, changing_configs(i))


@query("l03_recoveries", "with " + JUDGED + " select id, dataset_id, score, threshold, checked_at from events where recovers")
def _recoveries(i: Inputs):
    return alerts.recoveries(i.quality_scores, changing_configs(i))


@query(
    "l04_set_thresholds",
    """select coalesce(c.dataset_id, n.id) as dataset_id, coalesce(n.t, c.threshold) as threshold,
       coalesce(c.email_notifications, true) as email_notifications, false as is_alert_active
       from alert_configs c full join (select id, cast(column_count * 10 as int) as t from datasets where column_count * 10 <= 100) n on n.id = c.dataset_id""",
)
def _thresholds(i: Inputs):
    changes = i.datasets.selectExpr("id as dataset_id", "cast(column_count * 10 as int) as threshold")
    return alerts.set_thresholds(i.alert_configs, changes)


@query(
    "l04_rejected_thresholds",
    """select id as dataset_id, cast(column_count * 15 - 20 as int) as threshold, 'Threshold must be between 0 and 100.' as reject_reason
       from datasets where column_count * 15 - 20 not between 0 and 100""",
)
def _rejected(i: Inputs):
    return alerts.rejected_thresholds(i.datasets.selectExpr("id as dataset_id", "cast(column_count * 15 - 20 as int) as threshold"))


@query(
    "l05_alert_messages",
    "with " + JUDGED + """ select e.id, e.dataset_id, u.email as recipient, 'Data Quality Alert: ' || d.name as subject
    from events e join datasets d on d.id = e.dataset_id left join users u on u.id = d.uploaded_by where e.fires""",
)
def _messages(i: Inputs):
    raised = alerts.alerts(i.quality_scores, changing_configs(i))
    return alerts.alert_messages(raised, i.datasets, i.users).drop("message")
