"""Check history derived from the benchmark tables.

The texts below are plain SQL, so the comparison engine can run them unchanged.
Every table is derived from whole inputs and grows with them:

* ``datasets``: one per customer, five of them sharing names through their segment;
* ``rules``: one per part, all types, severities, scopes and parameter shapes;
* ``check_results``: one per event; the results of two of the five event types all
  belong to dataset 7, so that one dataset holds two fifths of the rows;
* ``quality_scores``: one per dataset and day, ``alert_configs`` per dataset outside
  one segment, ``audit_logs`` one per score.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from truegauge.operators.extract import History

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

USERS = """
select n_nationkey as id, lower(n_name) || '@example.com' as email,
       case when n_regionkey = 0 then null else n_name end as full_name,
       case when n_regionkey = 1 then 'ADMIN' else 'USER' end as role
from nation
"""

DATASETS = """
select c_custkey as id,
       case when c_acctbal < 0 then lower(c_mktsegment) || ' feed' else c_name end as name,
       case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then 'json' else 'csv' end as file_type,
       cast(floor(abs(c_acctbal)) as bigint) as row_count,
       5 + c_nationkey % 8 as column_count,
       case when c_mktsegment = 'MACHINERY' then null else c_nationkey end as uploaded_by,
       case when c_acctbal < 0 then 'ERROR'
            when c_acctbal < 1000 then 'PROCESSING'
            when c_acctbal < 4000 then 'PENDING'
            else 'VALIDATED' end as status,
       cast(date '2023-11-01' + cast(c_nationkey as int) as timestamp) as uploaded_at,
       case when c_mktsegment = 'BUILDING' then '["id", "' || lower(c_name) || '"]'
            when c_mktsegment = 'FURNITURE' then '[''id'', ''name'']'
            when c_mktsegment = 'MACHINERY' then 'id, name , ,age'
            when c_mktsegment = 'HOUSEHOLD' then null
            else '["id"]' end as column_names
from customer
"""

RULES = """
select p_partkey as id, p_name as name, p_brand as field_name,
       case p_size % 5 when 0 then 'NOT_NULL' when 1 then 'DATA_TYPE'
                       when 2 then 'RANGE' when 3 then 'UNIQUE' else 'REGEX' end as rule_type,
       case p_partkey % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as severity,
       case p_partkey % 4 when 0 then 'all' when 1 then 'csv'
                          when 2 then 'json' else '' end as dataset_type,
       p_size % 6 <> 5 as is_active,
       case p_size % 5 when 0 then '' when 1 then '{"expected_type": "numeric"}'
                       when 2 then '{"min": 1, "max": ' || cast(p_size as varchar(10)) || '.5}'
                       when 3 then '{}' else '{"pattern": "^[A-Z]+#"}' end as parameters
from part
"""

CHECK_RESULTS = """
select id, dataset_id, rule_id, failed_rows = 0 as passed, failed_rows, total_rows, checked_at,
       case when event_type = 'click' then failed_rows || ' values found'
            when event_type = 'view' then '{"message": "' || failed_rows || ' rows", "samples": [{"id": ' || id || ', "v": NaN}]}'
            when event_type = 'error' then ''
            else '{"message": "' || failed_rows || ' rows", "samples": [{"id": ' || id || '}, {"id": null}]}' end as details,
       case when event_type = 'signup' then null else dataset_id * 100 + day(checked_at) end as quality_score_id
from (
  select event_id as id, event_type,
         case when event_type in ('view', 'error') then 7 else user_id end as dataset_id,
         case when k >= 97 then -k else k end as rule_id,
         cast(total_rows as bigint) as total_rows,
         cast(case when total_rows > 0 and event_id % 4 = 0
                   then cast(floor(value) as int) % 60 else 0 end as bigint) as failed_rows,
         checked_at
  from (
    select event_id, event_type, user_id, value,
           cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
           case when value < 1 then 0 else 200 + 100 * (event_id % 7) end as total_rows,
           date_trunc('hour', ts) as checked_at
    from events
  ) raw
) e
"""

QUALITY_SCORES = """
select dataset_id * 100 + day(checked_at) as id, dataset_id,
       case when max(total_rows) = 0 then null
            else cast(sum(case when passed then 1 else 0 end) as double) * 100 / count(*) end as score,
       count(*) as total_rules,
       cast(sum(case when passed then 1 else 0 end) as bigint) as passed_rules,
       cast(sum(case when passed then 0 else 1 end) as bigint) as failed_rules,
       max(checked_at) as checked_at
from check_results
group by dataset_id, day(checked_at)
"""

ALERT_CONFIGS = """
select id as dataset_id, 50 + 10 * (column_count % 5) as threshold, true as email_notifications
from datasets where column_names is not null
"""

AUDIT_LOGS = """
select id, dataset_id,
       case when failed_rules = 0 then 'system' else 'user' || cast(dataset_id % 25 as varchar(10)) || '@example.com' end as triggered_by,
       case when failed_rules = 0 then 'scheduled' else 'manual' end as trigger_type,
       coalesce(score, 0.0) as score, checked_at as timestamp
from quality_scores
"""

VIEWS = {
    "users": USERS,
    "datasets": DATASETS,
    "rules": RULES,
    "check_results": CHECK_RESULTS,
    "quality_scores": QUALITY_SCORES,
    "alert_configs": ALERT_CONFIGS,
    "audit_logs": AUDIT_LOGS,
}
_READS = {
    "users": ["nation"],
    "datasets": ["customer"],
    "rules": ["part"],
    "check_results": ["events"],
    "quality_scores": ["check_results"],
    "alert_configs": ["datasets"],
    "audit_logs": ["quality_scores"],
}


class Inputs:
    """Base tables and derived history of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._build(name)
        return self._tables[name]

    def _build(self, name: str) -> DataFrame:
        if name in VIEWS:
            sources = {t: self.table(t) for t in _READS[name]}
            text = VIEWS[name]
            for t in sources:
                text = text.replace(f"from {t}", f"from {{{t}}}")
            if name == "rules" or name == "check_results":
                text = _escape_braces(text, sources)
            df = self.spark.sql(text, **sources)
            # Stored timestamps are zoneless; date functions return them with a zone.
            for column, dtype in df.dtypes:
                if dtype == "timestamp":
                    df = df.withColumn(column, df[column].cast("timestamp_ntz"))
            return df
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*TABLES, *VIEWS):
            raise AttributeError(name)
        return self.table(name)

    @property
    def history(self) -> History:
        return History(self.check_results, self.rules, self.datasets)


def _escape_braces(text: str, sources: dict) -> str:
    """Braces of JSON literals doubled; those naming a source table kept."""
    doubled = text.replace("{", "{{").replace("}", "}}")
    for t in sources:
        doubled = doubled.replace("{{" + t + "}}", "{" + t + "}")
    return doubled


def with_views(sql: str) -> str:
    """Comparison SQL with the derived tables it names as leading WITH entries."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for source in _READS.get(name, []):
            visit(source)
        if name in VIEWS and name not in needed:
            needed.append(name)

    words = set(re.findall(r"[a-z_]+", sql))
    for name in VIEWS:
        if name in words:
            visit(name)
    if not needed:
        return sql
    heads = ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {heads},\n{body[5:]}"
    return f"with {heads}\n{body}"
