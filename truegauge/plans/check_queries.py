"""Rules, checks and scores over the benchmark tables (groups B, C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.functions import paging
from truegauge.functions.keyed import pick_one
from truegauge.operators import checks, rules, scoring
from truegauge.operators.rules import Rule
from truegauge.plans.history import Inputs
from truegauge.plans import check_run
from truegauge.plans.registry import query
from truegauge.session import scratch_dir

# --- B: rule catalogue -----------------------------------------------------

CHANGED_RULES = """
select p_partkey + case when p_type = 'ECONOMY' then 10000000 else 0 end as id,
       upper(p_name) as name,
       case when p_type = 'ECONOMY' then 'LOW' else null end as severity,
       p_brand as field_name, 'REGEX' as rule_type, 'csv' as dataset_type
from part where p_retailprice > 905
"""


@query(
    "b01_rule_validity",
    """select p_partkey as id, p_type as rule_type, coalesce(severity, 'MEDIUM') as severity,
       case when p_type not in ('NOT_NULL','DATA_TYPE','RANGE','UNIQUE','REGEX') then 'Invalid rule_type'
            when coalesce(severity, 'MEDIUM') not in ('HIGH','MEDIUM','LOW') then 'Invalid severity' end as reject_reason
       from (select p_partkey, case when p_size > 25 then 'RANGE' when p_size > 10 then 'UNIQUE' else p_type end as p_type,
                    case when p_size % 3 = 0 then null when p_size % 3 = 1 then 'HIGH' else p_name end as severity from part)""",
)
def _validity(i: Inputs):
    raw = i.part.selectExpr(
        "p_partkey as id",
        "case when p_size > 25 then 'RANGE' when p_size > 10 then 'UNIQUE' else p_type end as rule_type",
        "case when p_size % 3 = 0 then null when p_size % 3 = 1 then 'HIGH' else p_name end as severity",
    )
    return rules.validate_rules(raw)


@query(
    "b02_parse_parameters",
    r"""select id, raw, case kind when 2 then replace(raw, '\d', '\\d') when 3 then null else raw end as parameters
    from (select p_partkey as id, p_size % 4 as kind,
                 case p_size % 4 when 0 then '' when 1 then '{"min": ' || p_size || '}'
                      when 2 then '{"pattern": "^' || p_brand || '\d+$"}' else '{"min": ' || p_name end as raw from part)""",
)
def _parameters(i: Inputs):
    raw = i.part.selectExpr(
        "p_partkey as id",
        r"""case p_size % 4 when 0 then '' when 1 then concat('{"min": ', p_size, '}')
            when 2 then concat('{"pattern": "^', p_brand, r'\d+$"}') else concat('{"min": ', p_name) end as raw""",
    )
    return raw.select("id", "raw", rules.parse_parameters(F.col("raw")).alias("parameters"))


@query(
    "b03_typed_parameters",
    """select id, coalesce(json_extract_string(p, '$.expected_type'), 'str') as expected_type,
       cast(json_extract_string(p, '$.min') as double) as min, cast(json_extract_string(p, '$.max') as double) as max,
       coalesce(json_extract_string(p, '$.pattern'), '') as pattern
       from (select id, case when trim(parameters) = '' then '{}' else parameters end as p from rules)""",
)
def _typed(i: Inputs):
    return i.rules.select("id", rules.typed_parameters(F.col("parameters")).alias("p")).select("id", "p.*")


_APPLICABLE = """
with served as (select distinct lower(file_type) as file_type from datasets),
applicable as (
  select s.file_type, r.id as rule_id, r.severity,
         case r.severity when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end as weight
  from rules r join served s on r.dataset_type = s.file_type or r.dataset_type in ('all', '')
  where r.is_active)
"""


@query("b04_applicable_rules", _APPLICABLE + "select * from applicable")
def _applicable(i: Inputs):
    return rules.applicable_rules(i.datasets, i.rules)


@query(
    "b04_other_file_types",
    _APPLICABLE.replace("lower(file_type) as file_type from datasets", "case when id % 2 = 0 then 'xml' else lower(file_type) end as file_type from datasets")
    + "select * from applicable",
)
def _other_types(i: Inputs):
    """General rules also meet file types that no rule names."""
    other = i.datasets.withColumn("file_type", F.expr("case when id % 2 = 0 then 'XML' else file_type end"))
    return rules.applicable_rules(other, i.rules)


@query(
    "b04_rule_load",
    _APPLICABLE
    + """select d.id as dataset_id, lower(d.file_type) as file_type, coalesce(n, 0) as rules, coalesce(w, 0) as weights
    from datasets d left join (select file_type, count(*) as n, cast(sum(weight) as bigint) as w from applicable group by 1) a
    on a.file_type = lower(d.file_type)""",
)
def _load(i: Inputs):
    return rules.rule_load(i.datasets, i.rules)


@query("b05_list_rules", "select * from rules where is_active and dataset_type = 'csv'")
def _list(i: Inputs):
    return rules.list_rules(i.rules, "csv")


@query(
    "b06_upsert_rules",
    f"""with changes as ({CHANGED_RULES})
    select r.id, case when r.is_active then coalesce(c.name, r.name) else r.name end as name,
           case when r.is_active then coalesce(c.field_name, r.field_name) else r.field_name end as field_name,
           case when r.is_active then coalesce(c.rule_type, r.rule_type) else r.rule_type end as rule_type,
           case when r.is_active then coalesce(c.severity, r.severity) else r.severity end as severity,
           case when r.is_active then coalesce(c.dataset_type, r.dataset_type) else r.dataset_type end as dataset_type,
           r.is_active, r.parameters
    from rules r left join changes c on r.id = c.id
    union all
    select id, name, field_name, rule_type, coalesce(severity, 'MEDIUM'), dataset_type, true, null
    from changes where id not in (select id from rules)""",
)
def _upsert(i: Inputs):
    changes = i.spark.sql(CHANGED_RULES.replace("from part", "from {part}"), part=i.part)
    return rules.upsert_rules(i.rules, changes)


@query(
    "b07_deactivate_rules",
    """select id, name, field_name, rule_type, severity, dataset_type,
       is_active and id not in (select p_partkey from part where p_retailprice > 910) as is_active, parameters from rules""",
)
def _deactivate(i: Inputs):
    gone = i.part.where("p_retailprice > 910").selectExpr("p_partkey as id")
    return rules.deactivate_rules(i.rules, gone)


@query(
    "b08_search_rules",
    """select * from rules where (contains(lower(name), 'ing') or contains(lower(field_name), 'ing'))
       and rule_type = 'RANGE' and severity = 'HIGH'""",
)
def _search(i: Inputs):
    return rules.search_rules(i.rules, "ING", "RANGE", "HIGH")


@query("b09_page", "select * from rules order by id limit 20 offset 40")
def _page(i: Inputs):
    return rules.page(i.rules, 3, 20)


@query("b09_page_by_index", "select * from rules order by id limit 20 offset 40")
def _page_by_index(i: Inputs):
    """The same page between two page starts of an index."""
    return paging.page_index(i.rules, ["id"], 20).page(i.rules, 3)


# --- C: checks -------------------------------------------------------------

# Nulls, blanks and bad text put into the benchmark tables, on both sides alike.
LINES = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_linestatus, l_shipdate,
       case when l_linenumber = 7 then null else l_quantity end as quantity,
       case when l_returnflag = 'R' and l_linenumber = 1 then null else l_returnflag end as flag,
       case when l_linenumber = 2 then 'n/a' when l_linenumber = 3 then null
            when l_linenumber = 4 then ' ' || cast(cast(l_quantity as int) as varchar(10)) || 'e0'
            when l_linenumber = 5 then cast(cast(l_quantity as int) as varchar(10)) || 'd'
            else cast(cast(l_quantity as int) as varchar(10)) end as quantity_text,
       case when l_linenumber = 6 then null else l_linenumber end as line_or_null
from lineitem
"""


def _lines(i: Inputs):
    return i.spark.sql(LINES.replace("from lineitem", "from {lineitem}"), lineitem=i.lineitem)


def _result(rule_id: int, failed: str, details: str, source: str = "lines", passed: str = "failed = 0") -> str:
    """Comparison text of one result row; ``details`` may use failed and total."""
    return (
        f"select cast({rule_id} as bigint) as rule_id, {passed} as passed, failed as failed_rows, "
        f"total as total_rows, {details} as details "
        f"from (select cast({failed} as bigint) as failed, count(*) as total from {source}) r{rule_id}"
    )


def _where(condition: str) -> str:
    return f"count(*) filter (where {condition})"


def _results(*parts: str) -> str:
    return f"with lines as ({LINES})\n" + "\nunion all\n".join(parts)


@query(
    "c01_not_null",
    _results(
        _result(1, _where("quantity is null"), "failed || ' null values found in quantity'"),
        _result(2, _where("l_tax is null"), "'No null values in l_tax'"),
        _result(3, _where("flag is null"), "failed || ' null values found in flag'"),
    ),
)
def _not_null(i: Inputs):
    return checks.run_checks(
        _lines(i), [Rule(1, "quantity", "NOT_NULL"), Rule(2, "l_tax", "NOT_NULL"), Rule(3, "flag", "NOT_NULL")]
    )


@query("c02_type_str", _results(_result(1, "0", "'String type always match'")))
def _type_str(i: Inputs):
    return checks.run_checks(_lines(i), [Rule(1, "flag", "DATA_TYPE")])


_NOT_NUMBER = "quantity_text is null or not regexp_full_match(quantity_text, ' *[0-9]+(e0)?')"


@query(
    "c03_type_numeric",
    _results(
        _result(1, _where(_NOT_NUMBER), "failed || ' non-numeric values found'"),
        _result(2, _where("quantity is null"), "failed || ' non-numeric values found'"),
    ),
)
def _type_numeric(i: Inputs):
    numeric = {"expected_type": "numeric"}
    return checks.run_checks(
        _lines(i),
        [Rule(1, "quantity_text", "DATA_TYPE", parameters=numeric), Rule(2, "quantity", "DATA_TYPE", parameters=numeric)],
    )


_ORDER_DATES = """
select o_orderkey, case when o_orderstatus = 'P' then 'not-a-date' when o_orderpriority = '5-LOW' then null
       when o_orderpriority = '1-URGENT' then cast(cast(o_orderdate as date) as varchar(30)) || 'T10:30:00'
       else cast(cast(o_orderdate as date) as varchar(30)) end as day_text, o_totalprice from orders
"""


@query(
    "c04_type_datetime",
    f"with lines as ({_ORDER_DATES})\n"
    + _result(1, _where("try_cast(day_text as timestamp) is null"), "failed || ' invalid datetime values found'")
    + " union all "
    + _result(2, "0", "'0 invalid datetime values found'"),
)
def _type_datetime(i: Inputs):
    df = i.spark.sql(_ORDER_DATES.replace("from orders", "from {orders}"), orders=i.orders)
    moment = {"expected_type": "datetime"}
    return checks.run_checks(
        df, [Rule(1, "day_text", "DATA_TYPE", parameters=moment), Rule(2, "o_totalprice", "DATA_TYPE", parameters=moment)]
    )


@query(
    "c05_column_types",
    _results(
        _result(1, "0", "'All values in l_linenumber are int'"),
        _result(2, "count(*)", "'Field quantity is not of type int'"),
        _result(3, "count(*)", "'Field line_or_null is not of type int'"),
        _result(4, "0", "'All values in line_or_null are float'"),
        _result(5, "0", "'All values in quantity are Float'"),
        _result(6, "count(*)", "'Field l_linenumber is not of type float'"),
        _result(7, "count(*)", "'Field flag is not of type bool'"),
    ),
)
def _column_types(i: Inputs):
    wanted = [
        (1, "l_linenumber", "int"),
        (2, "quantity", "int"),
        (3, "line_or_null", "int"),
        (4, "line_or_null", "float"),
        (5, "quantity", "Float"),
        (6, "l_linenumber", "float"),
        (7, "flag", "bool"),
    ]
    return checks.run_checks(_lines(i), [Rule(n, f, "DATA_TYPE", parameters={"expected_type": t}) for n, f, t in wanted])


@query("c06_unknown_type", _results(_result(1, "count(*)", "'Field flag is not of type money'")))
def _unknown_type(i: Inputs):
    return checks.run_checks(_lines(i), [Rule(1, "flag", "DATA_TYPE", parameters={"expected_type": "money"})])


@query(
    "c07_range",
    _results(
        _result(
            1,
            _where("quantity is null or quantity < 5 or quantity > 45"),
            "failed || ' values outside range [5, 45] or non-numeric'",
        ),
        _result(2, _where("l_discount > 0.08"), "failed || ' values outside range [None, 0.08] or non-numeric'"),
        _result(3, _where("l_linenumber < 2"), "failed || ' values outside range [2, None] or non-numeric'"),
    ),
)
def _range(i: Inputs):
    return checks.run_checks(
        _lines(i),
        [
            Rule(1, "quantity", "RANGE", parameters={"min": 5, "max": 45}),
            Rule(2, "l_discount", "RANGE", parameters={"max": 0.08}),
            Rule(3, "l_linenumber", "RANGE", parameters={"min": 2}),
        ],
    )


@query(
    "c08_range_on_text",
    _results(
        _result(
            1,
            _where(f"{_NOT_NUMBER} or cast(trim(replace(quantity_text, 'd', '')) as double) > 40"),
            "failed || ' values outside range [None, 40] or non-numeric'",
        ),
        _result(2, "count(*)", "'Field flag is not numeric'"),
    ).replace(
        "cast(trim(replace(quantity_text, 'd', '')) as double)", "try_cast(trim(quantity_text) as double)"
    ),
)
def _range_text(i: Inputs):
    return checks.run_checks(
        _lines(i),
        [Rule(1, "quantity_text", "RANGE", parameters={"max": 40}), Rule(2, "flag", "RANGE", parameters={"min": 0})],
    )


def _duplicates(field: str, keys: str = "") -> str:
    head = f"{keys}, " if keys else ""
    return f"select {head}coalesce(sum(case when n > 1 then n end), 0) as failed, sum(n) as total from (select {head}{field}, count(*) as n from lines group by {head}{field}) g"


@query(
    "c09_unique",
    f"with lines as ({LINES})\n"
    + "\nunion all\n".join(
        f"""select cast({n} as bigint) as rule_id, failed = 0 as passed, cast(failed as bigint) as failed_rows,
        cast(total as bigint) as total_rows, cast(failed as bigint) || ' duplicate values found in {field}' as details
        from ({_duplicates(field)}) d{n}"""
        for n, field in ((1, "l_orderkey"), (2, "flag"), (3, "l_suppkey"))
    ),
)
def _unique(i: Inputs):
    return checks.run_checks(
        _lines(i), [Rule(1, "l_orderkey", "UNIQUE"), Rule(2, "flag", "UNIQUE"), Rule(3, "l_suppkey", "UNIQUE")]
    )


@query(
    "c10_regex",
    _results(
        _result(1, _where("flag is null or flag not in ('A', 'R')"), "failed || ' values do not match pattern [AR]'"),
        _result(
            2,
            _where("not regexp_matches(cast(l_partkey as varchar), '^(?:1|2[0-4])')"),
            "failed || ' values do not match pattern 1|2[0-4]'",
        ),
    ),
)
def _regex(i: Inputs):
    return checks.run_checks(
        _lines(i),
        [
            Rule(1, "flag", "REGEX", parameters={"pattern": "[AR]"}),
            Rule(2, "l_partkey", "REGEX", parameters={"pattern": "1|2[0-4]"}),
        ],
    )


@query(
    "c10_regex_documents",
    f"""with lines as (select text, source from documents)
    {_result(1, _where("not regexp_matches(text, '^(?:[A-Z][a-z]+)')"), "failed || ' values do not match pattern [A-Z][a-z]+'")}
    union all
    {_result(2, _where("not regexp_matches(text, '^(?:(?s:.)*[0-9]{3})')"), "failed || ' values do not match pattern (?s:.)*[0-9]{3}'")}""",
)
def _regex_documents(i: Inputs):
    return checks.run_checks(
        i.documents,
        [
            Rule(1, "text", "REGEX", parameters={"pattern": "[A-Z][a-z]+"}),
            Rule(2, "text", "REGEX", parameters={"pattern": "(?s:.)*[0-9]{3}"}),
        ],
    )


@query(
    "c11_bad_pattern",
    _results(
        _result(1, "count(*)", "'No pattern provided'"),
        _result(
            2, "count(*)", "'Invalid regex pattern: missing ), unterminated subpattern at position 0'"
        ),
    ),
)
def _bad_pattern(i: Inputs):
    return checks.run_checks(
        _lines(i), [Rule(1, "flag", "REGEX"), Rule(2, "flag", "REGEX", parameters={"pattern": "(AR"})]
    )


@query("c12_missing_field", _results(_result(1, "count(*)", "'Field colour not found in dataset'")))
def _missing_field(i: Inputs):
    return checks.run_checks(_lines(i), [Rule(1, "colour", "NOT_NULL")])


@query("c13_unknown_rule_type", _results(_result(1, "0", "'Unknown rule_type: CHECKSUM'", passed="false")))
def _unknown_rule(i: Inputs):
    return checks.run_checks(_lines(i), [Rule(1, "flag", "CHECKSUM")])


EVENT_RULES = [
    Rule(1, "value", "RANGE", "HIGH", {"min": 1, "max": 90}, "value range"),
    Rule(2, "user_id", "UNIQUE", "MEDIUM", {}, "one event per user"),
    Rule(3, "event_type", "REGEX", "LOW", {"pattern": "(view|click|signup|purchase)$"}, "known type"),
]


@query(
    "c14_samples",
    """with bad as (
        select 1 as rule_id, event_id from events where value < 1 or value > 90
        union all select 2, event_id from events where user_id in (select user_id from events group by 1 having count(*) > 1)
        union all select 3, event_id from events where event_type not in ('view', 'click', 'signup', 'purchase'))
    select cast(rule_id as bigint) as rule_id, cast(rn as int) as sample_no, cast(event_id as varchar) as event_id
    from (select *, row_number() over (partition by rule_id order by event_id) as rn from bad) where rn <= 5""",
)
def _samples(i: Inputs):
    picked = checks.samples(i.events, EVENT_RULES, order=["event_id"])
    return picked.select("rule_id", "sample_no", F.get_json_object("sample", "$.event_id").alias("event_id"))


@query(
    "c15_results_with_samples",
    """with bad as (
        select 1 as rule_id, event_id from events where value < 1 or value > 90
        union all select 2, event_id from events where user_id in (select user_id from events group by 1 having count(*) > 1)
        union all select 3, event_id from events where event_type not in ('view', 'click', 'signup', 'purchase')),
    ranked as (select *, row_number() over (partition by rule_id order by event_id) as rn from bad)
    select cast(rule_id as bigint) as rule_id, count(*) as failed_rows, (select count(*) from events) as total_rows,
           count(*) || case rule_id when 1 then ' values outside range [1, 90] or non-numeric' when 2 then ' duplicate values found in user_id'
                       else ' values do not match pattern (view|click|signup|purchase)$' end as details,
           string_agg(cast(event_id as varchar), ',' order by event_id) filter (where rn <= 5) as sample_ids
    from ranked group by rule_id""",
)
def _with_samples(i: Inputs):
    results = checks.results_with_samples(i.events, EVENT_RULES, order=["event_id"])
    ids = F.transform("samples", lambda s: F.get_json_object(s, "$.event_id"))
    return results.select("rule_id", "failed_rows", "total_rows", "details", F.array_join(ids, ",").alias("sample_ids"))


MIXED = [
    Rule(1, "quantity", "NOT_NULL", "HIGH"),
    Rule(2, "quantity", "RANGE", "HIGH", {"min": 1, "max": 45}),
    Rule(3, "l_discount", "RANGE", "MEDIUM", {"max": 0.08}),
    Rule(4, "flag", "REGEX", "LOW", {"pattern": "[AR]"}),
    Rule(5, "l_orderkey", "UNIQUE", "MEDIUM"),
    Rule(6, "l_tax", "DATA_TYPE", "LOW", {"expected_type": "numeric"}),
]
_MIXED_FAILED = {
    1: ("quantity is null", "case when failed = 0 then 'No null values in quantity' else failed || ' null values found in quantity' end"),
    2: ("quantity is null or quantity < 1 or quantity > 45", "failed || ' values outside range [1, 45] or non-numeric'"),
    3: ("l_discount > 0.08", "failed || ' values outside range [None, 0.08] or non-numeric'"),
    4: ("flag is null or flag not in ('A', 'R')", "failed || ' values do not match pattern [AR]'"),
    6: ("l_tax is null", "failed || ' non-numeric values found'"),
}


def _mixed_by(key: str = "") -> str:
    """Counts of the six mixed rules per key (or over all rows)."""
    head, group = (f"{key}, ", f" group by {key}") if key else ("", "")
    parts = [
        f"select {head}cast({n} as bigint) as rule_id, {details} as details, failed, total from "
        f"(select {head}count(*) filter (where {condition}) as failed, count(*) as total from lines{group}) m{n}"
        for n, (condition, details) in _MIXED_FAILED.items()
    ]
    unique = f"select {head}coalesce(sum(case when n > 1 then n end), 0) as failed, sum(n) as total from (select {head}l_orderkey, count(*) as n from lines group by {head}l_orderkey) g{group}"
    parts.append(
        f"select {head}cast(5 as bigint), cast(failed as bigint) || ' duplicate values found in l_orderkey', cast(failed as bigint), cast(total as bigint) from ({unique}) u"
    )
    return "\nunion all\n".join(parts)


@query(
    "c16_run_checks",
    f"with lines as ({LINES}), m as ({_mixed_by()})\n"
    "select rule_id, failed = 0 as passed, failed as failed_rows, total as total_rows, details from m",
)
def _run_all(i: Inputs):
    return checks.run_checks(_lines(i), MIXED)


@query(
    "c17_run_checks_by",
    f"with lines as ({LINES}), m as ({_mixed_by('l_suppkey')})\n"
    "select l_suppkey, rule_id, failed = 0 as passed, failed as failed_rows, total as total_rows, details from m",
)
def _run_by(i: Inputs):
    return checks.run_checks_by(_lines(i), MIXED, ["l_suppkey"])


@query(
    "c17_daily_checks",
    """with keyed as (select user_id, cast(ts as date) as day, value, event_type from events),
    row_wise as (
      select user_id, day, count(*) as total, count(*) filter (where value < 1 or value > 90) as f1,
             count(*) filter (where event_type = 'error') as f3 from keyed group by all),
    uniq as (select user_id, day, cast(coalesce(sum(case when n > 1 then n end), 0) as bigint) as f4, cast(sum(n) as bigint) as total
             from (select user_id, day, event_type, count(*) as n from keyed group by all) group by all)
    select user_id, day, 1::bigint as rule_id, f1 = 0 as passed, f1 as failed_rows, total as total_rows from row_wise
    union all select user_id, day, 3, f3 = 0, f3, total from row_wise
    union all select user_id, day, 4, f4 = 0, f4, total from uniq""",
)
def _daily(i: Inputs):
    df = i.events.withColumn("day", F.to_date("ts"))
    once = Rule(4, "event_type", "UNIQUE", "LOW")
    return checks.run_checks_by(df, [EVENT_RULES[0], EVENT_RULES[2], once], ["user_id", "day"]).drop("details")


@query(
    "c18_violations",
    """select *, cast(1 as bigint) as rule_id from events where value < 1 or value > 90
       union all select *, 2 from events where user_id in (select user_id from events group by 1 having count(*) > 1)
       union all select *, 3 from events where event_type not in ('view', 'click', 'signup', 'purchase')""",
)
def _violations(i: Inputs):
    return checks.violations(i.events, EVENT_RULES)


@query(
    "c18_violations_hot_key",
    f"""with lines as ({LINES})
    select l_orderkey, l_linenumber, cast(1 as bigint) as rule_id from lines
    where coalesce(flag, '?') in (select coalesce(flag, '?') from lines group by 1 having count(*) > 1)""",
)
def _violations_hot(i: Inputs):
    found = checks.violations(_lines(i), [Rule(1, "flag", "UNIQUE")])
    return found.select("l_orderkey", "l_linenumber", "rule_id")


# --- D: scores -------------------------------------------------------------

_LATEST = """
with latest as (
  select * from (select *, row_number() over (partition by dataset_id, rule_id order by checked_at desc, id desc) as rn from check_results) x
  where rn = 1)
"""


def _latest_results(i: Inputs):
    return pick_one(i.check_results, ["dataset_id", "rule_id"], [F.desc("checked_at"), F.desc("id")])


@query(
    "d01_pass_rate",
    """select id, case when total_rows > 0 then round(cast(total_rows - failed_rows as double) / total_rows, 9)
       when passed then 1.0 else 0.0 end as rate from check_results""",
)
def _pass_rate(i: Inputs):
    rate = scoring.pass_rate(F.col("failed_rows"), F.col("total_rows"), F.col("passed"))
    return i.check_results.select("id", F.round(rate, 9).alias("rate"))


@query(
    "d02_severity_weight",
    """select id, case severity when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 1 end as weight
       from (select id, case when rule_type = 'UNIQUE' then 'URGENT' else severity end as severity from rules)""",
)
def _weights(i: Inputs):
    severity = F.when(F.col("rule_type") == "UNIQUE", "URGENT").otherwise(F.col("severity"))
    return i.rules.select("id", rules.severity_weight(severity).alias("weight"))


_DATASET_SCORES = (
    _LATEST
    + ", "
    + _APPLICABLE.strip()[5:]
    + """,
load as (select file_type, count(*) as n, sum(weight) as w from applicable group by 1),
earned as (
  select l.dataset_id, d.file_type,
         sum(cast(a.weight * (case when l.total_rows > 0 then cast(l.total_rows - l.failed_rows as double) / l.total_rows
                              when l.passed then 1.0 else 0.0 end) as decimal(20,12))) as points,
         count(*) filter (where l.passed) as ok
  from latest l join datasets d on d.id = l.dataset_id join applicable a on a.rule_id = l.rule_id and a.file_type = d.file_type
  group by 1, 2),
scored as (
  select d.id as dataset_id, coalesce(n, 0) as total_rules, coalesce(ok, 0) as passed_rules,
         coalesce(n, 0) - coalesce(ok, 0) as failed_rules,
         case when coalesce(n, 0) = 0 then 100.0
              else round_even(cast(coalesce(points, 0) as double) / cast(w as double) * 100, 2) end as score
  from datasets d left join load on load.file_type = d.file_type left join earned e on e.dataset_id = d.id)
"""
)


@query("d03_quality_score", _DATASET_SCORES + "select * from scored")
def _quality_score(i: Inputs):
    return scoring.quality_score(i.datasets, i.rules, _latest_results(i))


def _flagship(i: Inputs):
    lines = i.lineitem
    six = [
        Rule(1, "l_shipdate", "NOT_NULL", "HIGH"),
        Rule(2, "l_quantity", "RANGE", "HIGH", {"min": 1, "max": 45}),
        Rule(3, "l_discount", "RANGE", "MEDIUM", {"max": 0.08}),
        Rule(4, "l_returnflag", "REGEX", "LOW", {"pattern": "[AR]"}),
        Rule(5, "l_orderkey", "UNIQUE", "MEDIUM"),
        Rule(6, "l_tax", "DATA_TYPE", "LOW", {"expected_type": "numeric"}),
    ]
    results = checks.run_checks_by(lines, six, ["l_linestatus"])
    return scoring.score_results(results, six, ["l_linestatus"])


query(
    "d03_flagship_scores",
    """with u as (select l_linestatus, sum(case when n > 1 then n else 0 end) as f5
                  from (select l_linestatus, l_orderkey, count(*) as n from lineitem group by 1, 2) group by 1),
    a as (select l_linestatus, count(*) as t, count(*) filter (where l_shipdate is null) as f1,
                 count(*) filter (where l_quantity < 1 or l_quantity > 45) as f2,
                 count(*) filter (where l_discount > 0.08) as f3,
                 count(*) filter (where l_returnflag not in ('A', 'R')) as f4,
                 count(*) filter (where l_tax is null) as f6 from lineitem group by 1),
    p as (select l_linestatus, (f1 = 0)::int + (f2 = 0)::int + (f3 = 0)::int + (f4 = 0)::int + (f5 = 0)::int + (f6 = 0)::int as ok,
                 (3 * (t - f1) + 3 * (t - f2) + 2 * (t - f3) + (t - f4) + 2 * (t - f5) + (t - f6))::double / t as points
          from a join u using (l_linestatus))
    select l_linestatus, round_even(points / 12 * 100, 2) as score, 6::bigint as total_rules, ok::bigint as passed_rules,
           (6 - ok)::bigint as failed_rules from p""",
)(_flagship)


# Rules as a table, with their parameters as stored JSON.
_RULE_ROWS = """select * from (values
    (1, 'total', 'o_totalprice', 'RANGE', 'HIGH', 'all', '{"min": 1000, "max": 200000}', true),
    (2, 'status', 'o_orderstatus', 'REGEX', 'MEDIUM', 'csv', '{"pattern": "^[FO]$"}', true),
    (3, 'number', 'o_orderkey', 'UNIQUE', 'LOW', '', '', true),
    (4, 'priority', 'o_orderpriority', 'NOT_NULL', 'MEDIUM', 'json', null, true),
    (5, 'unused', 'o_totalprice', 'RANGE', 'HIGH', 'all', '{"max": 0}', false))
    as r(id, name, field_name, rule_type, severity, dataset_type, parameters, is_active)"""


@query(
    "d09_check_run",
    """with own as (
      select o.*, d.id as dataset_id, d.file_type, d.status from orders o join datasets d on d.id = o.o_custkey % 25 where d.status not in ('PROCESSING', 'ERROR')),
    repeated as (select dataset_id, cast(sum(case when n > 1 then n else 0 end) as bigint) as f3
                 from (select dataset_id, o_orderkey, count(*) as n from own group by all) group by 1),
    a as (select dataset_id, file_type, count(*) as t, count(*) filter (where o_totalprice < 1000 or o_totalprice > 200000) as f1,
                 count(*) filter (where o_orderstatus not in ('F', 'O')) as f2, count(*) filter (where o_orderpriority is null) as f4
          from own group by all),
    m as (select *, case when file_type = 'csv' then f2 else f4 end as other from a join repeated using (dataset_id)),
    s as (select dataset_id, round_even((3 * (t - f1) + 2 * (t - other) + (t - f3))::double / t / 6 * 100, 2) as score, 3::bigint as total_rules,
                 ((f1 = 0)::int + (other = 0)::int + (f3 = 0)::int)::bigint as passed_rules, f1, other, f3 from m)
    select s.dataset_id, score, total_rules, passed_rules, 3 - passed_rules as failed_rules, f1 + other + f3 as failing,
           case when passed_rules = 3 then 'VALIDATED' else 'FAILED' end as status, score < threshold as alerted, 1::bigint as audited
    from s join alert_configs c using (dataset_id)""",
)
def _check_run(i: Inputs):
    """All datasets of the orders in one run; its tables are appended and read back."""
    rows = i.orders.withColumn("dataset_id", (F.col("o_custkey") % 25).cast("int"))
    when = F.lit("2024-02-01 00:00:00").cast("timestamp")
    done = check_run.run(rows, i.datasets, i.spark.sql(_RULE_ROWS), i.alert_configs, when)
    root = scratch_dir(i.spark, "run")
    done.append_to(root)
    read = {n: i.spark.read.parquet(f"{root}/{n}") for n in ("scores", "results", "audit")}
    failing = read["results"].groupBy("dataset_id").agg(F.sum("failed_rows").alias("failing"))
    raised = done.alerts.select("dataset_id", F.lit(True).alias("fired"))
    audited = read["audit"].groupBy("dataset_id").agg(F.count(F.lit(1)).alias("audited"))
    status = done.datasets.select(F.col("id").alias("dataset_id"), "status")
    full = read["scores"].join(failing, "dataset_id").join(audited, "dataset_id").join(status, "dataset_id")
    full = full.join(i.alert_configs.select("dataset_id"), "dataset_id").join(raised, "dataset_id", "left")
    return full.select(
        "dataset_id", "score", "total_rules", "passed_rules", "failed_rules", "failing", "status",
        F.coalesce("fired", F.lit(False)).alias("alerted"), "audited",
    )


@query(
    "d04_rule_counts",
    _DATASET_SCORES + "select dataset_id, total_rules, passed_rules, failed_rules from scored",
)
def _rule_counts(i: Inputs):
    return scoring.quality_score(i.datasets, i.rules, _latest_results(i)).drop("score")


@query(
    "d05_dataset_status",
    """select d.id, d.name, d.file_type, d.row_count, d.column_count, d.uploaded_by,
       coalesce(case when s.failed_rules = 0 then 'VALIDATED' when s.failed_rules > 0 then 'FAILED' end, d.status) as status,
       d.uploaded_at, d.column_names
       from datasets d left join (select * from quality_scores qualify row_number() over (partition by dataset_id order by checked_at desc, id desc) = 1) s
       on s.dataset_id = d.id""",
)
def _status(i: Inputs):
    latest = pick_one(i.quality_scores, ["dataset_id"], [F.desc("checked_at"), F.desc("id")])
    return scoring.apply_status(i.datasets, latest)


@query(
    "d06_eligible",
    """select d.id, d.status, case when d.status = 'ERROR' then 'Dataset parsing failed, cannot run checks.'
       when d.status = 'PROCESSING' then 'Dataset is currently processing. Please wait for processing to finish.'
       when f.o_custkey is null then 'No file associated with this dataset' end as skip_reason
       from datasets d left join (select distinct o_custkey from orders where o_orderstatus = 'F') f on f.o_custkey = d.id""",
)
def _eligible(i: Inputs):
    files = i.orders.where("o_orderstatus = 'F'").selectExpr("o_custkey as dataset_id")
    return scoring.eligible(i.datasets, files).select("id", "status", "skip_reason")


@query(
    "d07_check_result_rows",
    """select r.dataset_id, r.rule_id, s.id as quality_score_id, r.passed, r.failed_rows, r.total_rows, r.details, s.checked_at
       from check_results r join (select * from quality_scores qualify row_number() over (partition by dataset_id order by checked_at desc, id desc) = 1) s
       on s.dataset_id = r.dataset_id where r.rule_id in (select id from rules)""",
)
def _result_rows(i: Inputs):
    latest = pick_one(i.quality_scores, ["dataset_id"], [F.desc("checked_at"), F.desc("id")])
    results = i.check_results.drop("quality_score_id", "checked_at", "id")
    return scoring.check_result_rows(results, latest, i.rules)


@query(
    "d08_audit_rows",
    """select dataset_id, 'system' as triggered_by, 'scheduled' as trigger_type, score, checked_at as timestamp
       from quality_scores""",
)
def _audit(i: Inputs):
    return scoring.audit_rows(i.quality_scores, "scheduled")
