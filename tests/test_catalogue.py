"""Registered queries against their comparison SQL, and the promises of the plans."""

import inspect
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.verify import rows_of
from truegauge.plans import catalogue
from truegauge.plans.history import TABLES

PACKAGE = Path(entry_point.__file__).parent / "truegauge"

# One or two queries of every group; tools/verify.py runs them all.
SAMPLE = [
    "a04_bad_lines",
    "b06_upsert_rules",
    "c16_run_checks",
    "c18_violations",
    "d03_quality_score",
    "e05_dataset_reports",
    "f06_user_stats",
    "g02_incremental_extract",
    "h11_facts",
    "i06_new_facts",
    "j02_orphans",
    "k08_dataset_comparison",
    "k20_field_hierarchy",
    "l02_alerts",
]


@pytest.fixture(scope="module")
def db(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, db, data, name):
    df = entry_point.queries()[name](spark, data)
    cursor = db.execute(entry_point.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == want and want[1]


def test_entry(spark):
    assert entry_point.entry(spark).count() == 2


def test_every_comparison_belongs_to_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert all(re.match(r"^[a-m]\d\d_[a-z0-9_]+$", name) for name in catalogue.QUERIES)


def test_comparison_sql_parses(db):
    for name, text in catalogue.ORACLES.items():
        db.execute("explain " + text)


def test_no_cross_join_and_no_unbounded_broadcast(spark, data):
    for name in ("k08_dataset_comparison", "e06_results_near_score", "d03_quality_score", "b04_applicable_rules", "l02_alerts"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "Cross" not in plan and "strategy=broadcast" not in plan, name


def test_only_bounded_sides_are_hinted():
    # The operators for training data have a test of their own.
    modules = [p for p in PACKAGE.rglob("*.py") if "llm" not in p.relative_to(PACKAGE).parts]
    hinted = [p.name for p in modules if "F.broadcast(" in p.read_text()]
    assert hinted == ["keyed.py"]
    text = "\n".join(p.read_text() for p in modules)
    for word in ("local" + "Checkpoint", "cross" + "Join", "F.u" + "df", "to" + "Pandas"):
        assert word not in text


def test_day_filter_reaches_the_partitions(spark, data):
    plan = catalogue.QUERIES["k06_failure_by_rule_type"](spark, data)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "score" in line or "PartitionFilters: [isnotnull(date_key" in line)
    assert "20240103" in scan and "20240128" in scan


def test_flagship_is_lazy():
    assert "collect" not in inspect.getsource(entry_point.entry)
