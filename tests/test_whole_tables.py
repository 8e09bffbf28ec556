"""Readers and streams over whole tables: every text, every closed day."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.verify import rows_of
from truegauge.plans.history import TABLES

ODD = ["", "back\\slash", "C:\\new\\", '"', 'a "quoted, word" \\" here', " blanks ", "line\nof, text\n", "Jörg ü ñ ß", "中文, ж", "a,b;c", "NA", "\\", '",', None]


def compared(spark, folder, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    df = entry_point.queries()[name](spark, folder)
    cursor = db.execute(entry_point.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == want and want[1]
    return want[1]


@pytest.mark.parametrize("name,rows", [("a03_encoding_whole", len(ODD) - 2), ("a03_quoted_documents_whole", len(ODD))])
def test_odd_texts_come_back(spark, data, tmp_path, name, rows):
    for table in TABLES:
        (tmp_path / f"{table}.parquet").symlink_to(f"{data}/{table}.parquet")
    (tmp_path / "documents.parquet").unlink()
    duckdb.connect().execute(f"copy (select unnest(range({len(ODD)})) as doc_id, unnest(?) as text, 'fr' as lang) to '{tmp_path}/documents.parquet'", [ODD])
    assert len(compared(spark, str(tmp_path), name)) == rows


@pytest.mark.parametrize("name", ["a03_encoding_whole", "a03_quoted_documents_whole", "m04_stream_checks_whole"])
def test_given_tables(spark, data, name):
    compared(spark, data, name)


def test_stream_checks_give_a_row_per_user_day_and_rule(spark, data):
    want = duckdb.connect().execute(f"select count(*) * 3 from (select distinct user_id, cast(ts as date) as day from '{data}/events.parquet' where cast(ts as date) + interval 1 day <= (select max(ts) - interval 12 hour from '{data}/events.parquet'))").fetchone()[0]
    found = entry_point.queries()["m04_stream_checks"](spark, data)
    assert {"user_id", "day", "rule_id"} <= set(found.columns) and found.distinct().count() == want
