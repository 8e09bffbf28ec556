"""Pages by key against OFFSET."""

import pytest
from pyspark.sql import functions as F

from truegauge.functions.paging import page_after, page_index

ORDER = ["k", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    # Keys with many ties; the id breaks them.
    return spark.range(0, 517, numPartitions=7).select("id", (F.col("id") * 7919 % 13).cast("string").alias("k"), F.lit("x").alias("page"))


@pytest.mark.parametrize("size", [1, 20, 517, 600])
def test_jumps_equal_offset(rows, size):
    want = [tuple(r) for r in rows.orderBy(*ORDER).collect()]
    index = page_index(rows, ORDER, size)
    assert index.total == 517
    pages = -(-517 // size)
    for n in {1, 2, pages // 2 + 1, pages, pages + 1}:
        assert [tuple(r) for r in index.page(rows, n).collect()] == want[(n - 1) * size : n * size]


def test_walking_reaches_every_row_once(rows):
    seen, last = [], None
    while True:
        page = page_after(rows, ORDER, 100, last).collect()
        if not page:
            break
        seen += [r.id for r in page]
        last = [page[-1][c] for c in ORDER]
    assert seen == [r.id for r in rows.orderBy(*ORDER).collect()]


def test_bounds_reach_the_scan(spark, rows, tmp_path):
    rows.orderBy(*ORDER).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    plan = page_index(table, ORDER, 50).page(table, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k," in plan and "Offset" not in plan


def test_rows_added_after_the_index_and_an_empty_table(spark, rows):
    index = page_index(rows, ["id"], 100)
    more = rows.unionByName(spark.range(250, 251).select(F.col("id").cast("long"), F.lit("z").alias("k"), F.lit("y").alias("page")))
    assert index.page(more, 3).count() == 101
    empty = page_index(rows.limit(0), ORDER, 10)
    assert empty.total == 0 and empty.page(rows, 1).count() == 0
