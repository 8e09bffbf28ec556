"""Extract tables over JDBC or from the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from truegauge.operators.extract import History

TABLES = ("check_results", "validation_rules", "datasets")
FETCH_ROWS = 1000


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_rows: int = FETCH_ROWS,
    driver: str | None = None,
) -> dict[str, str]:
    """Reader options; a numeric or time column splits the table into parallel reads."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows)}
    if driver:
        options["driver"] = driver
    if partition_column and bounds and partitions > 1:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **split) -> DataFrame:
    """Lazy table; filters and column choice are pushed into the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **split)).load()


def history_from_jdbc(
    spark: SparkSession, url: str, results_bounds: tuple[int, int], partitions: int = 64, driver: str | None = None
) -> History:
    results = read_jdbc(
        spark, url, TABLES[0], partition_column="id", bounds=results_bounds, partitions=partitions, driver=driver
    )
    return History(results, read_jdbc(spark, url, TABLES[1], driver=driver), read_jdbc(spark, url, TABLES[2], driver=driver))


def history_from_catalog(spark: SparkSession, database: str | None = None) -> History:
    prefix = f"{database}." if database else ""
    return History(*(spark.table(prefix + t) for t in TABLES))


def history_from_parquet(spark: SparkSession, root: str) -> History:
    return History(*(spark.read.parquet(f"{root.rstrip('/')}/{t}") for t in TABLES))
