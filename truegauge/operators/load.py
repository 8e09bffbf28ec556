"""Loading: upserts, append, de-duplication and the daily aggregate.

Each operator maps tables to the table that should result; ``StarStore`` writes
them to Parquet. Facts are partitioned by ``date_key`` and a load reads and
rewrites only the days it brings.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from truegauge.functions.keyed import pick_one
from truegauge.functions.numeric import plain_mean, score_cents
from truegauge.operators.integrity import day_figures, totals
from truegauge.operators.star import BUSINESS_KEY, FACT_COLUMNS, Star
from truegauge.session import path_exists


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that sorts and merges, never a broadcast.

    The planner goes by the size of compressed files and the share of columns read. Keys
    compress so well that some MB of files become a hash table many times as large, which
    the driver builds and holds. Joins on unique keys have no hot key that would need one.
    """
    return df.hint("merge")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Source rows replace target rows of the same key; the rest stays."""
    kept = target.join(unsent(source.select(*keys)), list(keys), "left_anti")
    return source.select(*target.columns).unionByName(kept.select(*target.columns))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not have yet."""
    return source.join(unsent(target.select(*keys)), list(keys), "left_anti")


def changed_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """Ids of source rows that the target lacks or holds with other values, compared by hash."""
    row = F.xxhash64(*target.columns)
    old = target.select("id", row.alias("_old"))
    return source.select("id", row.alias("_new")).join(unsent(old), "id", "left").where("_old is null or _old <> _new")


def _same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = None
    for key in keys:
        one = F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
        condition = one if condition is None else condition & one
    return condition


def new_facts(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Facts of a batch whose business key is absent from the target.

    One anti join; a missing ``checked_at`` equals another missing one, so that a
    repeated load adds nothing.
    """
    return (
        batch.alias("new")
        .join(unsent(target.select(*BUSINESS_KEY)).alias("old"), _same_key("new", "old", BUSINESS_KEY), "left_anti")
        .select(*batch.columns)
    )


def dedupe_facts(facts: DataFrame, age: Sequence[Column] = ()) -> DataFrame:
    """Table after de-duplication: the oldest row of each business key stays.

    ``date_key`` follows from the business key; as a key it lets day filters through.
    """
    return pick_one(facts, [*BUSINESS_KEY, "date_key"], list(age) or [F.col("id")])


def daily_aggregate(facts: DataFrame, dim_rules: DataFrame) -> DataFrame:
    """Per day and dataset: counts, score range and failures by severity.

    Facts are added up per (day, dataset, rule) before the rules are joined, so the
    join and its shuffle see aggregates instead of facts.
    """
    cells = facts.groupBy("date_key", "dataset_id", "rule_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("passed").alias("ok"),
        F.sum(score_cents(F.col("score"))).alias("points"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    )
    severity = dim_rules.select(F.col("id").alias("rule_id"), "severity")
    failed = F.col("n") - F.col("ok")
    return (
        cells.join(severity, "rule_id", "left")
        .groupBy("date_key", "dataset_id")
        .agg(
            F.sum("n").alias("total_checks"),
            F.sum("ok").alias("passed_checks"),
            F.sum(failed).alias("failed_checks"),
            plain_mean(F.sum("points"), F.sum("n")).alias("avg_score"),
            F.min("low").alias("min_score"),
            F.max("high").alias("max_score"),
            *[
                F.coalesce(F.sum(F.when(F.col("severity") == s, failed)), F.lit(0))
                .cast("long")
                .alias(f"{s.lower()}_severity_failures")
                for s in ("HIGH", "MEDIUM", "LOW")
            ],
        )
    )


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and what will tell its number of rows once it has been written."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def rows_of(seen: Observation) -> int:
    return seen.get.get("n") or 0


@dataclass(frozen=True)
class LoadSummary:
    dim_datasets: int = 0
    dim_rules: int = 0
    dim_date: int = 0
    fact_quality_checks: int = 0
    duplicates_removed: int = 0
    skipped: int = 0
    #: Days whose facts the load has met.
    days: tuple[int, ...] = ()

    @property
    def total_loaded(self) -> int:
        return self.dim_datasets + self.dim_rules + self.dim_date + self.fact_quality_checks


class StarStore:
    """The star schema as Parquet folders under one root on shared storage.

    The two upserted dimensions are cut into ``BUCKETS`` by a hash of the key. An upsert
    compares rows by hash and writes only buckets with a changed row, each time into a
    folder of its own; rows in ``_versions`` then make those folders the current ones. A
    job that dies before them leaves the previous version in force.
    """

    TABLES = ("dim_datasets", "dim_rules", "dim_date", "fact_quality_checks")
    VERSIONED = ("dim_datasets", "dim_rules")
    BUCKETS = 32
    VERSION_SCHEMA = "name STRING, bucket INT, folder STRING, n BIGINT"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _versions(self) -> dict[str, dict[int, tuple[str | None, int]]]:
        """Current folder of each bucket of the versioned tables; none if it has no rows."""
        if not path_exists(self.spark, f"{self.root}/_versions"):
            return {}
        rows = self.spark.read.schema(self.VERSION_SCHEMA).parquet(f"{self.root}/_versions")
        newest = rows.groupBy("name", "bucket").agg(F.max_by("folder", "n").alias("folder"), F.max("n").alias("n"))
        out: dict[str, dict[int, tuple[str | None, int]]] = {}
        for r in newest.collect():
            out.setdefault(r["name"], {})[r["bucket"]] = (r["folder"], r["n"])
        return out

    def exists(self, table: str) -> bool:
        if table in self.VERSIONED:
            return table in self._versions()
        if not path_exists(self.spark, self.path(table)):
            return False
        try:
            self.spark.read.parquet(self.path(table)).schema
        except AnalysisException:
            return False
        return True

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table; of an upserted dimension only some buckets, if asked for."""
        if table not in self.VERSIONED:
            return self.spark.read.parquet(self.path(table))
        current = {b: folder for b, (folder, _) in self._versions()[table].items() if folder}
        paths = {b: f"{self.path(table)}/{folder}/_bucket={b}" for b, folder in sorted(current.items())}
        if buckets is None:
            return self.spark.read.parquet(*paths.values())
        schema = self.spark.read.parquet(next(iter(paths.values()))).schema
        chosen = [paths[b] for b in buckets if b in paths]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def star(self) -> Star:
        return Star(*(self.read(t) for t in self.TABLES))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.BUCKETS)).cast("int")

    def replace(self, table: str, df: DataFrame) -> None:
        """New version of a whole dimension; ``df`` may read the current one."""
        self._write_buckets(table, df, range(self.BUCKETS))

    def _write_buckets(self, table: str, df: DataFrame, buckets: Sequence[int]) -> None:
        """``df``, all rows of these buckets, becomes their current version."""
        last = max((n for _, n in self._versions().get(table, {}).values()), default=0)
        folder = f"v{last + 1}-{uuid.uuid4().hex[:8]}"
        filled = Observation(f"buckets-{uuid.uuid4().hex}")
        dealt = df.withColumn("_bucket", self._bucket()).repartition("_bucket")
        dealt = dealt.observe(filled, F.collect_set("_bucket").alias("buckets"))
        dealt.write.partitionBy("_bucket").parquet(f"{self.path(table)}/{folder}")
        held = set(filled.get.get("buckets") or [])
        if not held and len(buckets) == self.BUCKETS:
            # An empty table still has its columns.
            df.limit(0).write.parquet(f"{self.path(table)}/{folder}/_bucket={buckets[0]}")
            held = {buckets[0]}
        rows = [(table, b, folder if b in held else None, last + 1) for b in buckets]
        versions = self.spark.createDataFrame(rows, self.VERSION_SCHEMA).coalesce(1)
        versions.write.mode("append").parquet(f"{self.root}/_versions")

    def replace_days(self, table: str, df: DataFrame) -> int:
        """Overwrite only the ``date_key`` partitions that ``df`` contains; the rows written.

        ``df`` may read those partitions, so it is staged first, in a folder of this call's
        own. Should the job die while the days are swapped, ``swap_days`` repeats that
        step from the stage.
        """
        folder = f"{self.path(table)}__staged/{uuid.uuid4().hex}"
        staged, seen = counted(df)
        staged.write.parquet(folder)
        self.swap_days(table, folder)
        return rows_of(seen)

    def swap_days(self, table: str, folder: str) -> None:
        (
            self.spark.read.parquet(folder)
            .hint("rebalance", "date_key")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date_key")
            .parquet(self.path(table))
        )

    def append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(table))

    def append_facts(self, facts: DataFrame) -> int:
        """Add facts to their days and tell how many. The rebalance hint lets AQE split a
        busy day over several tasks and merge quiet ones, by measured size."""
        added, seen = counted(facts.select(*FACT_COLUMNS).hint("rebalance", "date_key"))
        added.write.mode("append").partitionBy("date_key").parquet(self.path("fact_quality_checks"))
        return rows_of(seen)

    def compact(self, most: int = 8) -> list[int]:
        """Rewrite the days whose facts lie in more than ``most`` files; those days.

        Every load adds files to its days. A rewritten day has as many as its size calls
        for, as the rebalance hint packs small parts together. The rows stay the same. No
        load may run meanwhile, so the stream does it between two of its batches.
        """
        table = "fact_quality_checks"
        held = self.read(table).select("date_key", F.col("_metadata.file_path").alias("file"))
        files = held.groupBy("date_key").agg(F.count_distinct("file").alias("n"))
        days = sorted(r["date_key"] for r in files.where(F.col("n") > most).collect())
        if days:
            self.replace_days(table, self.read(table).where(F.col("date_key").isin(days)))
        return days

    def _upsert(self, table: str, source: DataFrame) -> None:
        """Rows of ``source`` replace those of their id. Only buckets in which a row is new
        or differs are read in full and written; without one nothing is."""
        if not self.exists(table):
            self.replace(table, source)
            return
        fresh = changed_rows(self.read(table), source)
        touched = sorted(r["bucket"] for r in fresh.select(self._bucket().alias("bucket")).distinct().collect())
        if touched:
            mine = source.where(self._bucket().isin(touched))
            self._write_buckets(table, upsert(self.read(table, touched), mine, ["id"]), touched)

    def _stage(self, name: str, df: DataFrame) -> tuple[DataFrame, int]:
        """Compute a batch table once; later steps and retries read the same rows.

        The folder is this call's own, so a second writer never overwrites a batch that
        is still being read. The number of rows comes from the write itself.
        """
        path = f"{self.root}/_batch/{name}-{uuid.uuid4().hex}"
        written, seen = counted(df)
        written.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), rows_of(seen)

    def load(self, batch: Star, refresh_daily: bool = True) -> LoadSummary:
        """Dimensions, then facts not yet present, then the daily rows of those days."""
        facts, n_facts = self._stage("facts", batch.facts.select("id", *FACT_COLUMNS))
        days = [r["date_key"] for r in facts.select("date_key").distinct().toLocalIterator()]
        if not days:
            return LoadSummary()
        datasets, n_datasets = self._stage("dim_datasets", batch.dim_datasets)
        rules, n_rules = self._stage("dim_rules", batch.dim_rules)
        dates, n_dates = self._stage("dim_date", batch.dim_date)

        stale = self._days_of_changed_rules(rules) if refresh_daily else []
        self._upsert("dim_datasets", datasets)
        self._upsert("dim_rules", rules)
        absent = insert_ignore(self.read("dim_date"), dates, ["date_key"]) if self.exists("dim_date") else dates
        self.append("dim_date", absent)

        table = "fact_quality_checks"
        fresh = dedupe_facts(facts, [F.col("id").desc()])
        if self.exists(table):
            # Only the partitions of the incoming days are read.
            fresh = new_facts(self.read(table).where(F.col("date_key").isin(days)), fresh)
        inserted = self.append_facts(fresh)
        if refresh_daily:
            renewed = self.read(table).where(F.col("date_key").isin(sorted({*days, *stale})))
            self.replace_days("agg_daily_quality", daily_aggregate(renewed, self.read("dim_rules")))
        return LoadSummary(n_datasets, n_rules, n_dates, inserted, skipped=n_facts - inserted, days=tuple(sorted(days)))

    def _days_of_changed_rules(self, rules: DataFrame) -> list[int]:
        """Days with facts of rules whose severity is about to change: their daily rows
        hold the old one."""
        if not (self.exists("dim_rules") and self.exists("fact_quality_checks")):
            return []
        now = rules.select("id", F.col("severity").alias("new"))
        changed = self.read("dim_rules").join(unsent(now), "id").where(~F.col("severity").eqNullSafe(F.col("new")))
        changed = changed.select(F.col("id").alias("rule_id"))
        if changed.isEmpty():
            return []
        old = self.read("fact_quality_checks").select("rule_id", "date_key").join(changed, "rule_id", "left_semi")
        return [r["date_key"] for r in old.select("date_key").distinct().collect()]

    def append_then_dedupe(self, batch_facts: DataFrame) -> LoadSummary:
        """The other way to load facts: append first, then drop repeats, oldest row kept.

        ``_arrival`` is 0 for rows already in the table and 1 for new ones, which are
        ranked by their ``id``; only the days of the batch are rewritten.
        """
        facts, n_facts = self._stage("facts", batch_facts.select("id", *FACT_COLUMNS))
        days = [r["date_key"] for r in facts.select("date_key").distinct().toLocalIterator()]
        if not days:
            return LoadSummary()
        table, rows, before = "fact_quality_checks", facts.withColumn("_arrival", F.lit(1)), 0
        if self.exists(table):
            old, before = self._stage("old-facts", self.read(table).where(F.col("date_key").isin(days)))
            old = old.withColumn("_arrival", F.lit(0)).withColumn("id", F.lit(None).cast(facts.schema["id"].dataType))
            rows = old.select(*rows.columns).unionByName(rows)
        left = self.replace_days(table, dedupe_facts(rows, [F.col("_arrival"), F.col("id")]).select(*FACT_COLUMNS))
        return LoadSummary(fact_quality_checks=n_facts, duplicates_removed=before + n_facts - left, days=tuple(sorted(days)))

    def refresh_validation(self, days: Sequence[int]) -> DataFrame:
        """Validation figures of all days, in one row, after a load of ``days``.

        Figures are kept per day. Only the given days are counted anew, and those in which
        a fact had no dimension row, which may have come since.
        """
        table, facts = "validation_by_day", self.read("fact_quality_checks")
        if self.exists(table):
            broken = F.col("orphan_datasets") + F.col("orphan_rules") + F.col("orphan_dates") > 0
            again = [r["date_key"] for r in self.read(table).where(broken).select("date_key").distinct().collect()]
            facts = facts.where(F.col("date_key").isin(sorted({*days, *again})))
        star = Star(self.read("dim_datasets"), self.read("dim_rules"), self.read("dim_date"), facts)
        self.replace_days(table, day_figures(star))
        return totals(self.read(table))
