"""Alert suppression in batch and stream; streaming ETL and checks against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from truegauge.functions import keyed
from truegauge.operators import alerts, checks, extract, reports, star
from truegauge.operators.load import StarStore
from truegauge.operators.rules import Rule
from truegauge.plans.history import Inputs
from truegauge.streaming.history_etl import merge_late, stream_history
from truegauge.streaming.live_alerts import stream_alerts
from truegauge.streaming.windowed_checks import stream_checks

T0 = datetime(2024, 1, 1, 6)
SCORES = "id bigint, dataset_id bigint, score double, checked_at timestamp_ntz"
CONFIGS = "dataset_id bigint, threshold int, email_notifications boolean, is_alert_active boolean"


def scores(spark, values, hours=5):
    return spark.createDataFrame([(n, 1, float(v), T0 + timedelta(hours=hours * n)) for n, v in enumerate(values)], SCORES)


def events(spark, values, notify=True, active=False):
    configs = spark.createDataFrame([(1, 80, notify, active)], CONFIGS)
    found = alerts.alert_events(scores(spark, values), configs)
    return [(r.id, r.event) for r in found.orderBy("id").collect()]


def test_suppression_and_recovery(spark):
    assert events(spark, [0, 0, 100, 0]) == [(0, "ALERT"), (2, "RECOVERY"), (3, "ALERT")]


def test_threshold_is_strict(spark):
    assert events(spark, [80, 79.99]) == [(1, "ALERT")]


def test_initial_flag_and_no_mail(spark):
    assert events(spark, [0, 100, 0], active=True) == [(1, "RECOVERY"), (2, "ALERT")]
    assert events(spark, [0, 100, 0], notify=False) == []


def test_no_config_no_alert(spark):
    configs = spark.createDataFrame([(2, 80, True, False)], CONFIGS)
    assert alerts.alert_events(scores(spark, [0]), configs).count() == 0


def brute_force(rows, settings):
    """Straight run through the scores in time order, one flag per dataset and setting."""
    out, flags = [], {}
    for r in sorted(rows, key=lambda r: (r["checked_at"], r["id"])):
        live = [c for c in settings if c["dataset_id"] == r["dataset_id"] and c["effective_from"] <= r["checked_at"]]
        if not live or r["score"] is None:
            continue
        c = max(live, key=lambda c: c["effective_from"])
        key = (r["dataset_id"], c["effective_from"])
        active = flags.get(key, False)
        if r["score"] < c["threshold"]:
            if c["email_notifications"] and not active:
                out.append((r["id"], "ALERT"))
                flags[key] = True
        elif active:
            out.append((r["id"], "RECOVERY"))
            flags[key] = False
    return sorted(out)


@pytest.mark.parametrize("slice_by", ["hour", "day", "month"])
def test_history_of_settings_against_brute_force(spark, data, slice_by):
    inputs = Inputs(spark, data)
    start, change = datetime(2023, 1, 1), datetime(2024, 1, 15)
    base = inputs.alert_configs
    configs = base.withColumn("effective_from", F.lit(start).cast("timestamp_ntz")).unionByName(
        base.select(
            "dataset_id",
            (F.lit(100) - F.col("threshold")).alias("threshold"),
            (F.col("threshold") > 60).alias("email_notifications"),
            F.lit(change).cast("timestamp_ntz").alias("effective_from"),
        )
    )
    got = alerts.alert_events(inputs.quality_scores, configs, slice_by)
    want = brute_force(inputs.quality_scores.collect(), configs.collect())
    assert sorted((r.id, r.event) for r in got.collect()) == want and want


def test_changed_threshold_resets_the_flag(spark):
    old = spark.createDataFrame([(1, 80, True, True), (2, 70, False, True)], CONFIGS)
    new = spark.createDataFrame([(1, 90), (3, 50), (4, 101)], "dataset_id bigint, threshold int")
    got = {r.dataset_id: tuple(r)[1:] for r in alerts.set_thresholds(old, new).collect()}
    assert got == {1: (90, True, False), 2: (70, False, True), 3: (50, True, False)}


def test_messages(spark):
    configs = spark.createDataFrame([(1, 80, True, False)], CONFIGS)
    raised = alerts.alerts(scores(spark, [12.5]), configs)
    datasets = spark.createDataFrame([(1, "sales", None)], "id bigint, name string, uploaded_by int")
    users = spark.createDataFrame([(1, "a@x.com")], "id int, email string")
    row = alerts.alert_messages(raised, datasets, users, "http://host").first()
    assert row.recipient is None and row.subject == "Data Quality Alert: sales"
    assert "Current Score: 12.5\nThreshold: 80" in row.message and row.message.endswith("http://host/reports/1")


def test_heavy_and_light_keys(spark, monkeypatch):
    """The split join gives the same rows whichever keys count as heavy."""
    rows = spark.range(60).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 9))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 6")
    keys = {r.k for r in counted.collect()}
    want = {r.id for r in rows.collect() if r.k in keys}
    for heavy in (0, 1, 3, 1000):
        monkeypatch.setattr(keyed, "HEAVY_KEYS", heavy)
        assert {r.id for r in keyed.semi_join_by_count(rows, counted, ["k"]).collect()} == want
    assert any(r % 3 == 0 for r in want)


def test_results_near_a_score(spark):
    score = spark.createDataFrame([(1, 7, T0), (2, 8, T0)], "id bigint, dataset_id bigint, checked_at timestamp_ntz")
    rows = [(n, 7, 1, True, 0, 1, "", T0 + timedelta(seconds=s), None) for n, s in enumerate((-6, -5, -1, 0, 4, 5, 5.5))]
    rows.append((99, 8, 1, True, 0, 1, "", T0 + timedelta(days=1), 2))
    results = spark.createDataFrame(
        rows,
        "id bigint, dataset_id bigint, rule_id bigint, passed boolean, failed_rows bigint, total_rows bigint, details string, checked_at timestamp_ntz, quality_score_id bigint",
    )
    got = sorted((r.report_id, r.id) for r in reports.score_results(score, results).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 99)]


# --- streams ---------------------------------------------------------------


def replay(df, folder, order, parts=3):
    """Write rows in time order as several files; read back one file per micro-batch."""
    spark = df.sparkSession
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * size : (n + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streamed_history_equals_batch(spark, data, tmp_path):
    inputs = Inputs(spark, data)
    results = inputs.check_results.withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    source = tmp_path / "source"
    stream = replay(results, source, "checked_at", parts=2)
    # One file is delivered a second time.
    results.where("id < 100").coalesce(1).write.mode("append").parquet(str(source))
    store = StarStore(spark, str(tmp_path / "star"))
    query = stream_history(stream, inputs.rules, inputs.datasets, store, str(tmp_path / "ckpt"), lateness="60 days")
    query.awaitTermination(600)
    assert query.exception() is None
    batch = star.transform(extract.base_extract(inputs.history)).star
    key = ["dataset_id", "rule_id", "checked_at", "date_key"]
    got, want = store.read("fact_quality_checks"), batch.facts
    assert got.count() == want.count()
    assert want.select(*key).exceptAll(got.select(*key)).count() == 0
    assert store.read("agg_daily_quality").agg(F.sum("total_checks")).first()[0] == want.count()


RULES = [
    Rule(1, "value", "RANGE", "HIGH", {"min": 1, "max": 90}),
    Rule(2, "event_type", "REGEX", "LOW", {"pattern": "(view|click)$"}),
]


@pytest.mark.parametrize("rules", [RULES, [Rule(3, "event_type", "UNIQUE")], [*RULES, Rule(3, "event_type", "UNIQUE")]])
def test_streamed_checks_equal_batch(spark, data, tmp_path, rules):
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = replay(rows, tmp_path / "events", "ts")
    query = (
        stream_checks(stream, rules, ["user_id"], "ts")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .option("path", str(tmp_path / "out"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(600)
    assert query.exception() is None
    day = F.to_date("window.start").alias("day")
    got = spark.read.parquet(str(tmp_path / "out")).select(day, "user_id", "rule_id", "failed_rows", "total_rows")
    batch = checks.run_checks_by(rows.withColumn("day", F.to_date("ts")), rules, ["day", "user_id"])
    # The last windows stay open until later events move the watermark past them.
    last = got.agg(F.max("day")).first()[0]
    want = batch.where(F.col("day") <= last).select("day", "user_id", "rule_id", "failed_rows", "total_rows")
    assert got.count() > 100 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_alerts_equal_batch(spark, data, tmp_path):
    inputs = Inputs(spark, data)
    rows = inputs.quality_scores.select("id", "dataset_id", "score", "checked_at")
    configs = inputs.alert_configs.withColumn("is_alert_active", F.lit(False))
    stream = replay(rows, tmp_path / "scores", ["checked_at", "id"], parts=4)
    query = stream_alerts(stream, configs, str(tmp_path / "alerts"), str(tmp_path / "ckpt"))
    query.awaitTermination(600)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "alerts" / "events"))
    want = alerts.alert_events(rows, configs)
    assert got.select("batch").distinct().count() > 1
    assert sorted((r.id, r.event) for r in got.collect()) == sorted((r.id, r.event) for r in want.collect())


def versions(spark, rows):
    return spark.createDataFrame(rows, "dataset_id bigint, threshold int, email_notifications boolean, effective_from timestamp_ntz")


def streamed(spark, tmp_path, batches, configs):
    """Events and states of a stream that takes the batches one by one."""
    folder, root = str(tmp_path / "scores"), str(tmp_path / "alerts")
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(batch.schema).parquet(folder)
        query = stream_alerts(stream, lambda n=n: configs[min(n, len(configs) - 1)], root, str(tmp_path / "ckpt"))
        query.awaitTermination(600)
        assert query.exception() is None
    events = [(r.id, r.event) for r in spark.read.parquet(f"{root}/events").orderBy("id").collect()]
    states = [sorted(map(tuple, spark.read.parquet(f"{root}/state/batch={n}").collect())) for n in range(len(batches))]
    return events, states


def test_two_settings_raise_no_repeated_alert(spark, tmp_path):
    both = versions(spark, [(1, 80, True, T0 - timedelta(days=9)), (1, 90, True, T0 + timedelta(days=9))])
    rows = scores(spark, [0, 0, 0])
    events, states = streamed(spark, tmp_path, [rows.where(f"id = {n}") for n in range(3)], [both])
    assert events == [(0, "ALERT")]
    assert states == [[(1, True, T0 - timedelta(days=9))]] * 3


def test_threshold_set_in_mid_stream_alerts_again(spark, tmp_path):
    first = versions(spark, [(1, 80, True, T0 - timedelta(days=9))])
    changes = spark.createDataFrame([(1, 80), (2, 70), (3, 300)], "dataset_id bigint, threshold int")
    # Set between the second score (5 hours after the first) and the third.
    second = alerts.set_thresholds_at(first, changes, F.lit(T0 + timedelta(hours=6)).cast("timestamp_ntz"))
    assert {tuple(r)[:3] for r in second.collect()} == {(1, 80, True), (2, 70, True)} and second.count() == 3
    rows = scores(spark, [0, 0, 0, 0, 85, 0])
    events, states = streamed(spark, tmp_path, [rows.where("id < 2"), rows.where("id in (2, 3)"), rows.where("id > 3")], [first, second])
    assert events == [(0, "ALERT"), (2, "ALERT"), (4, "RECOVERY"), (5, "ALERT")]
    assert [len(s) for s in states] == [1, 1, 1] and states[-1] == [(1, True, T0 + timedelta(hours=6))]


def test_a_setting_waits_for_its_first_score(spark, tmp_path):
    settings = versions(spark, [(1, 80, True, T0), (1, 80, True, T0 + timedelta(hours=12))])
    rows = scores(spark, [0, 0, 0, 0])  # at 0, 5, 10 and 15 hours
    other = spark.createDataFrame([(9, 2, 0.0, T0 + timedelta(hours=13))], SCORES)
    events, states = streamed(spark, tmp_path, [rows.where("id < 3"), other, rows.where("id = 3")], [settings])
    assert events == [(0, "ALERT"), (3, "ALERT")]
    assert [s[0][2] for s in states] == [T0, T0, T0 + timedelta(hours=12)]


@pytest.mark.parametrize("parts", [1, 7])
def test_streamed_changes_equal_batch_and_state_stays_small(spark, data, tmp_path, parts):
    inputs = Inputs(spark, data)
    rows = inputs.quality_scores.select("id", "dataset_id", "score", "checked_at")
    base = inputs.alert_configs.drop("is_alert_active")
    when = [datetime(2023, 1, 1), datetime(2024, 1, 9), datetime(2024, 1, 20)]
    settings = None
    for n, at in enumerate(when):
        version = base.select("dataset_id", (F.col("threshold") + 5 * n).alias("threshold"), F.lit(n != 1).alias("email_notifications"), F.lit(at).cast("timestamp_ntz").alias("effective_from"))
        settings = version if settings is None else settings.unionByName(version)
    ordered = rows.orderBy("checked_at", "id").collect()
    size = -(-len(ordered) // parts)
    batches = [spark.createDataFrame(ordered[n * size : (n + 1) * size], rows.schema) for n in range(parts)]
    events, states = streamed(spark, tmp_path, batches, [settings])
    assert events == brute_force(ordered, settings.collect()) and events
    assert len(states[-1]) == len({s[0] for s in states[-1]}) <= base.count()


def test_a_hot_day_is_spread_over_slices(spark):
    rows = spark.range(4000).select("id", F.lit(1).cast("long").alias("dataset_id"), (F.col("id") % 7 * 20).cast("double").alias("score"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).cast("timestamp_ntz").alias("checked_at"))
    configs = versions(spark, [(1, 80, True, T0 - timedelta(days=1)), (1, 50, True, T0 + timedelta(minutes=30))])
    want = brute_force([r.asDict() for r in rows.collect()], configs.collect())
    for slice_by in ("second", "minute", "day"):
        assert sorted((r.id, r.event) for r in alerts.alert_events(rows, configs, slice_by).collect()) == want


def test_late_rows_wait_and_are_merged_once(spark, tmp_path):
    kinds = "id bigint, dataset_id bigint, rule_id bigint, passed boolean, failed_rows bigint, total_rows bigint, checked_at timestamp"
    rules = spark.createDataFrame([(1, "a", "RANGE", "HIGH", "f", "csv", True)], "id bigint, name string, rule_type string, severity string, field_name string, dataset_type string, is_active boolean")
    sets = spark.createDataFrame([(1, "d", "csv", 10, 2, None, "OK")], "id bigint, name string, file_type string, row_count bigint, column_count int, uploaded_at timestamp_ntz, status string")
    store, source = StarStore(spark, str(tmp_path / "star")), str(tmp_path / "source")

    def deliver(*days):
        rows = [(100 * d, 1, 1, True, 0, 10, T0 + timedelta(days=d)) for d in days]
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(source)
        query = stream_history(spark.readStream.schema(kinds).parquet(source), rules, sets, store, str(tmp_path / "ckpt"), lateness="2 days")
        query.awaitTermination(600)
        assert query.exception() is None
        return sorted(r.checked_at for r in store.read("fact_quality_checks").collect())

    assert len(deliver(10)) == 1
    assert len(deliver(9, 8, 3, 10)) == 2  # day 8 lies on the bound, day 10 came before
    assert len(deliver(20)) == 3
    assert len(deliver(11)) == 3
    assert merge_late(store, rules, sets).fact_quality_checks == 3
    assert merge_late(store, rules, sets).fact_quality_checks == 0
    assert store.read("fact_quality_checks").count() == 6
    assert store.read("agg_daily_quality").agg(F.sum("total_checks")).first()[0] == 6
