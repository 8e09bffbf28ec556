"""The history pipeline: extract, transform, load, validate, remember."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from truegauge.operators import integrity
from truegauge.operators.extract import History, from_micros, marked_extract, since
from truegauge.operators.integrity import IntegrityError
from truegauge.operators.load import LoadSummary, StarStore
from truegauge.operators.star import SchemaError, transform
from truegauge.session import prepare, scratch_dir
from truegauge.sources.state import State, append_run, load_state, save_state


@dataclass
class PipelineResult:
    run_id: str
    mode: str
    dry_run: bool = False
    success: bool = False
    started_at: datetime | None = None
    finished_at: datetime | None = None
    records_extracted: int = 0
    summary: LoadSummary = field(default_factory=LoadSummary)
    warnings: list[str] = field(default_factory=list)
    findings: list[dict] = field(default_factory=list)
    error: str | None = None

    @property
    def validation_passed(self) -> bool:
        return not any(f["severity"] in integrity.ERROR_LEVELS for f in self.findings)

    @property
    def seconds(self) -> float:
        return (self.finished_at - self.started_at).total_seconds()


def run(
    spark: SparkSession,
    history: History,
    root: str,
    mode: str = "full",
    dry_run: bool = False,
    strict: bool = False,
    use_watermark: bool = True,
) -> PipelineResult:
    """One run into the star schema under ``root`` (shared storage).

    The source is read once: its rows are staged, and their number and newest time come
    from that write. Transform, warnings, load and validation work on the stage, and an
    increment validates only its days. The watermark moves only after validation passed.
    ``strict`` raises on integrity errors; otherwise failures are reported in the result.
    """
    result = PipelineResult(f"run_{uuid.uuid4().hex[:12]}", mode, dry_run, started_at=datetime.now(timezone.utc))
    state_path, log_path = f"{root}/_state", f"{root}/etl_run_log"
    store = StarStore(prepare(spark), f"{root}/star")
    try:
        state = load_state(spark, state_path)
        stored = state.high_watermark if mode == "incremental" else None
        staged, seen = _staged(spark, history, mode, stored)
        if stored is not None and use_watermark and not seen["n"]:
            # Nothing at or after the watermark: it is ahead of the source.
            stored = None
            staged, seen = _staged(spark, history, "full", None)
        raw = staged.where("known").drop("known")
        result.records_extracted = seen["known"]
        if result.records_extracted == 0:
            result.warnings.append("No data to process")
            result.success = True
            return result

        made = transform(raw)
        result.warnings += [r["message"] for r in made.warnings.collect()]
        if dry_run:
            result.success = True
            return result

        result.summary = store.load(made.star)
        known = stored is None or state.source_rows is not None
        if known:
            source_rows = seen["n"] + (0 if stored is None else state.source_rows - state.rows_at_mark)
        else:
            source_rows = history.check_results.count()
        figures = store.refresh_validation(result.summary.days).withColumn("source", F.lit(source_rows).cast("long"))
        result.findings = [r.asDict() for r in integrity.findings(figures).collect()]
        if result.validation_passed:
            newest = from_micros(seen["newest"])
            at_mark = staged.where(F.unix_micros(F.col("checked_at").cast("timestamp")) == F.lit(seen["newest"])).count()
            mark, rows = (newest or state.high_watermark, source_rows) if use_watermark else (state.high_watermark, None)
            save_state(spark, state_path, State(mark, result.run_id, result.started_at.isoformat(), rows, at_mark))
        elif strict:
            raise IntegrityError("Pipeline validation failed: " + "; ".join(f["message"] for f in result.findings))
        result.success = True
    except SchemaError as problem:
        result.error = f"Transform validation failed: {problem}"
    except IntegrityError as problem:
        result.error = str(problem)
        raise
    except Exception as problem:
        if strict:
            raise
        result.error = f"Unexpected error: {str(problem).splitlines()[0]}"
    finally:
        result.finished_at = datetime.now(timezone.utc)
        if not dry_run:
            append_run(spark, log_path, _log_row(result))
    return result


def _staged(spark: SparkSession, history: History, mode: str, stored: datetime | None) -> tuple[DataFrame, dict]:
    """The marked extract as written, and its figures: ``n``, ``known``, ``newest`` in microseconds."""
    bound = stored.replace(tzinfo=None) if stored is not None else None
    rows = marked_extract(History(since(history.check_results, mode, bound), history.rules, history.datasets))
    seen = Observation(f"extract-{uuid.uuid4().hex}")
    watched = rows.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.count_if("known").alias("known"),
        F.max(F.unix_micros(F.col("checked_at").cast("timestamp"))).alias("newest"),
    )
    path = scratch_dir(spark, "extract")
    watched.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), {"n": 0, "known": 0, "newest": None} | dict(seen.get)


def _log_row(result: PipelineResult) -> dict:
    return {
        "run_id": result.run_id,
        "started_at": result.started_at,
        "finished_at": result.finished_at,
        "status": "success" if result.success else "failed",
        "mode": result.mode,
        "records_extracted": result.records_extracted,
        "records_loaded": result.summary.fact_quality_checks,
        "duplicates_removed": result.summary.duplicates_removed or result.summary.skipped,
        "duration_seconds": result.seconds,
        "error_message": result.error,
    }
