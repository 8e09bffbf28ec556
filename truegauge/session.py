"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", app: str = "truegauge", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Joins of facts with a dimension too large to broadcast shuffle on its key, and the
# steps behind them may reuse that layout. Splitting a hot key then costs one more
# shuffle, which Spark only accepts when told to.
RUNTIME = (
    "spark.sql.session.timeZone",
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.forceOptimizeSkewedJoin",
)


def prepare(spark: SparkSession) -> SparkSession:
    """UTC and the adaptive handling of skew for a session made elsewhere."""
    for key in RUNTIME:
        spark.conf.set(key, SETTINGS[key])
    return spark


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of its file system.

    Reading what is absent would also tell, but as a failed query, which every listener of
    the session would hear of.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder.

    That is ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``. A
    machine-local folder is taken only where driver and executors are one process;
    on a cluster without a shared folder this raises, as executors would write where
    no other reads.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="truegauge-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
