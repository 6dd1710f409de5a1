"""Session defaults.  Every setting is one Spark reads; nothing here is required on a cluster that sets its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "corvane", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cpus) if str(cpus).isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("CORVANE_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime settings that the dialect's semantics rest on (UTC, ANSI, TIME type)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.timeType.enabled"):
        spark.conf.set(key, DEFAULTS[key])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary one is made on one machine, as in tests; on a cluster that is an error, as executors would
    each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    already = context._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="corvane-")
    context.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/corvane-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
