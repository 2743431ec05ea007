"""A Spark session with the settings this library is written for."""

import os
import tempfile

from pyspark.sql import SparkSession


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )


def local_session(cpus: str | None = None) -> SparkSession:
    """Single-machine session for tests and measurements; its intermediate tables lie in the machine's temporary folder."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stallbook")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}")
        .config("spark.log.level", "ERROR")
    )
    return configured(builder).getOrCreate()
