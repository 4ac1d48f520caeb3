"""Session settings and table access shared by every query."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tessera", cores: str | None = None) -> SparkSession:
    """A session for local work; on a cluster the submitter's settings win."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def work_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir. Where that is unset, local mode
    takes a folder of its own (as in tests); a cluster has none, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return f"{found.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new work folder and read again: what several steps read is computed and shuffled once."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
