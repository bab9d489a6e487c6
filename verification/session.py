"""A local session for checks and benchmarks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str, cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
