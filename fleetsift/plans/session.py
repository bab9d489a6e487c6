"""Session settings the plans count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime splitting of uneven joins and sizing of shuffles.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Unions of inputs that are dealt alike are not taken to be dealt alike: Spark 4.1 then leaves out needed shuffles.
    "spark.sql.unionOutputPartitioning": "false",
    # Results do not depend on where the job runs.
    "spark.sql.session.timeZone": "UTC",
    # File contents are large: small Arrow batches bound the memory of Python tasks.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def working_directory(spark: SparkSession, purpose: str) -> str:
    """A new directory in the shared folder that spark.checkpoint.dir names.  Only a local session may go
    without: on a cluster every executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="fleetsift-")
    return f"{base.rstrip('/')}/fleetsift-{purpose}-{uuid.uuid4().hex}"
