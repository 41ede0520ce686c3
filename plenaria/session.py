"""SparkSession factory with the settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "plenaria", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE; ``master`` is only set where none is given by the environment.

    ``spark.sql.shuffle.partitions`` is left to the cluster's own setting unless passed: AQE
    coalesces from above, so a high initial number is the right default at scale.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local(threads: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    n = threads or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return build(
        master=f"local[{n}]",
        **{
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.driver.memory": os.environ.get("PLENARIA_DRIVER_MEMORY", "6g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
