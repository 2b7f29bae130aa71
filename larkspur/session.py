"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the package wherever the driver runs.

    On a cluster the package is installed on the executors, or shipped with --py-files.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _HOME])


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("larkspur")
    settings = {
        "spark.sql.shuffle.partitions": str(max(cores, 1)),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_importable(spark)
    return spark
