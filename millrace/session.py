"""Session settings shared by the tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, driver_memory: str = "8g", extra: dict[str, str] | None = None) -> SparkSession:
    """A UTC, ANSI, adaptive session. `extra` overrides any setting."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": driver_memory,
        "spark.scheduler.mode": "FAIR",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | (extra or {})
    builder = SparkSession.builder.master(master).appName("millrace")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
