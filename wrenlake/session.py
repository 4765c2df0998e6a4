"""A local session with the settings that tests and the benchmark use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("wrenlake")
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
