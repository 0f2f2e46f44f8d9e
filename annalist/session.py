"""A local Spark session with the settings this library is developed with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on ``local[cpus]``; on a cluster, make your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("annalist")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
