"""Session factory with the settings the pipelines are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "shelfwise",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Create a session.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit command names the master, and
    adaptive execution starts from a high partition number and merges small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        settings["spark.ui.enabled"] = "false"
        settings["spark.driver.memory"] = os.environ.get("SHELFWISE_DRIVER_MEMORY", "8g")
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
