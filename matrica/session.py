"""Session builder: the settings every plan in this package assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "matrica", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow; ``master`` None keeps spark-submit's choice."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.driver.memory", os.environ.get("MATRICA_DRIVER_MEMORY", "12g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
