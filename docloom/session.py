"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Old code pages (for example windows-31j) and replace-on-error decoding.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs several round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "docloom", cores: int | None = None, **extra: str) -> SparkSession:
    """Build a session. ``cores`` asks for a local master; on a cluster leave it unset.

    Only the local master sizes the shuffle by hand. A cluster keeps its own partition count,
    which adaptive execution then coalesces.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(SETTINGS)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
        settings["spark.sql.shuffle.partitions"] = str(cores)
        settings["spark.driver.memory"] = os.environ.get("DOCLOOM_LOCAL_MEMORY", "12g")
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
