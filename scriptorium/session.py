"""A session with the settings this library is written for; any other session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, Arrow batches of bounded size, UTC. Cluster settings (memory, checkpoint folder) are left to the caller."""
    builder = SparkSession.builder.appName("scriptorium")
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        own["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (own | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
