"""A session with the settings the library is written for; a cluster's own settings win where they are given."""

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """UTC, adaptive execution, ANSI arithmetic; ``partitions`` only for local runs, a cluster sets its own."""
    builder = SparkSession.builder.appName("plenum")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings | more).getOrCreate()
