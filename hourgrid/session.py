"""Session settings the library is tuned for; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a hot join key is worth one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "hourgrid", **settings: str) -> SparkSession:
    """A session with SETTINGS where the cluster sets nothing, overridden by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark
