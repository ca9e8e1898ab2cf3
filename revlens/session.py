"""Spark session with the settings the reports rely on.

- UTC session time zone (review and reply timestamps are UTC).
- ANSI mode stays on; dirty input goes through ``try_*`` functions.
- AQE on, with skew-join splitting and partition coalescing, so a hot app /
  source / key is split at runtime instead of landing in one task.
- The UI stays off.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.filterPushdown": "true",
}

# Joins broadcast a side only when its *measured* size (AQE runtime
# statistics of a materialized shuffle) is under the cap; static estimates
# (which count a string as 20 bytes) never trigger a broadcast.  Above the
# cap the sort-merge join stays, with AQE splitting skewed partitions.
JOIN_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "revlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  A master is set only when given, so a
    ``spark-submit`` keeps its own (plain ``python`` defaults to local)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {**DEFAULTS, **JOIN_CONF}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Settings that can be changed on an existing session (the driver hands
    us its own session, so reports set what they depend on here)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, v in JOIN_CONF.items():
        spark.conf.set(k, v)
