"""Shared helpers: durable intermediates and word splitting.

Words are maximal runs of characters other than space and ``\\t``..``\\r``
(0x09-0x0D).  On UTF-8 bytes that is exactly ``bytes.split()``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (tests) a fresh folder, set for the session."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="revlens-work-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps do not
    depend on executors that may be lost, and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``size`` bytes from now on, for steps whose
    rows are large: a task holds several batches at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, size)


def short_plans(spark: SparkSession, size: int = 1 << 16) -> None:
    """Descriptions of plans of at most ``size`` characters from now on, for
    plans with large literals: the driver keeps descriptions."""
    key = "spark.sql.maxPlanStringLength"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, size)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(text: bytes, cut: re.Pattern, size: int) -> Iterator[bytes]:
    """The text in slices of about ``size`` bytes that end before a match of
    ``cut``, a byte that separates words."""
    at = 0
    while at < len(text):
        found = cut.search(text, at + size) if at + size < len(text) else None
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
