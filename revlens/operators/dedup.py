"""Deduplication and union operators.

``dedup_first`` keeps, per key, the first row in a given total order.  It is
``row_number() == 1``, which Spark plans as a partial WindowGroupLimit
before the shuffle (each map task forwards at most one row per key) and a
final one after it.  A key holding a third of all rows therefore costs one
row per map task on the wire, not a third of the data in one task.
(``dropDuplicates`` would keep an arbitrary row.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dedup_first(df: DataFrame, key: list[str], order: list, collation: str | None = None) -> DataFrame:
    """Keep the first row per ``key`` in ``order`` (ascending, NULLs first
    unless the Column says otherwise).  NULL keys form one group.  With a
    ``collation`` (such as ``UTF8_LCASE``) keys of text are compared by it."""
    by = [F.collate(k, collation) if collation and isinstance(df.schema[k].dataType, StringType) else F.col(k) for k in key]
    w = Window.partitionBy(*by).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup_first_by_rank(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Keep every row whose ``rank`` equals the key's minimum rank (all rows
    of the first-ranked group survive, e.g. duplicates inside the first
    feed query).  NULL keys form one group, as in ``dedup_first``.  The
    minimum is a map-side-combined aggregate; the join back is a null-safe
    semi join on (key, rank), where AQE splits a hot key."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(rank).alias("_rank"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col(rank) == F.col("_rank")), "left_semi")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
