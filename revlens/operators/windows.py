"""Window-based operators over already-aggregated (small) frames, plus the
keep-first / top-N operators that run on full-size data.

Skew note: every ``partitionBy`` here either runs after an aggregation (so a
partition holds at most one row per category / year / month) or is a
``row_number() <= N`` filter, which Spark plans as a partial
``WindowGroupLimit`` *before* the shuffle: a hot key is cut to N rows per
map task, so no task ever receives the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.rounding import round_ratio


def share_of_partition(df: DataFrame, count_col: str, partition: list[str],
                       out: str, k: int = 1) -> DataFrame:
    """``round(100 * n / sum(n) over (partition), k)`` on an aggregated frame."""
    w = Window.partitionBy(*partition)
    tot = f"_{out}_total"
    return (df.withColumn(tot, F.sum(count_col).over(w))
              .withColumn(out, round_ratio(count_col, tot, k, scale=100))
              .drop(tot))


def rank_within(df: DataFrame, partition: list[str], order: list[Column], out: str) -> DataFrame:
    """SQL ``RANK()`` (ties share a rank, gaps follow) as BIGINT."""
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return df.withColumn(out, F.rank().over(w).cast("long"))


def previous(col: str, partition: list[str], order: str) -> Column:
    """Value of ``col`` on the previous row (year gaps are bridged)."""
    return F.lag(col, 1).over(Window.partitionBy(*partition).orderBy(order))


def running_total(col: str, partition: list[str], order: str) -> Column:
    w = (Window.partitionBy(*partition).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.sum(col).over(w)


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                    rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per group in ``order`` (``order`` must be total for a
    deterministic result).  Planned as partial + final WindowGroupLimit."""
    w = Window.partitionBy(*group).orderBy(*order)
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)
