"""Reproducible sharding by a Feistel permutation of global row numbers.

Rows get numbers 0..n-1 in the order (id, CRC-32, XXH64 and size of the
text); a balanced Feistel network over the smallest even-bit domain that
holds n, walked along its cycle until it lands below n, permutes them.  The
permuted number p is at shard ``p mod shards``, slot ``p div shards``:
shard sizes differ by one row at most, slots have no gap, and ``locate`` /
``row_at`` compute either from the other without the data.

Defined cases: null text has size 8 and the checksum of no bytes; null ids
come first; equal rows are interchangeable; no rows give no rows.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import durable, shuffle_partitions

ROUNDS = 6
SEED = 20240229


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as the round function."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _half_bits(total: int) -> int:
    return max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)


def _round_keys(seed: int) -> list[int]:
    return [((seed * 2 + 1) * (2 * r + 3) * 0x2545F4914F6CDD1D) % 2**64 for r in range(ROUNDS)]


def _pass(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask, h = np.uint64(2**half - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << h) | right


def permute(numbers: np.ndarray, total: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..total-1 (or its inverse), with cycle walking."""
    half, keys = _half_bits(total), _round_keys(seed)
    out = _pass(np.asarray(numbers).astype(np.uint64), half, keys, back)
    while (far := out >= np.uint64(total)).any():
        out[far] = _pass(out[far], half, keys, back)
    return out.astype(np.int64)


def locate(row: int, total: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), total, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = SEED) -> int:
    """Row number at a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), total, seed, back=True)[0])


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` 0..n-1 in the given order.  A range
    partitioning sorts; only one count per partition leaves the executors.
    Rows equal in every order column are dealt out by their place, so a hot
    key does not meet in one task."""
    n = shuffle_partitions(rows.sparkSession)
    placed = durable(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)), "placed")
    ends = placed.groupBy("_part").agg((F.max("_pos") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row per partition of the sort
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn("row_number", F.col("_start") + F.col("_pos"))
            .drop("_part", "_pos", "_tie", "_start"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = SEED,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, shard, slot) of every row."""
    raw = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    facts = durable(docs.select(docs[id_col].alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"),
                                F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_h")), "facts")
    numbered = number_rows(facts, ["id", "text_crc32", "_h", "size"])
    total = facts.count()

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, seed))

    return (numbered.withColumn("_p", permuted("row_number"))
            .select("id", "size", "text_crc32", "row_number",
                    (F.col("_p") % shards).cast("int").alias("shard"),
                    F.expr(f"_p div {shards}").cast("long").alias("slot")))
