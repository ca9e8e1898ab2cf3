"""URL rules backed by a Bloom filter cascade of listed hosts.

The longest rule that fits a URL decides.  Other URLs go by their host: a
cascade of Bloom filters holds the listed hosts exactly over the corpus's
complete set of hosts.  Level 1 encodes the listed hosts; level 2 the
unlisted ones that pass level 1; level 3 the listed ones that pass level 2;
and so on until no false positive is left.  A host is listed if the first
level that misses it is an even one (or none misses it and the last level is
odd).  Hosts are dealt into shards by hash, each with a cascade of bounded
size, built in one task per shard.

The cascade is broadcast behind a check of its measured size
(``max_broadcast_bytes``).  Beyond it, pages are dealt to their host's shard,
each shard in as many parts as a shuffle has partitions, so that no host is one
task; a part reads its shard's cascade first and then probes its pages as they
come.

Defined cases: a null URL or one without ``://`` has an empty host and path;
the empty host is a key like any other; an empty table gives no rows; null and
repeated ids are judged each on its own; a very long URL is one string.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import durable, shuffle_partitions

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS_PER_SHARD = 50_000
MAX_LEVELS = 64
MAX_BROADCAST_BYTES = 32 * 1024 * 1024

LEVELS_SCHEMA = "shard long, level int, bits long, hashes int, words binary"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _probes(h1: np.ndarray, h2: np.ndarray, level, hashes, bits) -> Iterator[np.ndarray]:
    """Bit positions by double hashing; each level starts elsewhere."""
    with np.errstate(over="ignore"):
        a = (h1 ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(level))) * np.uint64(0xD6E8FEB86659FD93)
        a ^= a >> np.uint64(32)
        step = h2 | np.uint64(1)
        for j in range(hashes):
            x = a + step * np.uint64(j)
            yield (x ^ (x >> np.uint64(31))) % bits


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, hashes, bit string) of each level for one shard's keys."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, int, bytes]] = []
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * len(inside) / max(1, len(outside))))
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise ValueError("two hosts with equal 128-bit hashes")
        bits = 64 * math.ceil((len(inside) * -math.log(rate) / math.log(2) ** 2 + 64) / 64)
        hashes = max(1, round(bits / len(inside) * math.log(2))) if len(inside) > 8 else 2
        hashes = min(hashes, 32)
        table = np.zeros(bits, dtype=bool)
        level = len(levels) + 1
        for at in _probes(h1[inside], h2[inside], level, hashes, np.uint64(bits)):
            table[at] = True
        levels.append((bits, hashes, np.packbits(table, bitorder="little").tobytes()))
        passed = np.ones(len(outside), dtype=bool)
        for at in _probes(h1[outside], h2[outside], level, hashes, np.uint64(bits)):
            passed &= table[at]
        inside, outside, rate = outside[passed], inside, 0.5
    return levels


def build_cascade(keys: DataFrame, shards: int) -> DataFrame:
    """Cascade rows from (h1, h2, listed), one row per distinct key."""
    def of_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_levels(pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64),
                            pdf["listed"].to_numpy(bool))
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), i + 1, *x) for i, x in enumerate(made)],
                            columns=["shard", "level", "bits", "hashes", "words"])

    return (keys.withColumn("shard", F.expr(f"pmod(h1, {shards}L)"))
            .groupBy("shard").applyInPandas(of_shard, LEVELS_SCHEMA))


class Cascade:
    """All shards' levels, for vectorised lookups."""

    def __init__(self, rows, shards: int):
        self.shards, self.levels = shards, {}
        for r in rows:
            table = np.unpackbits(np.frombuffer(r["words"], np.uint8), bitorder="little").view(bool)
            self.levels[r["shard"], r["level"]] = (r["bits"], r["hashes"], np.packbits(table, bitorder="little"))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """True for each listed key; keys must belong to the universe."""
        out = np.zeros(len(h1), dtype=bool)
        shard = (h1.view(np.int64) % self.shards).astype(np.int64)
        for s in np.unique(shard):
            left, level = np.flatnonzero(shard == s), 1
            while len(left) and (found := self.levels.get((int(s), level))):
                bits, hashes, packed = found
                hit = np.ones(len(left), dtype=bool)
                for at in _probes(h1[left], h2[left], level, hashes, np.uint64(bits)):
                    hit &= (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                left, level = left[hit], level + 1
                out[left] = level % 2 == 0  # passed an odd level last
        return out


def listed_by_rules(judged: DataFrame) -> DataFrame:
    """(host, listed) of every host: listed where the rules block more of its
    pages than they allow."""
    return judged.groupBy("host").agg(
        (F.count(F.when(F.col("ruled") == "block", 1)) > F.count(F.when(F.col("ruled") == "allow", 1))).alias("listed"))


PAGE = "id long, host string, path string, rule string, ruled string, listed boolean"


def _probe_by_shard(rows: DataFrame, cascade: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``listed``: the levels and the pages of each part of a
    shard come to one task, levels first."""
    parts = shuffle_partitions(rows.sparkSession)
    columns = [c.split()[0] for c in PAGE.split(", ")][:-1]
    pages = rows.select("*", F.xxhash64("host").alias("h1"), F.xxhash64(F.lit("second"), "host").alias("h2")).select(
        "*", F.expr(f"pmod(h1, {shards}L)").alias("shard"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"))
    levels = cascade.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("is_level", F.lit(True))
    both = levels.unionByName(pages.withColumn("is_level", F.lit(False)), allowMissingColumns=True)
    met = both.repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", F.desc("is_level"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, opened = None, [], None
        for batch in batches:
            def numbers(name: str) -> np.ndarray:
                return batch.column(name).fill_null(0).to_numpy()
            shard, part, is_level = numbers("shard"), numbers("part"), batch.column("is_level").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
            for at in np.split(np.arange(len(batch)), new):
                if not len(at):
                    continue
                if (key := (int(shard[at[0]]), int(part[at[0]]))) != now:
                    now, held, opened = key, [], None
                level, page = at[is_level[at]], at[~is_level[at]]
                held += batch.select(["shard", "level", "bits", "hashes", "words"]).take(pa.array(level)).to_pylist()
                if len(page):
                    opened = opened or Cascade(held, shards)
                    h1, h2 = (numbers(c)[page].view(np.uint64) for c in ("h1", "h2"))
                    kept = batch.select(columns).take(pa.array(page))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(opened.contains(h1, h2))], [*columns, "listed"])

    return met.mapInArrow(of, PAGE)


def filter_urls(pages: DataFrame, hosts: DataFrame | None = None, rules=RULES, id_col: str = "page_id",
                url_col: str = "url", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.  ``hosts`` (host,
    listed) covers every host of the pages; by default ``listed_by_rules``."""
    host, path = parse(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rule, ruled = decide(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    keys = (hosts if hosts is not None else listed_by_rules(rows)).select(
        "host", F.xxhash64("host").alias("h1"), F.xxhash64(F.lit("second"), "host").alias("h2"), "listed")
    keys = durable(keys, "hosts")
    shards = max(1, math.ceil(keys.count() / KEYS_PER_SHARD))
    cascade = durable(build_cascade(keys.select("h1", "h2", "listed"), shards), "cascade")
    held = cascade.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if held <= max_broadcast_bytes:
        sent = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in cascade.collect()])
        opened: dict = {}

        @F.pandas_udf("boolean")
        def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
            if not opened:
                opened["cascade"] = Cascade(sent.value, shards)
            return pd.Series(opened["cascade"].contains(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

        found = rows.withColumn("listed", listed(F.xxhash64("host"), F.xxhash64(F.lit("second"), "host")))
    else:
        found = _probe_by_shard(rows, cascade, shards)
    return found.select("id", "host", "path", "rule",
                        F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
