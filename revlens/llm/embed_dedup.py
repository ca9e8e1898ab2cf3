"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; its hash is the axis (with sign) it lies closest to.  ``HASHES``
turns make one of ``tables`` keys; each vector also enters the keys whose
axes are next closest (multiprobe).  Vectors that share a key are compared by
cosine in double precision.

Equal vectors are one class, so copies are one entry with a weight.  A bucket
of over ``block`` classes is cut into blocks, and pairs of blocks go to
different tasks; no task holds more than two blocks.  A pair that meets in
several buckets counts only in the first they share.  Tasks give each
class's number of links and a star per component, not pairs.

Defined cases: vectors that are null, zero, empty or hold a null or
non-finite component link with nothing; vectors of different lengths are
never compared; null ids are counted as links of others, have no component
and are kept; equal rows are copies of each other.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import durable, shuffle_partitions
from revlens.llm.components import components

COSINE = 0.95
TABLES = 12
HASHES = 2
#: For each probe, the rank of the axis taken from each hash.
PROBES = ((0, 0), (1, 0), (0, 1))
BLOCK = 4096
SEED = 11
ROUNDS = 3
#: Rows up to which the table of large buckets is broadcast.
SMALL_TABLE = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def keys(vectors: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """(row, table, probe) -> key."""
    n, d = vectors.shape
    width = 1 << max(1, (d - 1).bit_length())
    out = np.empty((n, tables, len(PROBES)), np.int64)
    for t in range(tables):
        ranked = []
        for k in range(HASHES):
            rng = np.random.default_rng([SEED, width, t, k])
            x = np.zeros((n, width))
            x[:, :d] = vectors
            for _ in range(ROUNDS):
                x = hadamard(x * rng.choice([-1.0, 1.0], width))
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2] if width > 2 else np.argsort(-np.abs(x), axis=1)[:, :2]
            size = np.take_along_axis(x, top, 1)
            order = np.argsort(-np.abs(size), axis=1, kind="stable")
            top, size = np.take_along_axis(top, order, 1), np.take_along_axis(size, order, 1)
            ranked.append(2 * top + (size < 0))
        for p, ranks in enumerate(PROBES):
            out[:, t, p] = sum(ranked[k][:, r] * (2 * width) ** k for k, r in enumerate(ranks))
    return out


def _raw(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, raw): the vector as doubles in binary, null where it is void."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column(1):
                v = v.as_py()
                if v is None or any(x is None for x in v):
                    made.append(None)
                    continue
                x = np.array(v, np.float64) + 0.0
                made.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "raw"])

    return vecs.select(vecs[id_col].cast("long").alias("id"), vecs[vec_col].cast("array<double>").alias("v")).mapInArrow(
        of, "id long, raw binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


ENTRY = "dim int, tab int, key long, node long, weight long, raw binary, all_keys binary"


def _entries(tables: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2).to_pylist()
            sizes = np.array([len(r) // 8 for r in raws])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(at), 1024):
                    part = at[lo:lo + 1024]
                    made = keys(_unit(np.stack([np.frombuffer(raws[i]) for i in part])), tables)
                    rows = [(dim, t, k, i, made[j].tobytes()) for j, i in enumerate(part.tolist())
                            for t in range(tables) for k in dict.fromkeys(made[j, t].tolist())]
                    take = pa.array([r[3] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                         pa.array([r[2] for r in rows], pa.int64()), batch.column(0).take(take), batch.column(1).take(take),
                         batch.column(2).take(take), pa.array([r[4] for r in rows], pa.binary())],
                        [x.split()[0] for x in ENTRY.split(", ")])
    return of


def _first_meeting(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, tab: int, key: int) -> np.ndarray:
    """Which pairs (i, j) share ``key`` in table ``tab`` before any other."""
    left = np.arange(len(i))
    for t in range(tab + 1):
        same = np.zeros(len(left), dtype=bool)
        for p in range(a.shape[2]):
            for q in range(b.shape[2]):
                x = a[i[left], t, p]
                same |= (x == b[j[left], t, q]) & ((x < key) if t == tab else True)
        left = left[~same]
    return left


def _star(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position in each position's component."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(rows: list[tuple], cosine: float, tables: int, tab: int, key: int) -> Iterator[tuple]:
    """(node, links, None) and (node, None, other node) of the pairs of one
    block, or of two (side 0 and side 1)."""
    side = np.array([r[0] for r in rows])
    nodes, weights = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = _unit(np.stack([np.frombuffer(r[3]) for r in rows]))
    met = np.stack([np.frombuffer(r[4], np.int64) for r in rows]).reshape(len(rows), tables, -1)
    two = (side == 1).any() and (side == 0).any()
    one, other = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(rows)),) * 2
    links, star_i, star_j = np.zeros(len(rows), np.int64), [], []
    for lo in range(0, len(one), 512):
        part = one[lo:lo + 512]
        i, j = np.nonzero(x[part] @ x[other].T >= cosine)
        i, j = part[i], other[j]
        if not two:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        star = _star(len(rows), i, j)
        star_i.append(np.flatnonzero(star != np.arange(len(rows))))
        star_j.append(star[star_i[-1]])
        new = _first_meeting(met, met, i, j, tab, key)
        links += np.bincount(i[new], weights[j[new]], len(rows)).astype(np.int64)
        links += np.bincount(j[new], weights[i[new]], len(rows)).astype(np.int64)
    for k in np.flatnonzero(links):
        yield int(nodes[k]), int(links[k]), None
    if star_i:
        star = _star(len(rows), np.concatenate(star_i), np.concatenate(star_j))
        for k in np.flatnonzero(star != np.arange(len(rows))):
            yield int(nodes[k]), None, int(nodes[star[k]])


def _buckets(cosine: float, tables: int):
    """Reads entries sorted by bucket and block pair."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []

        def close() -> list[tuple]:
            made = list(_compare(held, cosine, tables, open_key[1], open_key[2])) if len(held) > 1 else []
            held.clear()
            return made

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)],
                                              ["node", "links", "other"])

        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for *key, side, node, weight, raw, all_keys in zip(*columns):
                if key != open_key:
                    out += close()
                    open_key = key
                held.append((side, node, weight, raw, all_keys))
            if out:
                yield given(out)
        if made := close():
            yield given(made)
    return of


def near_duplicates(vecs: DataFrame, cosine: float = COSINE, tables: int = TABLES, block: int = BLOCK,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vecs.sparkSession
    rows = durable(_raw(vecs, id_col, vec_col), "vectors")
    classes = durable(rows.where("raw is not null").groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
                      .withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = durable(classes.select("node", "weight", "raw").mapInArrow(_entries(tables), ENTRY), "entries")
    bucket = ["dim", "tab", "key"]
    large = entries.groupBy(*bucket).count().where(F.col("count") > block).select(
        *bucket, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = durable(large, "large")
    if large.count() <= SMALL_TABLE:  # else the join is by key
        large = F.broadcast(large)
    # each entry of a large bucket meets every block, its own included
    dealt = entries.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*bucket, F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"),
                         (F.col("own") > F.col("with")).cast("int").alias("side"), "node", "weight", "raw", "all_keys")
    order = [*bucket, "low", "high"]
    met = dealt.repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = durable(met.mapInArrow(_buckets(cosine, tables), "node long, links long, other long"), "links")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("other is not null"), "node", "other")
    grouped = durable(
        classes.select("raw", "rep", "weight", "node").join(counts, "node", "left").join(parts, "node", "left")
        .select("raw", "rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "node").alias("component")), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.join(smallest, "component").select("raw", "n_links", "component_id")
    out = rows.join(named, "raw", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
