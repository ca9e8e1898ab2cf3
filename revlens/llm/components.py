"""Connected components of a graph given by its edges, on executors only.

Each task first contracts the edges it holds with a union-find (in bounded
batches), then rounds of large-star and small-star steps hang every node
under the smallest node it reaches, until all edges are stars.  Rounds are
written to the shared folder; only a count of nodes reaches the driver.  A node with very many
edges is pre-aggregated before the shuffle and split in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import durable

#: Edges that a task contracts at a time.
CONTRACT = 1_000_000


def contract(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A star for each component of the pairs: (node, smallest node)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root) for x in list(parent) if (root := find(x)) != x]


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        made = contract(iter(held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if len(held) >= CONTRACT:
            yield flush()
    if held:
        yield flush()


def _stars(edges: DataFrame) -> bool:
    """Whether each node is under one other, which is under none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
    return not seen.where("under > 1 or under = 1 and over = 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; the
    component is its smallest node.  Edges with a null end are ignored."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    # every edge is (node, smaller node)
    now = durable(edges.mapInArrow(_contract_batches, "a long, b long"), "edges")
    while not _stars(now):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select("u", "m")).distinct()
        now = durable(small, "edges")
    return now.toDF("node", "component")
