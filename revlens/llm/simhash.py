"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is 64 bits: its words (A-Z lower-cased) make 3-word
shingles, repeats included; a bit is set if it is set in over half of the
shingles' XXH64 hashes (seed 42).  Fingerprints link at ``radius`` differing
bits or fewer.

Every bit position gets a non-zero vector of radius+1 bits; for each non-zero
vector v, a mask keeps the positions whose vector has an odd product with v.
The vectors of any ``radius`` positions leave some v orthogonal to all of
them, so two fingerprints that differ only there agree under that v's mask:
2^(radius+1) - 1 tables miss no pair.

Tables hold distinct fingerprints, so a group of copies is one entry.  A
bucket of over ``BUCKET`` fingerprints is dealt anew under a second set of
masks; two masks leave at most ~2^14 fingerprints to a bucket whatever the
corpus.  A bucket yields a star for each of its components, not its pairs;
the components of all buckets' stars are those of all links.

Defined cases: a null text or one without words has fingerprint 0 and links
like any other; a text of one or two words is one shingle; a null id gets a
fingerprint and no component; rows that share an id are one document (but not
to ``deduplicate``, which drops no text for its id); an empty table gives no
rows; the hashes of a very long text are counted ``CHUNK`` at a time.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import durable, shuffle_partitions
from revlens.llm.components import components

SHINGLE = 3
RADIUS = 3
BUCKET = 1024
SEED = 42
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    line, digest = b" ".join(ws), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(ws) - shingle + 1)
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(shingle, len(ws)) - 1:].tolist()
    bits = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k:k + CHUNK], ends[k:k + CHUNK])], np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, fp long")


def masks(radius: int, turn: int = 0) -> list[int]:
    """The covering masks; each ``turn`` deals the vectors out differently."""
    kinds = 2 ** (radius + 1) - 1
    order = np.random.default_rng(1000 + turn).permutation(64)
    vectors = [int(order[i]) % kinds + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() % 2) for v in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def stars(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(root, others) of each component of over one fingerprint, by position."""
    left = np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        found, front = [], np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for k in range(0, len(front), 64):
                near |= (np.bitwise_count(fps[front[k:k + 64], None] ^ fps[None, left]) <= radius).any(0)
            front, left = left[near], left[~near]
            found.append(front)
        if len(others := np.concatenate(found) if found else front[:0]):
            yield int(root), others


def _bucket_stars(radius: int, limit: int | None):
    """Reads rows (table, key, fp, rep) sorted by table and key.  Gives edges
    (a, b, null); members of buckets over ``limit`` as (rep, fp, table)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        open_key, n, large = None, 0, False

        def close(out: list[np.ndarray]) -> None:
            nonlocal held, n, large
            if n > 1 and not large:
                rows = np.concatenate(held)
                fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
                if n == 2:
                    if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius:
                        out.append(np.array([[rows[1, 3], rows[0, 3], -1]]))
                else:
                    for root, others in stars(fps, radius):
                        out.append(np.column_stack([rows[others, 3], np.full(len(others), rows[root, 3]),
                                                    np.full(len(others), -1)]))
            held, n, large = [], 0, False

        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy() for k in range(4)])
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            # whole buckets of one row inside the batch have no link
            bounds = np.concatenate([[0], cuts, [len(rows)]])
            out: list[np.ndarray] = []
            sizes = np.diff(bounds)
            wanted = np.flatnonzero(sizes > 1).tolist()
            for j in sorted({0, *wanted, len(sizes) - 1}) if len(rows) else ():
                part = rows[bounds[j]:bounds[j + 1]]
                if (key := (int(part[0, 0]), int(part[0, 1]))) != open_key:
                    close(out)
                    open_key = key
                n += len(part)
                if large or limit and n > limit:
                    out.extend(np.column_stack([x[:, 3], x[:, 2], x[:, 0]]) for x in (*held, part))
                    held, large = [], True
                else:
                    held.append(part)
            if out:
                made = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, k]) for k in range(3)], ["a", "b", "hot"])
        out = []
        close(out)
        if out:
            made = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, k]) for k in range(3)], ["a", "b", "hot"])
    return of


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the ``rep`` of distinct fingerprints (fp, rep)
    whose components are those of all pairs within ``radius`` bits."""
    n = shuffle_partitions(fps.sparkSession)

    def scan(rows: DataFrame, limit: int | None) -> DataFrame:
        ordered = rows.repartition(n, "table", "key").sortWithinPartitions("table", "key", "fp")
        return ordered.mapInArrow(_bucket_stars(radius, limit), "a long, b long, hot long")

    first, second = masks(radius), masks(radius, 1)
    tables = F.array(*(F.struct(F.lit(t).cast("long").alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for t, m in enumerate(first)))
    found = durable(scan(fps.select(F.explode(tables).alias("x"), "fp", "rep").select("x.*", "fp", "rep"), bucket), "buckets")
    hot = found.where("hot >= 0").select(F.col("a").alias("rep"), F.col("b").alias("fp"), "hot").distinct()
    finer = F.array(*(F.struct((F.col("hot") * len(second) + t).alias("table"), F.col("fp").bitwiseAND(
        F.element_at(F.array(*(F.lit(_signed(m | a)) for a in first)), (F.col("hot") + 1).cast("int"))).alias("key"))
        for t, m in enumerate(second)))
    again = scan(hot.select(F.explode(finer).alias("x"), "fp", "rep").select("x.*", "fp", "rep"), None)
    return found.where("hot < 0").select("a", "b").union(again.select("a", "b")).where("a <> b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; the component is the
    smallest id reachable by links."""
    marked = durable(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    fps = durable(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    same_id = (marked.where("id is not null").join(fps, "fp").where("id <> rep").select("id", "rep"))
    # rows that share an id join their fingerprints' groups
    doubled = marked.groupBy("id").agg(F.count_distinct("fp").alias("n")).where("n > 1 and id is not null")
    found = components(links(fps, radius).union(
        same_id.join(doubled, "id", "left_semi").toDF("a", "b")))
    classes = fps.join(found, fps["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "fp", "left").select(
        "id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of linked
    fingerprints: one with the smallest id (a null id is the largest), and of
    several texts under it the one with the smallest hash.  Rows that share an
    id but are not near stay both; null ids are compared like any other."""
    # a document is a text under an id; rows equal in both are copies
    key = F.xxhash64(docs[id_col], docs[text_col])
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("id"),
                        key.alias("key"))
    marked = durable(fingerprints(docs.select(key.alias("_key"), docs[text_col].alias("_text")), shingle, "_key", "_text")
                     .join(named.select(F.col("key").alias("id"), F.col("id").alias("doc")).distinct(), "id").distinct(),
                     "fingerprints")
    found = components(links(marked.select("fp", F.col("fp").alias("rep")).distinct(), radius))
    grouped = marked.join(found, marked["fp"] == found["node"], "left").withColumn("group", F.coalesce("component", "fp"))
    kept = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("first"))
    first = Window.partitionBy("key").orderBy("key")
    return (named.join(kept.select(F.col("first.id").alias("key")).distinct(), "key", "left_semi")
            .withColumn("_n", F.row_number().over(first)).where("_n = 1").select("row.*"))
