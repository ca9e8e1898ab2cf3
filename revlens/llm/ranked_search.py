"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

Terms are maximal runs of ASCII letters and digits and of all characters
beyond ASCII, with A-Z lower-cased.  For N documents with a term, L terms in
all, a document of n terms, and a term found tf times in it and in df
documents::

    weight    w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    length    m = 50 + (50 n N) div L
    impact    c = (1000000000 tf) div (1000 tf + 20 m)
    score       = sum of w c over the query's distinct terms

Index: each task turns its documents into segments of about ``SEGMENT`` bytes
of text, a row each: the terms, their document counts and largest impacts, and
their posting lists.  Lists of ``LONG`` postings and more are cut into blocks
of ``BLOCK``, compressed each, with the block's last document and largest
impact beside it.  Every document and every term is indexed; nothing is
shuffled.

Search: queries are taken in groups of at most ``GROUP_TERMS`` terms (a longer
query is a group of its own), which every segment meets.  In a segment a
query's lists stand by descending bound (weight times largest impact).  Lists
are essential, and read whole, as long as the bounds from there on can reach
the score of the k-th document found so far, in this task's earlier segments
too.  The others are only looked up for candidates: one that cannot reach that
score with the rest of the bounds is dropped, then one that cannot with the
largest impact of the block it would stand in, and only blocks with a
candidate left are decompressed.  What can tie is never dropped.  Each task
gives its k best documents of each query, which are merged in two steps.

Defined cases: a null or empty text has no terms, is in no list and counts
nowhere; an empty table of documents or of queries gives no rows; repeated
queries are ranked each on its own, whatever their ids; rows that share a
doc_id are documents each; null ids come last among equal scores.  Very long
texts are read in slices.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import durable, slices, work_dir

SEGMENT, LONG, BLOCK = 16_000_000, 128, 128
GROUP_TERMS = 200_000
#: First step of the merge: tasks' results meet in this many parts.
PARTS = 64
SLICE = 1 << 20

_TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in _TERM_BYTES)
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time."""
    for part in slices(text or b"", GAP, SLICE):
        yield part.translate(FOLD).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


# --- index ---------------------------------------------------------------

SEGMENT_SCHEMA = ("terms binary, dfs binary, most binary, ids binary, nulls binary, m binary, short_docs binary, "
                  "short_tfs binary, block_last binary, block_most binary, block_ends binary, blocks binary")
NAMES = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]


class _Builder:
    """The segment of some documents."""

    def __init__(self):
        self.number = defaultdict(count().__next__)
        self.ids, self.lengths, self.codes = [], [], []
        self.size = 0

    def add(self, doc: int | None, text: bytes | None) -> None:
        n = 0
        for found in terms(text):
            self.codes.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
            n += len(found)
        if n:
            self.ids.append(doc)
            self.lengths.append(n)
            self.size += len(text)

    def row(self, docs: int, length: int) -> pa.RecordBatch:
        """``docs`` and ``length``: N and L of the corpus."""
        n = len(self.ids)
        lengths = np.array(self.lengths, np.int64)
        m = 50 + 50 * lengths * docs // length
        pairs = np.concatenate(self.codes).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        pairs, tf = np.unique(pairs, return_counts=True)
        term, doc = pairs // n, pairs % n
        impact = impacts(tf, m[doc])
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        dfs = np.diff(np.r_[first, len(term)])
        is_long = np.repeat(dfs >= LONG, dfs)
        last, most, ends, blocks, done = [], [], [], [], 0
        for start, df in zip(first[dfs >= LONG].tolist(), dfs[dfs >= LONG].tolist()):
            for a in range(start, start + df, BLOCK):
                b = min(a + BLOCK, start + df)
                blocks.append(zlib.compress(np.diff(doc[a:b], prepend=0).astype("<u4").tobytes()
                                            + tf[a:b].astype("<u4").tobytes(), 1))
                done += len(blocks[-1])
                last.append(doc[b - 1])
                most.append(impact[a:b].max())
                ends.append(done)
        held = {
            "terms": b" ".join(self.number), "dfs": dfs.astype("<u4"), "most": np.maximum.reduceat(impact, first).astype("<u4"),
            "ids": np.array([x or 0 for x in self.ids], "<i8"), "nulls": np.array([x is None for x in self.ids], "u1"),
            "m": m.astype("<i8"), "short_docs": doc[~is_long].astype("<u4"), "short_tfs": tf[~is_long].astype("<u4"),
            "block_last": np.array(last, "<u4"), "block_most": np.array(most, "<u4"), "block_ends": np.array(ends, "<u8"),
            "blocks": b"".join(blocks)}
        return pa.RecordBatch.from_arrays(
            [pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for v in held.values()], list(held))


@dataclass
class Index:
    """Where the segments are, and the corpus' counts."""
    spark: SparkSession
    path: str
    docs: int
    length: int

    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT_SCHEMA).parquet(self.path)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> Index:
    """The index of all rows, written to the shared folder."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            for text in batch.column(0):
                if found := sum(map(len, terms(text.as_py()))):
                    n, length = n + 1, length + found
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["n", "length"])

    n, length = rows.select("text").mapInArrow(tally, "n long, length long").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Builder()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                now.add(doc, text.as_py())
                if now.size >= segment:
                    yield now.row(n, length)
                    now = _Builder()
        if now.ids:
            yield now.row(n, length)

    path = f"{work_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    # a row is large: look at a row group's size after each
    (rows.mapInArrow(build, SEGMENT_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 32 << 20)
     .option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(path))
    return Index(docs.sparkSession, path, n, length)


# --- search --------------------------------------------------------------

class _Segment:
    """A segment's lists, decompressed where asked for."""

    def __init__(self, row: dict[str, bytes]):
        def numbers(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row[name], kind)
        self.number = {t: k for k, t in enumerate(row["terms"].split(b" "))}
        self.dfs, self.most = numbers("dfs", "<u4").astype(np.int64), numbers("most", "<u4")
        self.ids, self.nulls, self.m = numbers("ids", "<i8"), numbers("nulls", "u1"), numbers("m", "<i8")
        self.short_docs, self.short_tfs = numbers("short_docs", "<u4"), numbers("short_tfs", "<u4")
        self.block_last, self.block_most = numbers("block_last", "<u4"), numbers("block_most", "<u4")
        self.block_ends, self.blocks = numbers("block_ends", "<u8").tolist(), row["blocks"]
        is_long = self.dfs >= LONG
        self.first_short = np.cumsum(np.where(is_long, 0, self.dfs)) - np.where(is_long, 0, self.dfs)
        per_list = np.where(is_long, -(-self.dfs // BLOCK), 0)
        self.first_block, self.n_blocks = np.cumsum(per_list) - per_list, per_list
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.held:
            raw = zlib.decompress(self.blocks[self.block_ends[b - 1] if b else 0:self.block_ends[b]])
            gaps, tf = np.frombuffer(raw, "<u4").astype(np.int64).reshape(2, -1)
            docs = np.cumsum(gaps)
            self.held[b] = docs, impacts(tf, self.m[docs])
        return self.held[b]

    def joined(self, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(b) for b in blocks]
        return np.concatenate([d for d, _ in found]), np.concatenate([c for _, c in found])

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a whole list."""
        if self.n_blocks[t]:
            return self.joined(range(self.first_block[t], self.first_block[t] + self.n_blocks[t]))
        at = slice(self.first_short[t], self.first_short[t] + self.dfs[t])
        docs = self.short_docs[at].astype(np.int64)
        return docs, impacts(self.short_tfs[at].astype(np.int64), self.m[docs])

    def block_of(self, t: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of a long list in which each document would stand, and
        its largest impact (0 past the end)."""
        a, n = self.first_block[t], self.n_blocks[t]
        at = np.searchsorted(self.block_last[a:a + n], docs)
        inside = at < n
        b = a + np.minimum(at, n - 1)
        return b, np.where(inside, self.block_most[b], 0)


def _look_up(docs: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted documents; 0 for those not in the list."""
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, values[at], 0)


def _kth(scores: np.ndarray, k: int, least: int) -> int:
    """A score that k documents reach, or ``least`` if that is more."""
    return max(least, int(np.partition(scores, -k)[-k])) if len(scores) >= k else least


class Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.zeros((3, 0), np.int64)  # score, null id, id
        self.least = 1

    def offer(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, [scores, nulls, ids]], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[:self.k]]
        if self.rows.shape[1] == self.k:
            self.least = max(self.least, int(self.rows[0, -1]))


def search_segment(segment: _Segment, query: list[tuple[bytes, int]], best: Best, partial: np.ndarray) -> None:
    """Offers the segment's documents that may be among the query's best.
    ``partial``: zeros, one for each document of the segment; left so."""
    lists = []
    for term, weight in query:
        t = segment.number.get(term)
        if t is not None and weight:
            lists.append((weight * int(segment.most[t]), weight, t))
    lists.sort(key=lambda x: (-x[0], x[2]))
    rest = [0] * (len(lists) + 1)  # what the lists from here on can add
    for k in range(len(lists) - 1, -1, -1):
        rest[k] = rest[k + 1] + lists[k][0]
    least, k = best.least, 0
    while k < len(lists) and rest[k] >= least:
        _, weight, t = lists[k]
        docs, c = segment.postings(t)
        partial[docs] += weight * c
        least = _kth(partial[docs], best.k, least)
        k += 1
    found = np.flatnonzero(partial)
    scores = partial[found]
    partial[found] = 0
    for (bound, weight, t), after in zip(lists[k:], rest[k + 1:]):
        may = scores + bound + after >= least
        found, scores = found[may], scores[may]
        if not len(found):
            return
        if segment.n_blocks[t]:
            block, most = segment.block_of(t, found)
            may = scores + weight * most.astype(np.int64) + after >= least
            found, scores, read = found[may], scores[may], np.unique(block[may & (most > 0)])
            if not len(read):
                continue
            docs, c = segment.joined(read.tolist())
        else:
            docs, c = segment.postings(t)
        scores = scores + weight * _look_up(docs, c, found)
        least = _kth(scores, best.k, least)
    may = scores >= least
    if may.any():
        found = found[may]
        best.offer(scores[may], segment.nulls[found].astype(np.int64), segment.ids[found])


def _query_blocks(queries: DataFrame, id_col: str, text_col: str, group_terms: int) -> DataFrame:
    """Queries in rows of at most ``group_terms`` terms (but for a longer
    query): (n_terms, items, texts), a text being its distinct terms."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, texts, n = [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([items], pa.list_(pa.int64())),
                                               pa.array([texts], pa.list_(pa.binary()))], ["n_terms", "items", "texts"])
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                distinct = sorted(set().union(*terms(text.as_py())))
                if items and n + len(distinct) > group_terms:
                    yield made()
                    items, texts, n = [], [], 0
                if distinct:
                    items.append(item)
                    texts.append(b" ".join(distinct))
                    n += len(distinct)
        if items:
            yield made()

    rows = queries.select(queries[id_col].cast("long").alias("id"), queries[text_col].cast("binary").alias("text"))
    made = rows.mapInArrow(of, "n_terms long, items array<long>, texts array<binary>")
    return durable(made.withColumn("block", F.monotonically_increasing_id()), "queries")


def _groups(blocks: DataFrame, group_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(id, terms) of the queries of each group."""
    held, n = [], 0
    told = [tuple(r) for r in blocks.select("block", "n_terms").orderBy("block").collect()]  # two numbers a block
    for k, (block, size) in enumerate(told):
        held.append(block)
        n += size
        if k + 1 == len(told) or n + told[k + 1][1] > group_terms:
            rows = blocks.where(F.col("block").isin(held)).orderBy("block").collect()  # at most group_terms terms
            yield [(i, bytes(t).split(b" ")) for r in rows for i, t in zip(r["items"], r["texts"])]
            held, n = [], 0


def _weights(index: Index, wanted: set[bytes]) -> dict[bytes, int]:
    """The weight of each wanted term that some document holds."""
    sent = index.spark.sparkContext.broadcast(wanted)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, dfs in zip(batch.column(0), batch.column(1)):
                found = [(t, df) for t, df in zip(held.as_py().split(b" "), np.frombuffer(dfs.as_py(), "<u4").tolist())
                         if t in sent.value]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.binary()),
                                                  pa.array([df for _, df in found], pa.int64())], ["term", "df"])

    counts = index.segments().select("terms", "dfs").mapInArrow(of, "term binary, df long").groupBy("term").agg(
        F.sum("df").alias("df")).collect()  # a row for each wanted term at most
    return {bytes(t): math.floor(1000 * math.log((2 * index.docs + 2) / (2 * df + 1))) for t, df in counts}


def _search_group(index: Index, group: list[tuple[int | None, list[bytes]]], k: int, base: int) -> DataFrame:
    """(query, item, null, id, score): each task's best of every query."""
    weights = _weights(index, set().union(*(ts for _, ts in group)))
    sent = index.spark.sparkContext.broadcast(
        [(item, [(t, weights[t]) for t in ts if weights.get(t)]) for item, ts in group])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value]
        for batch in batches:
            for r in range(len(batch)):
                segment = _Segment({n: batch.column(c)[r].as_py() for c, n in enumerate(NAMES)})
                partial = np.zeros(len(segment.ids), np.int64)
                for (_, query), kept in zip(sent.value, best):
                    search_segment(segment, query, kept, partial)
        for q, ((item, _), kept) in enumerate(zip(sent.value, best)):
            scores, nulls, ids = kept.rows
            n = len(scores)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + q] * n, pa.int64()), pa.array([item] * n, pa.int64()),
                 pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(scores, pa.int64())],
                ["query", "item_id", "doc_id", "score"])

    return index.segments().mapInArrow(of, "query long, item_id long, doc_id long, score long")


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    ordered = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text",
           group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents with
    a score above 0."""
    found, base = None, 0
    for group in _groups(_query_blocks(queries, id_col, text_col, group_terms), group_terms):
        rows = _search_group(index, group, k, base).withColumn("_part", F.spark_partition_id() % PARTS)
        rows = durable(_top(_top(rows, ["query", "_part"], k), ["query"], k).select("item_id", "rank", "doc_id", "score"),
                       "found")
        found, base = rows if found is None else found.union(rows), base + len(group)
    if found is None:
        return index.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
