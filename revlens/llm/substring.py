"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash
of ``GRAM`` consecutive words in it; equal windows have equal minimisers.
Consecutive windows that share a minimiser form a super-k-mer, which travels
as one packed string (its words joined by spaces) to the minimiser's bucket;
there the windows of all strings are sorted, and each distinct window gets
the smallest id of a document it stands in.

Only minimisers that occur in two documents or more travel with text: first
their hashes alone are counted.  Equal strings are combined before the
shuffle, so copies are one entry.  A bucket of over ``BUCKET`` different
strings (a passage common to very many documents, in different contexts) is
dealt out by window instead, each window under two 64-bit hashes.

Words are those of ``common``; hashes only choose buckets, and the words
themselves are compared, but for the windows of such large buckets.

Defined cases: a null text has no words; rows with a null id keep all words
and take none from others; rows with equal id and text are treated alike, and
rows that share an id never remove each other's words.  Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import durable, shuffle_partitions

WINDOW = 50
GRAM = 8
BUCKET = 2000
#: Windows to a super-k-mer at most (more share one only in periodic text).
RUN = 256
#: Words hashed at a time.
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: polynomial in its bytes, from prefix sums
    of the joined words."""
    out = [np.zeros(0, np.uint64)]
    back = np.uint64(pow(BASE, -1, 2**64))
    for k in range(0, len(ws), SLICE):
        part = ws[k:k + SLICE]
        raw = np.frombuffer(b" ".join(part), np.uint8).astype(np.uint64) + np.uint64(1)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        powers = np.cumprod(np.full(len(raw) + 1, BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * powers[:-1])])
        undo = np.cumprod(np.full(len(raw) + 1, back, np.uint64))
        out.append(_mix((sums[ends] - sums[starts]) * undo[starts] + lengths.astype(np.uint64)))
    return np.concatenate(out)


def super_kmers(ws: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer."""
    n = len(ws) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(gram, window)
    h = word_hashes(ws)
    grams = np.zeros(len(ws) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(BASE) + h[j:j + len(grams)]
    low, wide, width = _mix(grams), 1, window - gram + 1
    while wide * 2 <= width:
        low, wide = np.minimum(low[:-wide], low[wide:]), wide * 2
    if wide < width:
        low = np.minimum(low[:n], low[width - wide:width - wide + n])
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    sizes = np.diff(np.append(starts, n))
    if sizes.max() > RUN:  # cut long runs
        parts = -(-sizes // RUN)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        inner = np.arange(int(parts.sum())) - first
        starts, sizes = np.repeat(starts, parts) + inner * RUN, np.minimum(RUN, np.repeat(sizes, parts) - inner * RUN)
    return low[starts].view(np.int64), starts, sizes


def _scan(window: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, parts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                if raw:
                    made = super_kmers(raw.split(), window, gram)
                    if len(made[0]):
                        ids.append(np.full(len(made[0]), doc))
                        marks.append(np.full(len(made[0]), xxhash.xxh64_intdigest(raw, 42), np.uint64))
                        parts.append(made)
            if ids:
                columns = [np.concatenate(ids), np.concatenate(marks).view(np.int64)] + [
                    np.concatenate([p[k] for p in parts]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["id", "mark", "mini", "start", "n"])
    return of


def _strings(window: int):
    """The packed strings of each document's shared super-k-mers."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, text, parts in zip(*(batch.column(k) for k in range(4))):
                ws, rows = text.as_py().split(), []
                for p in parts.as_py():
                    packed = b" ".join(ws[p["start"]:p["start"] + p["n"] + window - 1])
                    rows.append((p["mini"], p["start"], packed, hashlib.md5(packed).digest()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(rows), pa.int64()), pa.array([mark.as_py()] * len(rows), pa.int64()),
                     pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                    ["id", "mark", "mini", "start", "packed", "name"])
    return of


def _windows(packed: bytes, window: int) -> list[bytes]:
    ws = packed.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [packed[a:b] for a, b in zip(starts, ends[window - 1:].tolist())]


def sort_windows(strings: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """For each (string, id), the smallest id of a string with each window."""
    out = [[low] * 0 for _, low in strings]
    rows = []
    for s, (packed, low) in enumerate(strings):
        made = _windows(packed, window)
        out[s] = [0] * len(made)
        rows.extend((w, low, s, k) for k, w in enumerate(made))
    rows.sort()
    for _, same in groupby(rows, key=lambda r: r[0]):
        low = None
        for _, first, s, k in same:
            low = first if low is None else low
            out[s][k] = low
    return out


def _judge(window: int):
    """Reads distinct strings (mini, name, packed, low) sorted by mini; gives
    (mini, name, off, n, low): from window ``off``, ``n`` windows whose
    smallest id is ``low``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []

        def close(out: list[tuple]) -> None:
            if len(held) == 1:  # all its windows stand in the same documents
                found = [None]
            else:
                found = sort_windows([(packed, low) for _, packed, low in held], window)
            for (name, packed, low), lows in zip(held, found):
                if lows is None:
                    out.append((open_key, name, 0, packed.count(b" ") + 2 - window, low))
                    continue
                at = 0
                for value, same in groupby(lows):
                    n = len(list(same))
                    out.append((open_key, name, at, n, value))
                    at += n
            held.clear()

        def given(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)],
                                              ["mini", "name", "off", "n", "low"])

        for batch in batches:
            out: list[tuple] = []
            for mini, name, packed, low in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if mini != open_key:
                    close(out)
                    open_key = mini
                held.append((name, packed, low))
            if out:
                yield given(out)
        out = []
        close(out)
        if out:
            yield given(out)
    return of


def _explode_windows(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mini, name, packed, low in zip(*(batch.column(k).to_pylist() for k in range(4))):
                made = _windows(packed, window)
                pair = [np.array([xxhash.xxh64_intdigest(w, seed) for w in made], np.uint64).view(np.int64) for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mini] * len(made), pa.int64()), pa.array([name] * len(made), pa.binary()),
                     pa.array(range(len(made)), pa.int64()), pa.array([low] * len(made), pa.int64()),
                     pa.array(pair[0]), pa.array(pair[1])], ["mini", "name", "off", "low", "h1", "h2"])
    return of


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """(id, mark, spans): for ``docs`` (id, text as binary), the word spans
    (start, length) covered by windows that also start in a document with a
    smaller id.  ``mark`` is the text's XXH64."""
    spark = docs.sparkSession
    docs = docs.where("id is not null and text is not null")
    parts = durable(docs.mapInArrow(_scan(window, gram), "id long, mark long, mini long, start long, n long"), "parts")
    shared = parts.groupBy("mini").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("mini")
    wanted = parts.join(shared, "mini").groupBy("id", "mark").agg(
        F.collect_set(F.struct("mini", "start", "n")).alias("parts"))  # of one text
    marked = docs.withColumn("mark", F.xxhash64("text"))
    at = durable(marked.join(wanted, ["id", "mark"]).select("id", "mark", "text", "parts").mapInArrow(
        _strings(window), "id long, mark long, mini long, start long, packed binary, name binary"), "strings")
    # copies are combined before the shuffle
    strings = durable(at.groupBy("mini", "name", "packed").agg(F.min("id").alias("low")), "distinct")
    sizes = strings.groupBy("mini").count()
    large = durable(sizes.where(F.col("count") > bucket).select("mini", F.lit(1).alias("large")), "large")
    if large.isEmpty():
        small, hot = strings, None
    else:
        small = strings.join(large, "mini", "left_anti")
        hot = strings.join(large, "mini", "left_semi")
    # dealt by a hash of the key: dealing by the key itself could be merged into
    # the join above, whose partitions may be rearranged at run time
    ordered = (small.select("mini", "name", "packed", "low", F.xxhash64("mini").alias("deal"))
               .repartition(shuffle_partitions(spark), "deal").sortWithinPartitions("deal", "mini"))
    judged = ordered.mapInArrow(_judge(window), "mini long, name binary, off long, n long, low long")
    if hot is not None:
        rows = hot.select("mini", "name", "packed", "low").mapInArrow(
            _explode_windows(window), "mini long, name binary, off long, low long, h1 long, h2 long")
        rows = durable(rows, "windows")
        lowest = rows.groupBy("h1", "h2").agg(F.min("low").alias("low"))
        judged = judged.unionByName(rows.drop("low").join(lowest, ["h1", "h2"]).select(
            "mini", "name", "off", F.lit(1).cast("long").alias("n"), "low"))
    found = at.drop("packed").join(judged, ["mini", "name"]).where("id > low")
    return found.groupBy("id", "mark").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("off")).alias("start"), (F.col("n") + window - 1).alias("length"))).alias("spans"))


def _cut(names: list[str], at: int):
    """Applies the spans in the last column to the text in column ``at``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(at), batch.column(len(names))):
                ws = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                counts.append(len(ws))
                if spans.is_valid:
                    gone = np.zeros(len(ws) + 1, np.int64)
                    for s in spans.as_py():
                        gone[s["start"]] += 1
                        gone[s["start"] + s["length"]] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    ws = [ws[i] for i in np.flatnonzero(stay)]
                removed.append(counts[-1] - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])
    return of


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as (c0, c1, ... : the columns of ``docs`` in order; n_words,
    n_removed, kept): the words left, joined by one space."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    spans = repeated(rows.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("binary").alias("text")),
                     window, gram, bucket)
    keyed = rows.withColumns({"_id": F.col(doc).cast("long"), "_mark": F.xxhash64(F.col(text).cast("binary"))})
    joined = keyed.join(spans.toDF("_id", "_mark", "_spans"), ["_id", "_mark"], "left").select(*names, "_spans")
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_cut(names, names.index(text)), schema)


def clean(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from their texts; a text that loses
    nothing stays as it is."""
    made = remove_repeated(docs, window, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)
    return made.select(*(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"c{at}")).alias(c) if k == at
                         else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
