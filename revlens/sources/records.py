"""CSV records of large files, read by many tasks.

``multiLine`` makes a CSV file one task, however large.  Here a file is read
as lines in splits; whether a line break stands inside a quoted value is told
by the parity of the quotes before it: per-split sums first (one row a split),
then a running sum in the task that reads a split.  Lines of a record that lie
in one split are joined there, as they are read, and written as records; nothing
of them is sorted or shuffled.  Only the fragments at split borders, two a split at most, meet
across splits.

Files qualify whose quote character appears only around values and doubled
inside them (RFC 4180, as every writer here makes them).  A bare quote inside
an unquoted value, or a backslash before a quote, shifts the parity of all that
follows; such files need ``multiLine``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.sources import store

SPLIT = ["file", "block"]
#: Rows (one a split) up to which the splits' parities are broadcast.
BROADCAST_SPLITS = 100_000


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, line, quotes): ids rise within a block."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return lines.withColumn("quotes", _quotes(F.col("line")))


def _parities(lines: DataFrame) -> DataFrame:
    """(file, block, odd): whether the quotes before each split are odd in
    number.  The window runs over one row a split."""
    sums = lines.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*SPLIT, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("odd"))


PIECE = "file string, block long, at long, number long, odd boolean, text string"


def _pieces(batches):
    """Each split's lines joined to records, as ``PIECE`` rows: ``number`` is 0
    for lines that go on from an earlier split, ``odd`` says that the piece
    goes on in the next one.  A split's lines come in order, one after another."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    split, state = None, {}

    def rows(at, number, odd, text):
        file, block = split
        n = len(text)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(at, pa.int64()),
             pa.array(number, pa.int64()), pa.array(odd, pa.bool_()), text],
            ["file", "block", "at", "number", "odd", "text"])

    def last():
        """The piece that the split ends with; odd quotes go on in the next split."""
        if state["lines"]:
            yield rows([state["at"]], [state["number"]], [bool(state["own"] % 2)], pa.array(["\n".join(state["lines"])], pa.string()))

    for batch in batches:
        file, block = batch.column("file"), batch.column("block").to_numpy()
        # borders of splits in the batch: the file's name is compared by its place among the few in it
        code = file.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            if a == b:
                continue
            if split != (key := (file[int(a)].as_py(), int(block[a]))):
                if split:
                    yield from last()
                split = key
                state = {"lines": [], "at": 0, "number": 0, "own": 0, "row": 0, "odd": batch.column("odd")[int(a)].as_py()}
            part = batch.slice(a, b - a)
            lines, quotes = part.column("line"), part.column("quotes").to_numpy()
            ends = state["odd"] + np.cumsum(quotes)  # quotes up to each line's end
            starts = np.flatnonzero((ends - quotes) % 2 == 0)
            if not len(starts):  # all of it belongs to the piece at hand
                if not state["lines"]:
                    state["at"] = split[1] + state["row"]
                state["lines"] += lines.to_pylist()
                state["own"] += int(quotes.sum())
            else:
                if starts[0] > 0:
                    if not state["lines"]:
                        state["at"] = split[1] + state["row"]
                    state["lines"] += lines.slice(0, starts[0]).to_pylist()
                    state["own"] += int(quotes[:starts[0]].sum())
                yield from last()
                whole = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines)
                k = len(starts) - 1
                if k:
                    yield rows(split[1] + state["row"] + starts[:-1], state["number"] + 1 + np.arange(k), [False] * k,
                               pc.binary_join(whole, "\n"))
                begin = int(starts[-1])
                state |= {"lines": lines.slice(begin).to_pylist(), "at": split[1] + state["row"] + begin,
                          "number": state["number"] + len(starts), "own": int(quotes[begin:].sum())}
            state["odd"] = int(ends[-1]) % 2
            state["row"] += int(b - a)
    if split:
        yield from last()


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record) of every record of the files at ``path``, header
    lines included.  ``at`` rises in file order and is 0 at a file's start; a
    carriage return at a record's end goes, and so do empty records."""
    lines = _lines(spark, path)
    parities = _parities(lines)
    if parities.count() <= BROADCAST_SPLITS:  # lines stay where and as they are read
        told = lines.join(F.broadcast(parities), SPLIT)
    else:
        told = lines.join(parities, SPLIT).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "id")
    # a line takes a byte at least, so ``at`` rises over the blocks too
    made = told.select(*SPLIT, "line", F.col("quotes").cast("long").alias("quotes"), F.col("odd").cast("long").alias("odd")
                       ).mapInArrow(_pieces, PIECE)
    # written once for the two readings below, which then are plain scans
    path = store.materialize_with(spark, lambda p: made.write.option("compression", "zstd").parquet(p), "records", uuid.uuid4().hex)
    pieces = spark.read.schema(PIECE).parquet(path)
    # number 0: lines that go on from an earlier split; odd quotes: goes on in the next
    is_open = (F.col("number") == 0) | F.col("odd")
    whole = pieces.where(~is_open).select("file", "at", F.col("text").alias("record"))
    begun = F.count_if(F.col("number") > 0).over(
        Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    joined = (pieces.where(is_open).withColumn("record_no", begun).groupBy("file", "record_no")
              .agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
              .select("file", F.col("first").alias("at"), F.array_join(F.col("parts.text"), "\n").alias("record")))
    records = whole.union(joined)
    return records.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")
