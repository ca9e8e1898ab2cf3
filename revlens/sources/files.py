"""File readers and writers: review CSVs, the gold CSV export, RSS XML,
report CSVs.  Every reader takes an explicit schema (no inference pass over
100 TB, and XML inference turns titles such as "T1" into timestamps).

CSV with quoted newlines needs ``multiLine``, which makes each file one
task; writers therefore emit one file per task, so a later read is as
parallel as the write.  A single large file can be read by many tasks
(``split=True``, see ``sources.records``).  Landing to Parquet happens once;
reports never read CSV.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.constants import SCRAPE_SOURCE
from revlens.functions.dates import fmt_ts, parse_ts
from revlens.operators.conform import tag
from revlens.operators.dedup import union_all
from revlens.schema import FEED_ITEM, GOLD, GOLD_COLUMNS, RAW_HISTORICAL, RAW_SCRAPE
from revlens.sources.records import split_records

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

_CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
             "mode": "PERMISSIVE", "timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_FORMAT}
_CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
              "timestampFormat": TS_FORMAT}


REJECT = T.StructType([T.StructField(n, T.StringType()) for n in ("reason", "column", "value")])
BROKEN, NOT_A_NUMBER, NOT_A_DATE = "broken record", "not a number", "not a date"
_CORRUPT = "_corrupt"


def _by_multiline(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(text columns, ``_corrupt``, ``_pos``) and the header's names; a file is
    one task, in which ids rise."""
    r = spark.read.options(**_CSV_READ)
    names = r.csv(path).columns
    if not any(n.startswith("_c") for n in names):  # every column has a name of its own
        r = r.option("enforceSchema", "false")
    df = r.option("columnNameOfCorruptRecord", _CORRUPT).option("columnPruning", "false").schema(_text_schema(names)).csv(path)
    return df.withColumn("_pos", F.struct(F.col("_metadata.file_path").alias("file"),
                                          F.monotonically_increasing_id().alias("at"))), names


def _by_split(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The same, of files that qualify (``sources.records``), each read by many
    tasks.  A file starts with its header line."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    told = (first[0] if first else "").removesuffix("\r").removeprefix("\ufeff")
    names = [n or f"_c{k}" for k, n in enumerate(next(csv.reader([told]), []))]
    header = F.regexp_replace(F.col("record"), "^\ufeff", "")
    other = F.raise_error(F.concat(F.lit(f"{path}: header differs in "), F.col("file"))).cast("boolean")
    records = split_records(spark, path)
    if first and first[0].endswith("\r"):  # a break inside a value is a newline, whatever ends the lines
        records = records.withColumn("record", F.replace("record", F.lit("\r\n"), F.lit("\n")))
    data = records.where(F.when(F.col("at") > 0, True).when(header == told, False).otherwise(other))
    # the parser makes a new buffer for each record
    options = _CSV_READ | {"columnNameOfCorruptRecord": _CORRUPT, "header": "false", "inputBufferSize": "4096"}
    parsed = F.from_csv("record", ", ".join(f"`{n}` string" for n in (*names, _CORRUPT)), options)
    # a generator, so that a record is parsed once however many columns are used
    return data.select(F.struct("file", "at").alias("_pos"), F.inline(F.array(parsed))), names


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in (*names, _CORRUPT)])


def read_csv_by_header(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = (),
                       split: bool = False, dates: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema``, bound by the names in the file's header
    (only the header line is read for that): columns in any order, absent
    ones NULL, others dropped, a value that is not of its type NULL.  An
    absent ``required`` column raises.  The part files of a folder must share
    one header; another one raises, where all names are given and differ.

    ``_pos`` is the row's place in file order: (file, place in it).
    ``_rejects`` lists what was wrong with the row: a record with too many or
    too few values, a number or date (of a timestamp column, or a text column
    named in ``dates``) that is not one.  ``split``: large files are read by
    many tasks each (see ``sources.records`` for which qualify)."""
    df, names = (_by_split if split else _by_multiline)(spark, path)
    at = {n.removeprefix("\ufeff"): n for n in names}
    if absent := [n for n in required if n not in at]:
        raise ValueError(f"{path}: no column {', '.join(absent)} in {names}")
    corrupt = F.col(_CORRUPT)

    def bound(f: T.StructField):
        if f.name not in at:
            return F.lit(None).cast(f.dataType)
        c = F.col(f"`{at[f.name]}`")
        return c if f.dataType == T.StringType() else c.try_cast(f.dataType)

    def reject(reason: str, column: str | None, value) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column"), value.alias("value"))

    found = [F.when(corrupt.isNotNull(), reject(BROKEN, None, corrupt))]
    for f in schema.fields:
        is_date = f.name in dates or isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        if f.name in at and (is_date or f.dataType != T.StringType()):
            text = F.col(f"`{at[f.name]}`")
            value = parse_ts(text) if f.name in dates else bound(f)
            found.append(F.when(corrupt.isNull() & (F.trim(text) != "") & value.isNull(),
                                reject(NOT_A_DATE if is_date else NOT_A_NUMBER, f.name, text)))
    rejects = F.array_compact(F.array(*found)).cast(T.ArrayType(REJECT))
    return df.select(*(bound(f).alias(f.name) for f in schema.fields), "_pos", rejects.alias("_rejects"))


def rejects(bronze: DataFrame) -> DataFrame:
    """The reject table of landed rows: (app, data_source, file, at, reason,
    column, value), one row for each thing that was wrong."""
    return bronze.select("app", "data_source", F.col("_pos.file").alias("file"), F.col("_pos.at").alias("at"),
                         F.explode("_rejects").alias("r")).select("app", "data_source", "file", "at", "r.*")


def read_reviews(spark: SparkSession, manifest: list[tuple],
                 schema: T.StructType = RAW_HISTORICAL, split: bool = False) -> DataFrame:
    """A1: ``manifest`` = [(path, app, data_source[, schema]), ...] in
    priority order.  Columns are bound by header, so files may order them
    differently or lack some.  Each file is tagged with its app, source and
    manifest position (``_file``); ``_pos`` is the row's place in it and
    ``_rejects`` what was wrong with it."""
    frames = []
    for i, entry in enumerate(manifest):
        path, app, source = entry[:3]
        fields = entry[3] if len(entry) > 3 else schema
        key = tuple(n for n in ("reviewId",) if n in fields.fieldNames())
        landed = read_csv_by_header(spark, path, fields, key, split, dates=("at", "repliedAt"))
        frames.append(tag(landed, app=app, data_source=source, _file=i))
    return union_all(frames)


def read_scrape(spark: SparkSession, path: str, source: str = SCRAPE_SOURCE, split: bool = False) -> DataFrame:
    """A2: the scrape CSV, bound by its header (a UTF-8 BOM is skipped)."""
    landed = read_csv_by_header(spark, path, RAW_SCRAPE, ("app", "review_id"), split, dates=("date",))
    return tag(landed, data_source=source, _file=0)


def _write_csv(df: DataFrame, path: str, mode: str, bom: bool = False) -> None:
    """Part files with a header each, behind a UTF-8 byte order mark if
    ``bom``; whitespace inside values is kept."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode(mode).options(**_CSV_WRITE).csv(path)


def in_table_order(gold: DataFrame, parts: int | None = None) -> DataFrame:
    """The gold table in the study's order (app, then date, missing dates
    last), ties by review id: ranges of rows to a task, sorted in it, so that
    the numbered files of a write, read by name, are the table in order.  The
    ranges cut through an app, so a large app is many files."""
    by = [F.col("app").asc_nulls_first(), F.col("date").asc_nulls_last(), F.col("review_id").asc_nulls_first()]
    ranged = gold.repartitionByRange(parts, *by) if parts else gold.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)


def read_positions(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Rows of a numbered Parquet write with ``position``, their place (from
    1) in file order.  Only a count per file is gathered for that."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("_name"),
                                           F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_name").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_name", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (rows.join(starts, "_name").withColumn("position", F.col("_start") + F.col("_row") + 1)
            .select("position", *columns))


def write_gold_csv(gold: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """Timestamps as ``yyyy-MM-dd HH:mm:ss``, NULL -> empty field,
    header, no index; whitespace inside values is kept (a blank reply must
    not turn into NULL).  Give it ``in_table_order(gold)`` for files in the
    study's order, and ``bom`` for its byte order mark."""
    cols = [fmt_ts(f.name).alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
            for f in GOLD.fields]
    _write_csv(gold.select(*cols), path, mode, bom)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A4: typed load of a gold CSV export, bound by its header; empty fields
    are NULL."""
    return read_csv_by_header(spark, path, GOLD, ("review_id", "app")).select(*GOLD_COLUMNS)


def write_report_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One small report -> one CSV file (reports are a few hundred
    rows, so a single task writes it)."""
    _write_csv(df.coalesce(1), path, mode)


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reload a report with its schema, bound by its header."""
    return read_csv_by_header(spark, path, schema, tuple(schema.fieldNames())).select(*schema.fieldNames())


def write_feed_xml(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feed items as RSS-style XML, one directory per query, in feed order:
    the tasks' files, by name, hold rising ranges of ``position``."""
    (items.select("query", "title", "link", "source", "pubDate", "position",
                  F.concat(F.lit("item-"), F.col("position").cast("string")).alias("guid"))
          .repartitionByRange("position").sortWithinPartitions("query", "position").drop("position")
          .write.mode(mode).partitionBy("query").format("xml")
          .option("rootTag", "channel").option("rowTag", "item").save(path))


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """A3: ``<item>`` rows with an explicit all-text schema (a missing tag is
    NULL, attributes and other tags are skipped); ``query`` comes from the
    directory name.  ``position`` is the item's place in feed order: (file,
    place in it); a file is read whole by one task."""
    schema = T.StructType(list(FEED_ITEM.fields) + [T.StructField("query", T.StringType(), True)])
    return (spark.read.format("xml").option("rowTag", "item").option("multiLine", "true").schema(schema).load(path)
            .select("*", F.struct(F.col("_metadata.file_path").alias("file"),
                                  F.monotonically_increasing_id().alias("at")).alias("position")))


def write_landing_csv(df: DataFrame, path: str, order: list, bom: bool = True,
                      mode: str = "overwrite") -> None:
    """A10: a landed scrape / news table as one CSV: header (UTF-8 BOM in
    front of it when ``bom``), rows in ``order``.  Landed tables are capped
    by construction (N per app / per query), so one sorted file is right;
    the sort is a range-partitioned sort and ``coalesce(1)`` keeps its
    order."""
    _write_csv(df.orderBy(*order).coalesce(1), path, mode, bom)


def read_landing_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed table again, with ``position`` (from 1): its place in the one
    file."""
    rows = read_csv_by_header(spark, path, schema, tuple(schema.fieldNames()))
    return rows.select(F.row_number().over(Window.orderBy("_pos")).cast("long").alias("position"), *schema.fieldNames())
