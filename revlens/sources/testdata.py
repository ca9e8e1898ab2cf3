"""Review-shaped inputs derived from the driver's synthetic tables.

The study's raw data is not shipped, so reviews are assembled from
``orders`` (one review per order), ``documents`` (review text, joined on
``doc_id = o_orderkey``) and ``lineitem`` (company reply: earliest ship date
and highest return flag per order).  The mapping is FIXTURES.md view R.

At scale this is two key-unique left joins on the order key: each input is
hash-partitioned on it once and the second join reuses the first one's
partitioning (sort-merge joins; AQE turns one into a broadcast only when the
measured side is under its cap, as at small scale factors), and the
lineitem side is partially aggregated before its shuffle.  The result is written once per input snapshot as the
gold Parquet table (partitioned by ``year``) and every report reads that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.params import Params
from revlens.plans.complaints import classified_negatives, negative_texts
from revlens.schema import GOLD, GOLD_COLUMNS, RAW_HISTORICAL, RAW_SCRAPE
from revlens.sources import store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

_GOLD_VERSION = "gold-v4"
_NEG_VERSION = "neg-v1"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def reply_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: earliest ship date (reply time) and highest return flag
    (reply kind), over all its lines."""
    return (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
            .agg(F.min("l_shipdate").alias("rd"), F.max("l_returnflag").alias("rf")))


def reviews_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View R: gold-shaped reviews, one per order (not materialized)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = reply_facts(spark, sf_dir)
    j = (o.join(d, o["o_orderkey"] == d["doc_id"], "left")
          .join(x, o["o_orderkey"] == x["l_orderkey"], "left"))
    k, rf = F.col("o_orderkey"), F.col("rf")
    no_reply = (k % 4) == 3
    return j.select(
        k.cast("string").alias("review_id"),
        F.when(F.col("o_orderstatus") == "F", "AppF")
         .when(F.col("o_orderstatus") == "O", "AppO").otherwise("AppP").alias("app"),
        F.when(k % 4 < 2, "help").when(k % 4 == 2, "new").otherwise("fresh").alias("data_source"),
        F.col("o_orderdate").alias("date"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("rating"),
        F.col("text").alias("review_text"),
        (F.col("o_custkey") % 50).cast("int").alias("thumbs_up"),
        F.when(no_reply, F.lit(None).cast("string"))
         .when(rf == "R", "thanks").when(rf == "N", "  ").when(rf == "A", "noted")
         .alias("reply_text"),
        F.when(no_reply, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("rd")).alias("reply_date"),
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("user_name"),
        F.lit(None).cast("string").alias("app_version"),
    )


def _inputs(sf_dir: str, names) -> list[str]:
    return [table_path(sf_dir, n) for n in names]


def gold_path(spark: SparkSession, sf_dir: str) -> str:
    inputs = _inputs(sf_dir, ("orders", "documents", "lineitem"))
    key = store.fingerprint(spark, inputs, _GOLD_VERSION)
    # within a year, rows are clustered by rating: negatives (the only rows
    # whose text is read) sit in their own row groups, and the pushed
    # ``rating <= 2`` skips the text of the others
    return store.materialize(spark, lambda: reviews_view(spark, sf_dir), "gold", key,
                             partition_by=("year",), sort_within=("year", "rating", "app"), inputs=inputs)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold review table for ``sf_dir`` (built on first use)."""
    path = gold_path(spark, sf_dir)
    return spark.read.schema(GOLD).parquet(path).select(*GOLD_COLUMNS)


def negatives(spark: SparkSession, sf_dir: str, params: Params) -> DataFrame:
    """Classified negatives, written once per (gold snapshot, lexicon) so the
    four complaint reports scan the text column once, not four times."""
    gpath = gold_path(spark, sf_dir)
    key = store.fingerprint(spark, [gpath], _NEG_VERSION, params.lexicon,
                            params.fallback_category, params.negative_max_rating,
                            params.min_complaint_chars)
    path = store.materialize(
        spark, lambda: classified_negatives(spark.read.schema(GOLD).parquet(gpath), params),
        "negatives", key, partition_by=("year",), sort_within=("year", "app"), inputs=[gpath])
    return (spark.read.parquet(path)
            .select("review_id", "app", "data_source", F.col("year").cast("int").alias("year"),
                    "year_month", "complaint_category"))


def negatives_by_id(spark: SparkSession, sf_dir: str, params: Params) -> tuple[DataFrame, DataFrame]:
    """(texts, classes) of the negatives, both bucketed by review id, so that
    a join on it moves neither."""
    gpath = gold_path(spark, sf_dir)
    key = store.fingerprint(spark, [gpath], "by-id-v1", params.lexicon, params.fallback_category,
                            params.negative_max_rating, params.min_complaint_chars)
    gold_df = spark.read.schema(GOLD).parquet(gpath)
    texts = store.bucketed(spark, negative_texts(gold_df, params), "negative_texts", key, "review_id")
    classes = store.bucketed(spark, classified_negatives(gold_df, params).select("review_id", "complaint_category"),
                             "negative_classes", key, "review_id")
    return texts, classes


# --------------------------------------------------------------------------
# Raw landing files for the cleaning pipeline
# --------------------------------------------------------------------------
# One raw review per line item: the order key is the review id, so ids
# repeat naturally (several lines per order) and the two sources overlap
# (lines of one order are split between them by return flag).  Dirt comes
# from the data's own values: ratings are line numbers 1-7 (6 and 7 are out
# of range), large quantities carry an unparsable date, and orders without
# a document have no text.  Input order is (file, line) as in a CSV export:
# ``_file`` is the position in the manifest, ``_pos`` the in-file order.

HIST_MANIFEST = (("AppF", "help"), ("AppF", "new"), ("AppO", "help"), ("AppO", "new"),
                 ("AppP", "help"), ("AppP", "new"))
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (li.join(o, li["l_orderkey"] == o["o_orderkey"])
              .join(d, o["o_orderkey"] == d["doc_id"], "left"))


def _app(status: str = "o_orderstatus", other: str = "AppP"):
    s = F.col(status)
    return F.when(s == "F", "AppF").when(s == "O", "AppO").otherwise(other)


def _historical(app, src) -> dict:
    """The columns of a historical export row."""
    ship = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    reply = (F.when(F.col("l_returnflag") == "R", "thanks")
              .when(F.col("l_linestatus") == "O", "  "))
    return {
        "reviewId": F.col("o_orderkey").cast("string"),
        "userName": F.concat(F.lit("cust"), F.col("o_custkey").cast("string")),
        "userImage": F.concat(F.lit("img/"), F.col("o_custkey").cast("string")),
        "content": F.col("text"),
        "score": F.col("l_linenumber"),
        "thumbsUpCount": F.col("l_quantity").cast("int"),
        "reviewCreatedVersion": F.concat(F.lit("1."), F.col("l_linenumber").cast("string")),
        "at": F.when(F.col("l_quantity") >= 49, "bad").otherwise(ship),
        "replyContent": reply,
        "repliedAt": F.when(reply.isNotNull(), ship),
        "app": app, "data_source": src,
    }


def _listing():
    return F.when(F.col("l_linestatus") == "F", "help").otherwise("new")


def raw_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical export rows (6 files: app x {help, new})."""
    j = _raw_lines(spark, sf_dir).where(F.col("l_returnflag") != "N")
    app, src = _app(), _listing()
    file_rank = F.lit(None).cast("int")
    for i, (a, s) in enumerate(HIST_MANIFEST):
        file_rank = F.when((app == a) & (src == s), i).otherwise(file_rank)
    return j.select(*(c.alias(n) for n, c in _historical(app, src).items()),
                    file_rank.alias("_file"), F.struct(*LINE_ORDER).alias("_pos"))


def _scrape() -> dict:
    """The columns of a scraped row."""
    return {
        "app": _app(other="AppX"),
        "review_id": F.col("o_orderkey").cast("string"),
        "date": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "rating": F.col("l_linenumber"),
        "review_text": F.col("text"),
        "thumbs_up": F.col("l_quantity").cast("int"),
        "app_version": F.concat(F.lit("1."), F.col("l_linenumber").cast("string")),
        "data_source": F.lit("fresh"),
    }


def raw_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh-scrape rows (one file; a fourth app outside the allow-list)."""
    j = _raw_lines(spark, sf_dir).where(F.col("l_returnflag") == "N")
    return j.select(*(c.alias(n) for n, c in _scrape().items()),
                    F.lit(0).alias("_file"), F.struct(*LINE_ORDER).alias("_pos"))


# The same rows as CSV files, one folder per manifest entry and one for the
# scrape, with what goes wrong in such files: lines of a tax of 8 % are cut
# after their seventh value, and those of a discount of 10 % say "n/a" for
# the thumbs-up count.
#
# One job writes all folders.  A text is shuffled once, to its order's lines,
# which are sorted before they meet it; rows with a text are neither sorted
# nor shuffled.  So a folder's files hold ranges of hashed order keys, the
# lines of an order lie in one of them in LINE_ORDER, and the files are gzipped.

CUT_AFTER = 7
SCRAPE_FOLDER = "scrape"


def _percent(column: str):
    return F.round(F.col(column) * 100)


def _line(columns: list):
    return F.to_csv(F.struct(*columns), {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
                                         "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, line) of every raw row, an order's rows in order."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag IS NOT NULL")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the number keeps the optimizer from dropping a sort below a join
    lines = (li.join(o, li["l_orderkey"] == o["o_orderkey"]).sortWithinPartitions("o_orderkey", *LINE_ORDER)
             .withColumn("place", F.monotonically_increasing_id()))
    scraped = F.col("l_returnflag") == "N"
    folder = F.when(scraped, SCRAPE_FOLDER).otherwise(F.concat_ws("-", _app(), _listing()))
    row = _historical(_app(), _listing())
    thumbs = F.when(_percent("l_discount") == 10, "n/a").otherwise(row["thumbsUpCount"].cast("string"))
    columns = [(thumbs if n == "thumbsUpCount" else row[n]).alias(n) for n in RAW_HISTORICAL.fieldNames()]
    line = F.when(_percent("l_tax") == 8, _line(columns[:CUT_AFTER])).otherwise(_line(columns))
    columns = [_scrape()[n].alias(n) for n in RAW_SCRAPE.fieldNames()]
    return (lines.join(d, F.col("o_orderkey") == d["doc_id"], "left")
            .select(folder.alias("folder"), F.when(scraped, _line(columns)).otherwise(line).alias("value"), "place"))


def _with_headers(headers: dict[str, str]):
    """Puts a folder's header before its first line in a task."""
    def of(batches):
        import pyarrow as pa
        seen = set()
        for batch in batches:
            folder, value = batch.column("folder"), batch.column("value")
            new = sorted(set(folder.unique().to_pylist()) - seen)
            seen.update(new)
            if new:
                heads = [pa.array(x, pa.string()) for x in (new, [headers[name] for name in new])]
                yield pa.RecordBatch.from_arrays(heads, ["folder", "value"])
            yield pa.RecordBatch.from_arrays([folder, value], ["folder", "value"])
    return of


def raw_csv(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[str, str, str]], str]:
    """The raw landing files: (manifest, path of the scrape)."""
    inputs = _inputs(sf_dir, ("lineitem", "orders", "documents"))
    key = store.fingerprint(spark, inputs, "raw-csv-v2", store.run_token(spark))
    headers = {f"{app}-{source}": ",".join(RAW_HISTORICAL.fieldNames()) for app, source in HIST_MANIFEST}
    headers[SCRAPE_FOLDER] = "\ufeff" + ",".join(RAW_SCRAPE.fieldNames())

    def write(path: str) -> None:
        lines = csv_lines(spark, sf_dir).mapInArrow(_with_headers(headers), "folder string, value string")
        # a task has the files of all folders open, so that rows need no sorting by folder
        with store._conf(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(len(headers) + 1),
                                 "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
            lines.write.partitionBy("folder").option("compression", "gzip").text(path)

    path = store.materialize_with(spark, write, "raw_csv", key, inputs)
    return [(f"{path}/folder={app}-{source}", app, source) for app, source in HIST_MANIFEST], f"{path}/folder={SCRAPE_FOLDER}"


# --------------------------------------------------------------------------
# News feed items from events
# --------------------------------------------------------------------------
# query = event type (the query list is a parameter, alphabetical here),
# feed order = event id, link = per-user URL (users repeat, so URLs repeat
# within and across queries), source = one of 12 outlets, title = props.
# pubDate is RFC-822 text: GMT or +0530 spelling, junk or missing for small
# values, so both date spellings, unparsable and absent dates occur.

FEED_QUERIES = ("click", "error", "purchase", "signup", "view")
FEED_CUTOFF = "2024-01-01 00:30:00"
RFC_BODY = "EEE, dd MMM yyyy HH:mm:ss"


def pub_date_text(ts: str = "ts", value: str = "value", user: str = "user_id"):
    t, v = F.col(ts), F.col(value)
    ist = F.concat(F.date_format(t + F.expr("INTERVAL 5 HOURS 30 MINUTES"), RFC_BODY), F.lit(" +0530"))
    gmt = F.concat(F.date_format(t, RFC_BODY), F.lit(" GMT"))
    return (F.when(v < 1, F.lit(None).cast("string"))
             .when(v < 2, F.lit("not a date"))
             .when(F.col(user) % 2 == 0, gmt).otherwise(ist))


def feed_items(spark: SparkSession, sf_dir: str, queries=FEED_QUERIES) -> DataFrame:
    """Feed items: query, query_idx, position, title, link, source, pubDate."""
    ev = table(spark, sf_dir, "events")
    idx = F.create_map(*[F.lit(x) for i, qn in enumerate(queries) for x in (qn, i)])
    return (ev.where(F.col("event_type").isin(*queries))
              .select(F.col("event_type").alias("query"),
                      idx[F.col("event_type")].cast("int").alias("query_idx"),
                      F.col("event_id").alias("position"),
                      F.col("props").alias("title"),
                      F.concat(F.lit("https://news.example/u"), F.col("user_id").cast("string")).alias("link"),
                      F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("source"),
                      pub_date_text().alias("pubDate")))


def gold_csv_path(spark: SparkSession, sf_dir: str) -> str:
    """Gold exported as CSV (A5) once per snapshot."""
    from revlens.sources import files
    gpath = gold_path(spark, sf_dir)
    key = store.fingerprint(spark, [gpath], "csv-v2", store.run_token(spark))
    return store.materialize_with(
        spark, lambda p: files.write_gold_csv(files.in_table_order(spark.read.schema(GOLD).parquet(gpath)), p, bom=True),
        "gold_csv", key, [gpath])


def gold_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold table written in the study's order over numbered files, and
    read back with each row's place in file order."""
    from revlens.sources import files
    gpath = gold_path(spark, sf_dir)
    key = store.fingerprint(spark, [gpath], "ordered-v1", store.run_token(spark))
    path = store.materialize_with(
        spark, lambda p: files.in_table_order(spark.read.schema(GOLD).parquet(gpath)).write.parquet(p), "gold_ordered", key,
        [gpath])
    return files.read_positions(spark, path, "review_id", "app", "date", "rating")


def gold_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV export re-read typed (A4)."""
    from revlens.sources import files
    return files.read_gold(spark, gold_csv_path(spark, sf_dir))


def feed_xml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items written as RSS XML once per snapshot and read back (A3)."""
    from revlens.sources import files
    key = store.fingerprint(spark, _inputs(sf_dir, ("events",)), "xml-v2", FEED_QUERIES, store.run_token(spark))
    path = store.materialize_with(
        spark, lambda p: files.write_feed_xml(feed_items(spark, sf_dir), p), "feed_xml", key)
    idx = F.create_map(*[F.lit(x) for i, qn in enumerate(FEED_QUERIES) for x in (qn, i)])
    return files.read_feed_xml(spark, path).withColumn("query_idx", idx[F.col("query")].cast("int"))


def suite_dir(spark: SparkSession, sf_dir: str, params: Params, reports_builder, missing: tuple[str, ...] = ()) -> str:
    """The nine report CSVs for this snapshot and parameter set (A6), written
    once, but for those ``missing``; ``reports_builder()`` returns the name ->
    DataFrame dict."""
    from revlens.plans.export import run_suite
    gpath = gold_path(spark, sf_dir)
    key = store.fingerprint(spark, [gpath], "suite-v2", repr(params), sorted(missing), store.run_token(spark))

    def write(path: str) -> None:
        run_suite({n: df for n, df in reports_builder().items() if n not in missing}, path)

    return store.materialize_with(spark, write, "suite", key, [gpath])


def landed_csv(spark: SparkSession, sf_dir: str, name: str, landed: DataFrame, order: list, inputs, *extra) -> DataFrame:
    """A landed table written as its one CSV file (A10) and read back."""
    from revlens.sources import files
    key = store.fingerprint(spark, _inputs(sf_dir, inputs), "landed-v1", name, extra, store.run_token(spark))
    path = store.materialize_with(spark, lambda p: files.write_landing_csv(landed, p, order), "landed", key,
                                  _inputs(sf_dir, inputs))
    return files.read_landing_csv(spark, path, landed.schema)


def gold_stream_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold CSV export (one file per task) landed again through the
    incremental file stream into bronze Parquet.  Output and stream
    checkpoint lie together under one fixed path, so a run that died is
    taken up where it stopped."""
    from revlens.streaming.landing import land_files, read_bronze
    csv_path = gold_csv_path(spark, sf_dir)
    key = store.fingerprint(spark, [csv_path], "stream-v2")
    bronze = f"{store.checkpoint_root(spark)}/revlens/landed-{key}"
    land_files(spark, csv_path, bronze, f"{bronze}/_checkpoint", GOLD)
    return read_bronze(spark, bronze, GOLD).select(*GOLD_COLUMNS)


def export_dir(spark: SparkSession, sf_dir: str, params: Params, writer) -> str:
    """The BI export folder for this snapshot and parameter set."""
    gpath = gold_path(spark, sf_dir)
    key = store.fingerprint(spark, [gpath], "bi-v2", repr(params), store.run_token(spark))
    return store.materialize_with(spark, writer, "bi", key)
