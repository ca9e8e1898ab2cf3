"""Named queries over a test-data directory (the driver contract's registry).

Each entry is ``(spark, sf_dir) -> DataFrame``.  Reports read the gold table
and the classified negatives that ``sources.testdata`` derives from the
driver's tables (written once per input snapshot in the checkpoint folder).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens import oracle
from revlens.constants import FEED_CAP_PER_QUERY, FEED_TOP_SOURCES, SCRAPE_CAP_PER_APP
from revlens.operators.conform import conform, rename
from revlens.operators.dedup import dedup_first, union_all
from revlens.params import FIXTURE, REFERENCE
from revlens.plans import cleaning as cl
from revlens.plans import landing as ld
from revlens.plans import quality as qa
from revlens.plans import reports as rp
from revlens.plans.export import BI_EXPORTS
from revlens.schema import GOLD, HISTORICAL_RENAME, RAW_HISTORICAL, RAW_SCRAPE
from revlens.session import apply_runtime_conf
from revlens.sources import files
from revlens.sources import testdata as td

P = FIXTURE
# the study's own 48-pattern lexicon over the same reviews
P_DEFAULT_LEX = FIXTURE.with_(lexicon=REFERENCE.lexicon)


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    return td.gold(spark, sf)


def _neg(spark: SparkSession, sf: str, p=P) -> DataFrame:
    apply_runtime_conf(spark)
    return td.negatives(spark, sf, p)


LINEITEM_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "l_returnflag", "l_linestatus", "l_shipdate"]


def q_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """E1 on lineitem: first row per (l_orderkey, l_linenumber) by the other columns."""
    apply_runtime_conf(spark)
    li = td.table(spark, sf, "lineitem")
    return dedup_first(li, ["l_orderkey", "l_linenumber"], LINEITEM_ORDER).select(*li.columns)


def q_dedup_cross_source(spark: SparkSession, sf: str) -> DataFrame:
    """E2 + E4 on the raw landing rows: union both sources, keep the first
    copy of each id by (source priority, file, position)."""
    apply_runtime_conf(spark)
    cols = ["review_id", "app", "data_source", "rating", "_file", "_pos"]
    h = rename(td.raw_historical(spark, sf), HISTORICAL_RENAME).select(*cols)
    s_ = td.raw_scrape(spark, sf).select(*cols)
    u = union_all([h.withColumn("source_priority", F.lit(0).cast("long")),
                   s_.withColumn("source_priority", F.lit(1).cast("long"))])
    return (dedup_first(u, ["review_id"], ["source_priority", "_file", "_pos"])
            .select("review_id", "app", "data_source", "rating", "source_priority"))


# newest-N landing over the gold reviews: cutoff and cap per the scraper
SCRAPE_CUTOFF = "2000-01-01 00:00:00"


def q_newest_n(spark: SparkSession, sf: str) -> DataFrame:
    g = _gold(spark, sf).select(*ld.SCRAPE_COLUMNS)
    return ld.scrape_landing(g, SCRAPE_CUTOFF, SCRAPE_CAP_PER_APP, P.scrape_apps)


def q_feed_clean(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    return ld.feed_landing(td.feed_items(spark, sf), td.FEED_CUTOFF, FEED_CAP_PER_QUERY)


def q_rfc822(spark: SparkSession, sf: str) -> DataFrame:
    from revlens.functions.dates import parse_rfc822
    apply_runtime_conf(spark)
    it = td.feed_items(spark, sf)
    return it.select(F.col("position").alias("event_id"), F.col("pubDate").alias("pub_date"),
                     parse_rfc822("pubDate").alias("parsed_at"))


def q_dedup_feed(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    return ld.feed_dedup(td.feed_items(spark, sf)).select("query", "position", "url", "source")


def q_xml_feed(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    return ld.feed_landing(td.feed_xml_items(spark, sf), td.FEED_CUTOFF, FEED_CAP_PER_QUERY)


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    return td.gold_csv_roundtrip(spark, sf)


def q_stream_landing(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    return td.gold_stream_landed(spark, sf)


def _suite(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return rp.suite(_gold(spark, sf), _neg(spark, sf), P)


def q_suite_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from revlens.plans.export import suite_manifest
    reports = _suite(spark, sf)
    out = td.suite_dir(spark, sf, P, lambda: reports)
    return suite_manifest(spark, out, reports)


#: The result left out of the folder of ``suite_missing_file``.
LEFT_OUT = "q4_paytm_deepdive_result1"


def q_suite_missing_file(spark: SparkSession, sf: str) -> DataFrame:
    """A9 where a result was not written."""
    from revlens.plans.export import suite_manifest
    reports = _suite(spark, sf)
    out = td.suite_dir(spark, sf, P, lambda: reports, missing=(LEFT_OUT,))
    return suite_manifest(spark, out, reports)


def q_reloaded(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A6 + A8: one result file of the suite, read back with its row order."""
    def of(spark: SparkSession, sf: str) -> DataFrame:
        from revlens.plans.export import read_reports
        reports = _suite(spark, sf)
        out = td.suite_dir(spark, sf, P, lambda: reports)
        return read_reports(spark, out, {name: reports[name]})[name]
    return of


def _bi_dir(spark: SparkSession, sf: str) -> tuple[str, dict[str, DataFrame]]:
    from revlens.plans.export import bi_tables, export_bi
    reports = _suite(spark, sf)
    return td.export_dir(spark, sf, P, lambda p: export_bi(reports, P, p)), bi_tables(reports, P)


def q_bi_file(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """One BI table, read back from its file."""
    def of(spark: SparkSession, sf: str) -> DataFrame:
        from revlens.plans.export import read_reports
        out, tables = _bi_dir(spark, sf)
        return read_reports(spark, out, {name: tables[name]}, suffix="")[name]
    return of


def q_bi_era_table(spark: SparkSession, sf: str) -> DataFrame:
    from revlens.plans.export import bi_tables
    return bi_tables(_suite(spark, sf), P)["tableau_era.csv"]


def q_bi_export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from revlens.plans.export import suite_manifest
    out, tables = _bi_dir(spark, sf)
    return suite_manifest(spark, out, tables, suffix="")


# --- from files: the raw CSVs, each read by many tasks ---------------------

def _bronze(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    apply_runtime_conf(spark)
    manifest, scrape = td.raw_csv(spark, sf)
    return files.read_reviews(spark, manifest, split=True), files.read_scrape(spark, scrape, "fresh", split=True)


def q_bronze_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """A1 + A2: what was wrong in the raw files, counted."""
    reviews, scrape = _bronze(spark, sf)
    found = files.rejects(reviews).union(files.rejects(scrape))
    return found.groupBy("app", "data_source", "reason", "column").agg(F.count("*").alias("rejects"))


def q_gold_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """P12 from the raw files on."""
    return cl.gold_build(*_bronze(spark, sf), P)


def q_gold_sorted(spark: SparkSession, sf: str) -> DataFrame:
    apply_runtime_conf(spark)
    return td.gold_in_order(spark, sf)


def q_newest_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A10 + I2: the landed scrape as its CSV, in file order."""
    return td.landed_csv(spark, sf, "scrape", q_newest_n(spark, sf), ["app", F.desc("date"), "review_id"],
                         ("orders", "documents", "lineitem"), SCRAPE_CUTOFF, SCRAPE_CAP_PER_APP)


def q_news_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A10 + I3: the landed news as its CSV, in file order."""
    return td.landed_csv(spark, sf, "news", q_feed_clean(spark, sf), [F.desc("date"), "query", "url", "title", "source"],
                         ("events",), td.FEED_CUTOFF, FEED_CAP_PER_QUERY)


def q_word_frequency_other(spark: SparkSession, sf: str) -> DataFrame:
    """P4 over the negatives that no pattern explains."""
    apply_runtime_conf(spark)
    return rp.word_frequency_of(*td.negatives_by_id(spark, sf, P), P.fallback_category, P)


def q_import_check_nocase(spark: SparkSession, sf: str) -> DataFrame:
    """P0 where half the ratings spell their app in capitals."""
    mixed = F.when(F.col("rating") % 2 == 0, F.upper("app")).otherwise(F.col("app"))
    return rp.import_check(_gold(spark, sf).withColumn("app", mixed), nocase=True)


def q_dedup_nocase(spark: SparkSession, sf: str) -> DataFrame:
    """E1 by an id that is spelled in two ways."""
    apply_runtime_conf(spark)
    prefix = F.when(F.col("l_linenumber") % 2 == 0, "Order-").otherwise("ORDER-")
    li = td.table(spark, sf, "lineitem").select(
        F.concat(prefix, F.col("l_orderkey").cast("string")).alias("order_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), "l_quantity")
    return dedup_first(li, ["order_id"], ["l_quantity", "line", "part"], rp.NOCASE).drop("l_quantity")


def _raw(spark: SparkSession, sf: str):
    apply_runtime_conf(spark)
    return td.raw_historical(spark, sf), td.raw_scrape(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "import_check": lambda s, d: rp.import_check(_gold(s, d)),
    "ratings_overview": lambda s, d: rp.ratings_overview(_gold(s, d), P),
    "rating_trend_yearly": lambda s, d: rp.rating_trend_yearly(_gold(s, d), P),
    "worst_year": lambda s, d: rp.worst_year(rp.rating_trend_yearly(_gold(s, d), P)),
    "last_rating_per_app": lambda s, d: rp.last_rating_per_app(rp.rating_trend_yearly(_gold(s, d), P)),
    "source_bias_profile": lambda s, d: rp.source_bias_profile(_gold(s, d)),
    "layer_profile": lambda s, d: rp.layer_profile(_gold(s, d)),
    "complaint_categories": lambda s, d: rp.complaint_categories(_neg(s, d)),
    "complaint_categories_default_lexicon":
        lambda s, d: rp.complaint_categories(_neg(s, d, P_DEFAULT_LEX)),
    "category_ratio": lambda s, d: rp.category_ratio(_neg(s, d), P),
    "word_frequency": lambda s, d: rp.word_frequency(_gold(s, d), P),
    "monthly_deepdive": lambda s, d: rp.monthly_deepdive(_neg(s, d), P),
    "monthly_prefix_excluded":
        lambda s, d: rp.monthly_slice(rp.monthly_deepdive(_neg(s, d), P), P),
    "period_change": lambda s, d: rp.period_change(rp.monthly_deepdive(_neg(s, d), P), P),
    "response_summary": lambda s, d: rp.response_summary(_gold(s, d), P),
    "response_by_year": lambda s, d: rp.response_by_year(_gold(s, d), P),
    "era_sentiment": lambda s, d: rp.era_sentiment(_gold(s, d), P),
    "era_complaints": lambda s, d: rp.era_complaints(_neg(s, d), P),
    "era_heatmap": lambda s, d: rp.era_heatmap(rp.era_complaints(_neg(s, d), P), P),
    "era_top_complaint": lambda s, d: rp.era_top_complaint(_neg(s, d), P),
    "era_summary_grid": lambda s, d: rp.era_summary_grid(rp.era_top_complaint(_neg(s, d), P), P),
    "dedup_first": q_dedup_first,
    "dedup_cross_source": q_dedup_cross_source,
    "silver_clean": lambda s, d: conform(cl.silver_historical(_raw(s, d)[0], P), GOLD),
    "gold_build": lambda s, d: cl.gold_build(*_raw(s, d), P),
    "clean_step_audit": lambda s, d: cl.clean_step_audit(*_raw(s, d), P),
    "gold_validation": lambda s, d: qa.validate(_gold(s, d), P),
    "newest_n_per_app": q_newest_n,
    "landing_summary": lambda s, d: ld.landing_summary(q_newest_n(s, d)),
    "feed_clean": q_feed_clean,
    "feed_top_sources": lambda s, d: ld.top_sources(q_feed_clean(s, d), FEED_TOP_SOURCES),
    "dedup_feed": q_dedup_feed,
    "rfc822_parse": q_rfc822,
    "csv_roundtrip": q_csv_roundtrip,
    "xml_feed": q_xml_feed,
    "suite_manifest": q_suite_manifest,
    "stream_landing": q_stream_landing,
    "silver_scrape": lambda s, d: conform(cl.silver_scrape(_raw(s, d)[1], P), GOLD),
    "bi_era_table": q_bi_era_table,
    "bi_export_manifest": q_bi_export_manifest,
    "suite_missing_file": q_suite_missing_file,
    "bronze_reviews": lambda s, d: _bronze(s, d)[0].select(*RAW_HISTORICAL.fieldNames(), "app", "data_source"),
    "bronze_scrape": lambda s, d: _bronze(s, d)[1].select(*RAW_SCRAPE.fieldNames(), "data_source"),
    "bronze_rejects": q_bronze_rejects,
    "gold_from_files": q_gold_from_files,
    "gold_sorted": q_gold_sorted,
    "distinct_values": lambda s, d: rp.distinct_values(_gold(s, d)),
    "word_frequency_other": q_word_frequency_other,
    "import_check_nocase": q_import_check_nocase,
    "dedup_nocase": q_dedup_nocase,
    "monthly_slice_app": lambda s, d: rp.monthly_slice(rp.monthly_deepdive(_neg(s, d), P), P, P.deep_dive_apps[0]),
    "newest_csv": q_newest_csv,
    "news_csv": q_news_csv,
}

ORACLE: dict[str, str] = {
    "import_check": oracle.import_check(),
    "ratings_overview": oracle.ratings_overview(P),
    "rating_trend_yearly": oracle.rating_trend_yearly(P),
    "worst_year": oracle.worst_year(P),
    "last_rating_per_app": oracle.last_rating_per_app(P),
    "source_bias_profile": oracle.source_bias_profile(),
    "layer_profile": oracle.layer_profile(),
    "complaint_categories": oracle.complaint_categories(P),
    "complaint_categories_default_lexicon": oracle.complaint_categories(P_DEFAULT_LEX),
    "category_ratio": oracle.category_ratio(P),
    "word_frequency": oracle.word_frequency(P),
    "monthly_deepdive": oracle.monthly_deepdive(P),
    "monthly_prefix_excluded": oracle.monthly_prefix_excluded(P),
    "period_change": oracle.period_change(P),
    "response_summary": oracle.response_summary(P),
    "response_by_year": oracle.response_by_year(P),
    "era_sentiment": oracle.era_sentiment(P),
    "era_complaints": oracle.era_complaints(P),
    "era_heatmap": oracle.era_heatmap(P),
    "era_top_complaint": oracle.era_top_complaint(P),
    "era_summary_grid": oracle.era_summary_grid(P),
    "dedup_first": oracle.dedup_first_lineitem(),
    "dedup_cross_source": oracle.dedup_cross_source(P),
    "silver_clean": oracle.silver_clean(P),
    "gold_build": oracle.gold_build(P),
    "clean_step_audit": oracle.clean_step_audit(P),
    "gold_validation": oracle.gold_validation(P),
    "newest_n_per_app": oracle.newest_n_per_app(SCRAPE_CUTOFF, SCRAPE_CAP_PER_APP),
    "landing_summary": oracle.landing_summary(SCRAPE_CUTOFF, SCRAPE_CAP_PER_APP),
    "feed_clean": oracle.feed_clean(td.FEED_QUERIES, td.FEED_CUTOFF, FEED_CAP_PER_QUERY),
    "feed_top_sources": oracle.feed_top_sources(td.FEED_QUERIES, td.FEED_CUTOFF, FEED_CAP_PER_QUERY, FEED_TOP_SOURCES),
    "dedup_feed": oracle.dedup_feed(td.FEED_QUERIES),
    "rfc822_parse": oracle.rfc822_parse(td.FEED_QUERIES),
    "csv_roundtrip": oracle.csv_roundtrip(),
    "stream_landing": oracle.csv_roundtrip(),
    "silver_scrape": oracle.silver_scrape(P),
    "bi_era_table": oracle.bi_table("tableau_era.csv", P),
    "bi_export_manifest": oracle.suite_manifest([(n, oracle.bi_table(n, P)) for n, _ in BI_EXPORTS]),
    "xml_feed": oracle.feed_clean(td.FEED_QUERIES, td.FEED_CUTOFF, FEED_CAP_PER_QUERY),
    "bronze_reviews": oracle.bronze_reviews(P),
    "bronze_scrape": oracle.bronze_scrape(P),
    "bronze_rejects": oracle.bronze_rejects(P),
    "gold_from_files": oracle.gold_from_files(P),
    "gold_sorted": oracle.gold_sorted(),
    "distinct_values": oracle.distinct_values(),
    "word_frequency_other": oracle.word_frequency_of(P.fallback_category, P),
    "import_check_nocase": oracle.import_check_nocase(),
    "dedup_nocase": oracle.dedup_nocase(),
    "monthly_slice_app": oracle.monthly_slice(P.deep_dive_apps[0], P),
    "newest_csv": oracle.numbered_csv(oracle.newest_n_per_app(SCRAPE_CUTOFF, SCRAPE_CAP_PER_APP),
                                      "app, date DESC, review_id", "date", "review_text", "app_version"),
    "news_csv": oracle.numbered_csv(oracle.feed_clean(td.FEED_QUERIES, td.FEED_CUTOFF, FEED_CAP_PER_QUERY),
                                    "date DESC, query, url, title, source", "date", "title", "source", "url"),
}

#: Result of the suite -> the query whose SQL gives it.
SUITE_QUERY = {
    "q1_ratings_overview_result1": "ratings_overview", "q2_ratings_trend_result1": "rating_trend_yearly",
    "q3_complaint_categories_result1": "complaint_categories", "q4_paytm_deepdive_result1": "monthly_deepdive",
    "q5_response_analysis_result1": "response_summary", "q5_response_analysis_result2": "response_by_year",
    "q6_era_comparison_result1": "era_sentiment", "q6_era_comparison_result2": "era_complaints",
    "q6_era_comparison_result3": "era_top_complaint",
}
ORACLE["suite_manifest"] = oracle.suite_manifest([(n, ORACLE[k]) for n, k in SUITE_QUERY.items()])
ORACLE["suite_missing_file"] = oracle.suite_manifest([(n, ORACLE[k]) for n, k in SUITE_QUERY.items()], (LEFT_OUT,))
# every written result and BI table by content and row order
for _result, _query in SUITE_QUERY.items():
    QUERIES[f"reloaded_{_result}"] = q_reloaded(_result)
    ORACLE[f"reloaded_{_result}"] = oracle.numbered(ORACLE[_query], oracle.ORDER[_query])
for _file, _result in BI_EXPORTS:
    _name = f"bi_{_file.removeprefix('tableau_').removesuffix('.csv')}_file"
    QUERIES[_name] = q_bi_file(_file)
    # in the order of the result it is made from: a display name moves no row
    _by = oracle.ORDER[SUITE_QUERY[_result]].replace("complaint_category", oracle.fallback_first_name(P))
    ORACLE[_name] = oracle.numbered(oracle.bi_table(_file, P), _by)
