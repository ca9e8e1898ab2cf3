"""Report suite export (A6), BI exports (A7), reload (A8) and the
completeness manifest (A9).

Reports are a few hundred rows each, so each is written as a single CSV
file; nothing here touches review-level data except through the reports'
own (aggregating) plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.params import Params
from revlens.plans.reports import era_labels, relabel
from revlens.sources import files
from revlens.sources.store import path_exists

# FIXED VALUES: BI export file -> suite result it is made from (8 of the 9;
# the era sentiment result is not exported), in the study's order.
BI_EXPORTS = (
    ("tableau_ratings.csv", "q1_ratings_overview_result1"),
    ("tableau_trend.csv", "q2_ratings_trend_result1"),
    ("tableau_complaints.csv", "q3_complaint_categories_result1"),
    ("tableau_monthly.csv", "q4_paytm_deepdive_result1"),
    ("tableau_response_a.csv", "q5_response_analysis_result1"),
    ("tableau_response_b.csv", "q5_response_analysis_result2"),
    ("tableau_era.csv", "q6_era_comparison_result2"),
    ("tableau_summary.csv", "q6_era_comparison_result3"),
)
# results whose fallback category is shown under its display name, and
# results that carry the era display label when exported
RELABELLED = ("q3_complaint_categories_result1", "q6_era_comparison_result2")
ERA_LABELLED = ("q6_era_comparison_result2", "q6_era_comparison_result3")


def run_suite(reports: dict[str, DataFrame], out_dir: str) -> None:
    """One CSV per result set, ``<out_dir>/<name>.csv``."""
    for name, df in reports.items():
        files.write_report_csv(df, f"{out_dir}/{name}.csv")


def bi_tables(reports: dict[str, DataFrame], params: Params) -> dict[str, DataFrame]:
    """The BI-ready tables (relabelled where the charts are)."""
    out = {}
    for fname, src in BI_EXPORTS:
        df = reports[src]
        if src in RELABELLED:
            df = relabel(df, "complaint_category", params.category_relabel)
        if src in ERA_LABELLED:
            df = era_labels(df, params)
        out[fname] = df
    return out


def export_bi(reports: dict[str, DataFrame], params: Params, out_dir: str) -> None:
    for fname, df in bi_tables(reports, params).items():
        files.write_report_csv(df, f"{out_dir}/{fname}")


def read_reports(spark: SparkSession, out_dir: str, reports: dict[str, DataFrame],
                 suffix: str = ".csv") -> dict[str, DataFrame]:
    """Reload each result with the schema of the report that wrote it, and
    ``position`` (from 1), its place in the file."""
    return {n: files.read_landing_csv(spark, f"{out_dir}/{n}{suffix}", df.schema) for n, df in reports.items()}


def written_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """(report, files, bytes) of the result folders below ``out_dir``, from a
    listing alone: no content is read."""
    part = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
            .load(out_dir).select(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("report"), "length"))
    return part.groupBy("report").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def suite_manifest(spark: SparkSession, out_dir: str, reports: dict[str, DataFrame],
                   suffix: str = ".csv") -> DataFrame:
    """(report, rows, present) for every expected result file."""
    expected = spark.createDataFrame([(n, f"{n}{suffix}") for n in reports], "report string, file string")
    listed = written_files(spark, out_dir) if path_exists(spark, out_dir) else spark.createDataFrame(
        [], "report string, files long, bytes long")
    absent = expected.join(listed.select(F.col("report").alias("file")), "file", "left_anti")
    gone = {r["report"] for r in absent.select("report").collect()}  # of the expected names
    parts = [absent.select("report", F.lit(0).cast("long").alias("rows"), F.lit(False).alias("present"))]
    for name, df in reports.items():
        if name not in gone:
            n = files.read_report_csv(spark, f"{out_dir}/{name}{suffix}", df.schema).agg(F.count(F.lit(1)).alias("rows"))
            parts.append(n.select(F.lit(name).alias("report"), "rows", F.lit(True).alias("present")))
    return reduce(DataFrame.unionByName, parts)
