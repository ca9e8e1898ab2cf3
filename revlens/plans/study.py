"""The whole study as one Spark job graph: raw files -> gold -> checks ->
nine result sets -> BI tables.

    run_study(spark, manifest, scrape_path, out_dir, params)

- ``manifest``: [(csv path, app, data_source), ...] historical exports in
  priority order; ``scrape_path``: the fresh-scrape CSV.
- Writes ``bronze/`` (the raw files, each read once), ``rejects/`` (what was
  wrong in them: file, place, reason, column, value), ``gold/`` (Parquet,
  partitioned by year), ``gold_export/`` (CSV for other tools, in table order
  over numbered files, with a byte order mark), ``checks/`` (quality report), ``audit/`` (rows per step),
  ``results/<name>.csv`` (nine result sets) and ``bi/<file>`` (eight tables).
- With ``strict=True`` a failed quality check stops the run before any
  report is written (the reference only prints a warning).

Each stage reads the previous stage's *written* table, so lineage is cut at
every durable step and a lost executor costs a task retry, not a rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.constants import SCRAPE_SOURCE
from revlens.params import REFERENCE, Params
from revlens.plans import cleaning, quality, reports
from revlens.plans.complaints import classified_negatives
from revlens.plans.export import export_bi, run_suite
from revlens.schema import GOLD, GOLD_COLUMNS
from revlens.sources import files


def run_study(spark: SparkSession, manifest: list[tuple[str, str, str]], scrape_path: str,
              out_dir: str, params: Params = REFERENCE, strict: bool = False,
              scrape_source: str = SCRAPE_SOURCE, split: bool = False) -> dict[str, str]:
    """``split``: large CSV files are read by many tasks each (RFC 4180 only)."""
    out_dir = out_dir.rstrip("/")
    files.read_reviews(spark, manifest, split=split).write.mode("overwrite").parquet(f"{out_dir}/bronze/reviews")
    files.read_scrape(spark, scrape_path, scrape_source, split).write.mode("overwrite").parquet(f"{out_dir}/bronze/scrape")
    raw_hist = spark.read.parquet(f"{out_dir}/bronze/reviews")
    raw_scrape = spark.read.parquet(f"{out_dir}/bronze/scrape")
    (files.rejects(raw_hist).union(files.rejects(raw_scrape))
        .write.mode("overwrite").parquet(f"{out_dir}/rejects"))

    gold_dir = f"{out_dir}/gold"
    (cleaning.gold_build(raw_hist, raw_scrape, params)
        .sortWithinPartitions("year", "app", "date")
        .write.mode("overwrite").partitionBy("year").parquet(gold_dir))
    gold = spark.read.schema(GOLD).parquet(gold_dir).select(*GOLD_COLUMNS)

    checks = quality.validate(gold, params)
    checks.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/checks")
    cleaning.clean_step_audit(raw_hist, raw_scrape, params) \
        .coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/audit")
    if strict:
        quality.require(spark.read.parquet(f"{out_dir}/checks"))

    files.write_gold_csv(files.in_table_order(gold), f"{out_dir}/gold_export", bom=True)

    neg_dir = f"{out_dir}/negatives"
    # few files for each year, however many tasks scan; a large year is split
    (classified_negatives(gold, params).hint("rebalance", "year")
        .write.mode("overwrite").partitionBy("year").parquet(neg_dir))
    neg = spark.read.parquet(neg_dir)

    suite: dict[str, DataFrame] = reports.suite(gold, neg, params)
    run_suite(suite, f"{out_dir}/results")
    export_bi(suite, params, f"{out_dir}/bi")
    return {"gold": gold_dir, "negatives": neg_dir, "checks": f"{out_dir}/checks",
            "audit": f"{out_dir}/audit", "results": f"{out_dir}/results", "bi": f"{out_dir}/bi",
            "gold_export": f"{out_dir}/gold_export", "rejects": f"{out_dir}/rejects"}
