"""Bronze -> silver -> gold.

Step order is part of the definition (the reference's quirk 1): strip,
length filter, **dedup**, then the date and rating filters.  A first copy
with a bad date therefore shadows a good second copy and both vanish.

Input order: raw frames carry ``_file`` (manifest position) and ``_pos``
(in-file order); "keep first" means smallest (``_file``, ``_pos``).  Spark
rows have no order of their own, so readers attach these at the scan.

Shuffles: one per source for the per-source dedup (hash on review_id) and
one for the cross-source dedup.  Each dedup forwards at most one row per
key per map task (partial WindowGroupLimit), so a hot review id is cheap.
The gold table itself is partitioned by year and sorted within files; its
CSV export is in the study's order (``files.in_table_order``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.dates import add_calendar, parse_ts
from revlens.functions.text import clean_text
from revlens.operators.conform import add_nulls, conform, drop, rename
from revlens.operators.dedup import dedup_first, union_all
from revlens.params import Params
from revlens.schema import GOLD, HISTORICAL_RENAME

ORDER = ["_file", "_pos"]


def _text_steps(df: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(after strip, after length filter)."""
    stripped = df.withColumn("review_text", clean_text("review_text"))
    return stripped, stripped.where(F.length("review_text") >= params.min_review_chars)


def historical_stages(raw: DataFrame, params: Params) -> dict[str, DataFrame]:
    """Every intermediate of the historical silver build, by step name."""
    df = drop(rename(raw, HISTORICAL_RENAME), "userImage")
    df = df.withColumns({"date": parse_ts("date"), "reply_date": parse_ts("reply_date")})
    df = add_calendar(df)
    _, longer = _text_steps(df, params)
    deduped = dedup_first(longer, ["review_id"], ORDER)
    dated = deduped.where(F.col("date").isNotNull())
    rated = dated.where(F.col("rating").between(1, 5))
    return {"bronze": df, "length_filter": longer, "dedup": deduped,
            "date_filter": dated, "rating_filter": rated}


def scrape_stages(raw: DataFrame, params: Params) -> dict[str, DataFrame]:
    """Every intermediate of the scrape silver build.  No date or rating
    filter here (as defined); the gold checks report such rows."""
    df = add_calendar(raw.withColumn("date", parse_ts("date")))
    df = add_nulls(df, GOLD)
    _, longer = _text_steps(df, params)
    deduped = dedup_first(longer, ["review_id"], ORDER)
    allowed = deduped.where(F.col("app").isin(*params.apps))
    return {"bronze": df, "length_filter": longer, "dedup": deduped, "app_filter": allowed}


def silver_historical(raw: DataFrame, params: Params) -> DataFrame:
    return historical_stages(raw, params)["rating_filter"]


def silver_scrape(raw: DataFrame, params: Params) -> DataFrame:
    return scrape_stages(raw, params)["app_filter"]


def _with_priority(df: DataFrame, priority: int) -> DataFrame:
    """Gold columns (typed, missing ones NULL) plus input-order columns and
    the source priority (0 = historical, 1 = scrape)."""
    gold_cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                 for f in GOLD.fields]
    return df.select(*gold_cols, *ORDER, F.lit(priority).alias("_src"))


def gold_stages(hist_silver: DataFrame, scrape_silver: DataFrame) -> dict[str, DataFrame]:
    """Union (historical first) and cross-source dedup with source priority."""
    u = union_all([_with_priority(hist_silver, 0), _with_priority(scrape_silver, 1)])
    deduped = dedup_first(u, ["review_id"], ["_src"] + ORDER)
    return {"union": u, "cross_source_dedup": deduped}


def gold_build(raw_hist: DataFrame, raw_scrape: DataFrame, params: Params) -> DataFrame:
    """The 13-column gold table."""
    g = gold_stages(silver_historical(raw_hist, params), silver_scrape(raw_scrape, params))
    return conform(g["cross_source_dedup"], GOLD)


def _audit_rows(bronze: DataFrame, params: Params, name: str, **passes) -> DataFrame:
    """(review_id, <name>: in this source, long enough, and for those the
    place in input order with what the filters after the dedup would say)."""
    first = F.struct(*ORDER, *(F.coalesce(c, F.lit(False)).alias(k) for k, c in passes.items()))
    long_enough = F.length(clean_text("review_text")) >= params.min_review_chars
    return bronze.select("review_id", F.lit(True).alias(name), long_enough.alias(f"{name}_long"),
                         F.when(long_enough, first).alias(f"{name}_first"))


def clean_step_audit(raw_hist: DataFrame, raw_scrape: DataFrame, params: Params) -> DataFrame:
    """K8: rows in / out / dropped per cleaning step, in one pass.

    Each source is scanned once, and one aggregation by review id finds for
    both sources how many rows and long-enough rows the id has and the first
    of these, with the verdict of the later filters beside it; every step is a
    sum or conditional count over that.  It is an aggregation and not a
    window: the first row is a minimum, combined before the shuffle, so an id
    with a third of all rows costs one row per task.  No text is shuffled."""
    dated = F.col("date").isNotNull()
    h = _audit_rows(historical_stages(raw_hist, params)["bronze"], params, "hist",
                    dated=dated, rated=dated & F.col("rating").between(1, 5))
    s = _audit_rows(scrape_stages(raw_scrape, params)["bronze"], params, "scrape",
                    allowed=F.col("app").isin(*params.apps))
    by_id = union_all([h, s]).groupBy("review_id").agg(
        *(F.count(x).alias(x) for x in ("hist", "scrape")),
        *(F.count_if(f"{x}_long").alias(f"{x}_long") for x in ("hist", "scrape")),
        *(F.min(f"{x}_first").alias(f"{x}_first") for x in ("hist", "scrape")))
    kept_h, kept_s = (F.coalesce(F.col(c), F.lit(False)) for c in ("hist_first.rated", "scrape_first.allowed"))
    steps = {
        "historical": [("bronze", F.sum("hist")), ("length_filter", F.sum("hist_long")),
                       ("dedup", F.count("hist_first")), ("date_filter", F.count_if("hist_first.dated")),
                       ("rating_filter", F.count_if(kept_h))],
        "scrape": [("bronze", F.sum("scrape")), ("length_filter", F.sum("scrape_long")),
                   ("dedup", F.count("scrape_first")), ("app_filter", F.count_if(kept_s))],
        "gold": [("union", F.count_if(kept_h) + F.count_if(kept_s)), ("cross_source_dedup", F.count_if(kept_h | kept_s))],
    }
    told = by_id.agg(*(F.coalesce(n, F.lit(0)).cast("long").alias(f"{layer}_{k}")
                       for layer, named in steps.items() for k, (_, n) in enumerate(named)))
    rows = []
    for layer in sorted(steps):
        for k, (step, _) in enumerate(steps[layer]):
            before, now = F.col(f"{layer}_{max(k - 1, 0)}"), F.col(f"{layer}_{k}")
            rows.append(F.struct(F.lit(layer).alias("layer"), F.lit(k).cast("long").alias("seq"), F.lit(step).alias("step"),
                                 before.alias("rows_in"), now.alias("rows_out"), (before - now).alias("dropped")))
    return told.select(F.inline(F.array(*rows))).orderBy("layer", "seq")
