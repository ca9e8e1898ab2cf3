"""The report family: one public function per question, ``DataFrame -> DataFrame``.

Inputs are the gold review table (``gold``) and, for complaint reports, the
classified negatives (``neg``: review_id, app, data_source, year, year_month,
complaint_category).  Every report aggregates first: the only full-size
shuffle is the final hash aggregation, and Spark combines map-side first,
so a hot app / year / category reaches the shuffle as one partial row per
map task.  Windows (shares, ranks, LAG, running totals) then run on the
aggregated rows (apps x years x categories), never on reviews.

Output types follow one rule: counts, ranks, years and days are BIGINT;
averages and percentages are DOUBLE, rounded half away from zero exactly
(``revlens.functions.rounding``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.classify import direction, era, era_display, is_negative, is_positive
from revlens.functions.reply import days_to_reply, was_replied
from revlens.functions.rounding import round_ratio, round_units, units_to_double
from revlens.functions.text import trimmed_length
from revlens.operators.windows import previous, rank_within, running_total, share_of_partition
from revlens.params import Params

BIG = "DECIMAL(38,0)"


def literal_alternation(patterns) -> str:
    """Java regex matching any of the literal substrings."""
    return "|".join("\\Q" + p + "\\E" for p in patterns)


#: Collation under which text that differs in case only is equal.
NOCASE = "UTF8_LCASE"


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def category_column(category: str, params: Params) -> str:
    """Column name of a category count in the monthly deep dive."""
    s = slug(category)
    return f"{s}_complaints" if category == params.fallback_category else s


def era_column(era_code: str, params: Params) -> str:
    return slug(params.era_labels.get(era_code, era_code))


def _avg(s: str, n: str, k: int = 2) -> Column:
    return round_ratio(s, n, k)


def _pct(part: str, whole: str) -> Column:
    return round_ratio(part, whole, 1, scale=100)


# --------------------------------------------------------------------------
# P0, P1, P2 and derived metrics: no text is read (column pruning keeps
# review_text out of the scan).
# --------------------------------------------------------------------------

def import_check(gold: DataFrame, nocase: bool = False) -> DataFrame:
    """Rows, average rating and date range per app.  ``nocase``: names that
    differ in case only are one app, as under the study's database collation;
    it is shown under the first of its spellings."""
    key, name = ([F.collate("app", NOCASE).alias("_app")], [F.min("app").alias("app")]) if nocase else (["app"], [])
    a = gold.groupBy(*key).agg(
        *name,
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum("rating").alias("_s"), F.count("rating").alias("_n"),
        F.min("date").alias("earliest_review"), F.max("date").alias("latest_review"))
    return a.select("app", "total_reviews", _avg("_s", "_n").alias("avg_rating"),
                    "earliest_review", "latest_review").orderBy("app")


def ratings_overview(gold: DataFrame, params: Params) -> DataFrame:
    """Volume, average, sentiment counts and shares per app, worst first."""
    r = F.col("rating")
    a = gold.groupBy("app").agg(
        F.count("review_id").alias("total_reviews"),
        F.sum("rating").alias("_s"), F.count("rating").alias("_n"),
        F.count_if(is_negative(r, params)).alias("negative_count"),
        F.count_if((r > params.negative_max_rating) & (r < params.positive_min_rating))
         .alias("neutral_count"),
        F.count_if(is_positive(r, params)).alias("positive_count"))
    return a.select(
        "app", "total_reviews", _avg("_s", "_n").alias("avg_rating"),
        "negative_count", "neutral_count", "positive_count",
        _pct("negative_count", "total_reviews").alias("negative_pct"),
        _pct("positive_count", "total_reviews").alias("positive_pct"),
    ).orderBy("avg_rating", "app")


def rating_trend_yearly(gold: DataFrame, params: Params) -> DataFrame:
    """Per app and year: volume, average, previous year's average (the
    previous *row*, so gaps are bridged), change and direction."""
    lo, hi = params.trend_years
    a = (gold.where(F.col("year").between(lo, hi))
             .groupBy("app", "year")
             .agg(F.count("review_id").alias("review_count"),
                  F.sum("rating").alias("_s"), F.count("rating").alias("_n")))
    a = a.withColumn("_u", round_units("_s", "_n", 2))
    a = a.withColumn("_pu", previous("_u", ["app"], "year"))
    out = a.select(
        "app", F.col("year").cast("long").alias("year"), "review_count",
        units_to_double(F.col("_u"), 2).alias("avg_rating"),
        units_to_double(F.col("_pu"), 2).alias("prev_year_rating"),
        units_to_double(F.col("_u") - F.col("_pu"), 2).alias("rating_change"))
    return (out.withColumn("direction", direction("avg_rating", "prev_year_rating",
                                                  params.direction_epsilon))
               .orderBy("app", "year"))


def worst_year(trend: DataFrame) -> DataFrame:
    """M4: the lowest-rated year per app (earliest year on ties)."""
    best = F.min_by(F.struct("year", "avg_rating"), F.struct("avg_rating", "year"))
    return (trend.where(F.col("avg_rating").isNotNull()).groupBy("app").agg(best.alias("_w"))
                 .select("app", F.col("_w.year").alias("worst_year"),
                         F.col("_w.avg_rating").alias("worst_avg_rating"))
                 .orderBy("app"))


def last_rating_per_app(trend: DataFrame) -> DataFrame:
    """The latest year's average per app (chart end label)."""
    last = F.max_by(F.struct("year", "avg_rating"), "year")
    return (trend.groupBy("app").agg(last.alias("_l"))
                 .select("app", F.col("_l.year").alias("last_year"),
                         F.col("_l.avg_rating").alias("last_avg_rating"))
                 .orderBy("app"))


def source_bias_profile(gold: DataFrame) -> DataFrame:
    """Rows and average rating per app x data source."""
    a = gold.groupBy("app", "data_source").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.sum("rating").alias("_s"), F.count("rating").alias("_n"))
    return (a.select("app", "data_source", "review_count", _avg("_s", "_n").alias("avg_rating"))
             .orderBy("app", "data_source"))


def layer_profile(gold: DataFrame) -> DataFrame:
    """Rows, year range and average rating per app."""
    a = gold.groupBy("app").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("year").cast("long").alias("min_year"), F.max("year").cast("long").alias("max_year"),
        F.count_distinct("data_source").alias("sources"),
        F.sum("rating").alias("_s"), F.count("rating").alias("_n"))
    return (a.select("app", "rows", "min_year", "max_year", "sources",
                     _avg("_s", "_n").alias("avg_rating"))
             .orderBy("app"))


def distinct_values(gold: DataFrame) -> DataFrame:
    """The distinct apps, years and sources, with their rows, in one scan:
    each row gives its three (column, value) pairs, counted before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in ("app", "year", "data_source")))
    return (gold.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
                .orderBy("column", "value"))


# --------------------------------------------------------------------------
# Complaint reports over classified negatives
# --------------------------------------------------------------------------

def complaint_categories(neg: DataFrame) -> DataFrame:
    """Per app and category: count, share of the app's negatives, rank."""
    a = neg.groupBy("app", "complaint_category").agg(
        F.count("review_id").alias("complaint_count"))
    a = share_of_partition(a, "complaint_count", ["app"], "pct_of_app_negatives")
    a = rank_within(a, ["app"], [F.desc("complaint_count")], "rank_within_app")
    return a.orderBy("app", "rank_within_app", "complaint_category")


def category_ratio(neg: DataFrame, params: Params) -> DataFrame:
    """M2: per category, share of negatives in app A vs app B and the ratio
    of the two (unrounded) shares, 1 dp; NULL when B has none."""
    _, app_a, app_b = params.category_ratio
    a = (neg.where(F.col("app").isin(app_a, app_b))
            .groupBy("complaint_category")
            .agg(F.count_if(F.col("app") == app_a).alias("count_a"),
                 F.count_if(F.col("app") == app_b).alias("count_b")))
    # totals over at most len(categories) aggregated rows
    w = Window.partitionBy()
    a = a.withColumns({"_ta": F.sum("count_a").over(w), "_tb": F.sum("count_b").over(w)})
    ratio = round_ratio(f"CAST(count_a AS {BIG}) * _tb", f"CAST(_ta AS {BIG}) * count_b", 1)
    return (a.select("complaint_category", F.lit(app_a).alias("app_a"), F.lit(app_b).alias("app_b"),
                     "count_a", "count_b",
                     _pct("count_a", "_ta").alias("pct_a"), _pct("count_b", "_tb").alias("pct_b"),
                     ratio.alias("share_ratio"))
             .orderBy("complaint_category"))


def word_frequency(gold: DataFrame, params: Params) -> DataFrame:
    """Top words of negative reviews that mention none of the excluded
    substrings; tokens are split on single spaces, longer than 3 chars.
    Ties at the cut are broken by the word itself."""
    t = F.lower("review_text")
    neg = gold.where(is_negative("rating", params)
                     & (trimmed_length("review_text") >= params.min_complaint_chars))
    # one quoted-literal alternation: the filter is pushed below the
    # projection, and separate contains() tests would each re-lower the text
    low = neg.select(t.alias("_t")).where(~F.col("_t").rlike(literal_alternation(params.word_count_excluded)))
    return _top_words(low, params)


def word_frequency_of(texts: DataFrame, neg: DataFrame, category: str, params: Params) -> DataFrame:
    """P4 over the negatives that the classifier puts in ``category`` (the
    fallback: what no pattern explains), instead of the excluded substrings.
    A semi join on review id; with both sides bucketed by it
    (``testdata.negatives_by_id``) nothing is moved before the count."""
    ids = neg.where(F.col("complaint_category") == category).select("review_id")
    return _top_words(texts.join(ids, "review_id", "left_semi").select(F.lower("review_text").alias("_t")), params)


def _top_words(lowered: DataFrame, params: Params) -> DataFrame:
    words = lowered.select(F.explode(F.split("_t", " ")).alias("word")).where(
        F.length("word") >= params.min_word_chars)
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
                 .orderBy(F.desc("frequency"), "word").limit(params.word_count_top))


def monthly_deepdive(neg: DataFrame, params: Params) -> DataFrame:
    """P5: per deep-dive app and month: negatives, one count column per
    category (long -> wide in the same aggregation) and the running total."""
    cat = F.col("complaint_category")
    counts = [F.sum(F.when(cat == c, 1).otherwise(0)).alias(category_column(c, params))
              for c in params.categories]
    a = (neg.where(F.col("app").isin(*params.deep_dive_apps))
            .groupBy("app", "year_month")
            .agg(F.count("review_id").alias("total_negative"), *counts))
    a = a.withColumn("running_total_negative",
                     running_total("total_negative", ["app"], "year_month"))
    return a.orderBy("app", "year_month")


def monthly_slice(deep: DataFrame, params: Params, app: str | None = None) -> DataFrame:
    """The deep dive without months of the excluded prefix,
    optionally for one app."""
    out = deep.where(~F.col("year_month").startswith(params.excluded_month_prefix))
    return out.where(F.col("app") == app) if app else out


def period_change(deep: DataFrame, params: Params) -> DataFrame:
    """M1: % change of monthly negatives between two months, per app."""
    _, m1, m2 = params.period_change
    ym, n = F.col("year_month"), F.col("total_negative")
    a = deep.groupBy("app").agg(F.max(F.when(ym == m1, n)).alias("from_count"),
                                F.max(F.when(ym == m2, n)).alias("to_count"))
    return (a.select("app", F.lit(m1).alias("from_month"), F.lit(m2).alias("to_month"),
                     "from_count", "to_count",
                     round_ratio("to_count - from_count", "from_count", 1, scale=100)
                     .alias("pct_change"))
             .orderBy("app"))


# --------------------------------------------------------------------------
# Company replies
# --------------------------------------------------------------------------

def response_summary(gold: DataFrame, params: Params) -> DataFrame:
    """Reply rate, rating with / without reply, reply latency, rank."""
    f = (gold.where(F.col("data_source").isin(*params.reply_sources))
             .select("app", "review_id", "rating",
                     was_replied().alias("was_replied"), days_to_reply().alias("days")))
    rep, r = F.col("was_replied"), F.col("rating")
    a = f.groupBy("app").agg(
        F.count("review_id").alias("total_reviews"),
        F.sum("was_replied").alias("replied_count"),
        F.sum(r).alias("_s"), F.count(r).alias("_n"),
        F.sum(F.when(rep == 1, r)).alias("_sr"), F.count(F.when(rep == 1, r)).alias("_nr"),
        F.sum(F.when(rep == 0, r)).alias("_sn"), F.count(F.when(rep == 0, r)).alias("_nn"),
        F.sum("days").alias("_sd"), F.count("days").alias("_nd"),
        F.min("days").alias("min_days_to_reply"), F.max("days").alias("max_days_to_reply"))
    a = a.select(
        "app", "total_reviews", "replied_count",
        _pct("replied_count", "total_reviews").alias("response_rate_pct"),
        _avg("_s", "_n").alias("avg_rating_all"),
        _avg("_sr", "_nr").alias("avg_rating_replied"),
        _avg("_sn", "_nn").alias("avg_rating_not_replied"),
        units_to_double(round_units("_sr", "_nr", 2) - round_units("_sn", "_nn", 2), 2)
        .alias("reply_impact_on_rating"),
        _avg("_sd", "_nd", 1).alias("avg_days_to_reply"),
        "min_days_to_reply", "max_days_to_reply")
    # one row per app: a global window over a handful of rows
    a = rank_within(a, [], [F.desc("response_rate_pct")], "response_rank")
    return a.orderBy(F.desc("response_rate_pct"), "app")


def response_by_year(gold: DataFrame, params: Params) -> DataFrame:
    """Reply rate per app and year and its change from the previous row
    (change of the unrounded rates, then rounded)."""
    lo, hi = params.response_years
    a = (gold.where(F.col("data_source").isin(*params.reply_sources)
                    & F.col("year").between(lo, hi))
             .groupBy("app", "year")
             .agg(F.count("review_id").alias("total_reviews"),
                  F.sum(was_replied()).alias("replied_count")))
    a = a.withColumns({"_r0": previous("replied_count", ["app"], "year"),
                       "_n0": previous("total_reviews", ["app"], "year")})
    change = round_ratio(
        f"(CAST(replied_count AS {BIG}) * _n0 - CAST(_r0 AS {BIG}) * total_reviews)",
        f"(CAST(total_reviews AS {BIG}) * _n0)", 1, scale=100)
    return (a.select("app", F.col("year").cast("long").alias("year"), "total_reviews",
                     "replied_count", _pct("replied_count", "total_reviews").alias("response_rate_pct"),
                     change.alias("response_rate_change"))
             .orderBy("app", "year"))


# --------------------------------------------------------------------------
# Eras
# --------------------------------------------------------------------------

def _era_bounds(params: Params) -> tuple[int, int]:
    return min(lo for _, lo, _ in params.eras), max(hi for _, _, hi in params.eras)


def with_era(df: DataFrame, params: Params) -> DataFrame:
    """Era column, rows outside every era dropped.  The outer year bounds
    are a plain range predicate so ``year`` partitions are pruned."""
    lo, hi = _era_bounds(params)
    return (df.where(F.col("year").between(lo, hi))
              .withColumn("era", era("year", params)).where(F.col("era").isNotNull()))


def era_sentiment(gold: DataFrame, params: Params) -> DataFrame:
    """P8 (+ M5): sentiment per app and era; ``sample_data_source`` is the
    greatest source name (as defined), ``most_common_source`` the mode
    (lowest name on ties)."""
    r = F.col("rating")
    a = with_era(gold, params).groupBy("app", "era").agg(
        F.count("review_id").alias("total_reviews"),
        F.sum(r).alias("_s"), F.count(r).alias("_n"),
        F.count_if(is_negative(r, params)).alias("negative_count"),
        F.count_if(is_positive(r, params)).alias("positive_count"),
        F.sum("thumbs_up").alias("_st"), F.count("thumbs_up").alias("_nt"),
        F.max("data_source").alias("sample_data_source"),
        F.mode("data_source", deterministic=True).alias("most_common_source"))
    return a.select(
        "app", "era", "total_reviews", _avg("_s", "_n").alias("avg_rating"),
        "negative_count", _pct("negative_count", "total_reviews").alias("negative_pct"),
        "positive_count", _pct("positive_count", "total_reviews").alias("positive_pct"),
        _avg("_st", "_nt", 1).alias("avg_thumbs_up"),
        "sample_data_source", "most_common_source",
    ).orderBy("app", "era")


def era_complaints(neg: DataFrame, params: Params) -> DataFrame:
    """Per app, era and category: count, share of the era's negatives,
    rank within the era (ties share a rank)."""
    a = (with_era(neg, params).groupBy("app", "era", "complaint_category")
             .agg(F.count("review_id").alias("complaint_count")))
    a = share_of_partition(a, "complaint_count", ["app", "era"], "pct_of_era_negatives")
    a = rank_within(a, ["app", "era"], [F.desc("complaint_count")], "rank_in_era")
    return a.orderBy("app", "era", "rank_in_era", "complaint_category")


def era_top_complaint(neg: DataFrame, params: Params) -> DataFrame:
    """The top *named* complaint per app and era.  The fallback
    category is removed before the shares, so the denominator shrinks; all
    categories tied at rank 1 are returned."""
    a = (with_era(neg, params)
             .where(F.col("complaint_category") != params.fallback_category)
             .groupBy("app", "era", "complaint_category")
             .agg(F.count("review_id").alias("complaint_count")))
    a = share_of_partition(a, "complaint_count", ["app", "era"], "pct_of_negatives")
    a = rank_within(a, ["app", "era"], [F.desc("complaint_count")], "_rnk")
    return (a.where(F.col("_rnk") == 1)
             .select("app", "era", F.col("complaint_category").alias("top_complaint"),
                     "complaint_count", "pct_of_negatives")
             .orderBy("app", "era", "top_complaint"))


def relabel(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    """Replace category values (e.g. the fallback's display name)."""
    return df.replace(mapping, subset=[col]) if mapping else df


def era_heatmap(era_cmp: DataFrame, params: Params) -> DataFrame:
    """App x category rows, one share column per era (display
    label order).  0 where the era has negatives but not this category;
    NULL where the app has no negatives in that era at all."""
    d = relabel(era_cmp, "complaint_category", params.category_relabel)
    codes = [e for e, _, _ in params.eras]
    d = d.withColumns({f"_has{i}": F.max(F.when(F.col("era") == e, 1)).over(Window.partitionBy("app"))
                       for i, e in enumerate(codes)})
    aggs = []
    for i, e in enumerate(codes):
        aggs.append(F.max(F.when(F.col("era") == e, F.col("pct_of_era_negatives"))).alias(f"_v{i}"))
        aggs.append(F.max(f"_has{i}").alias(f"_h{i}"))
    a = d.groupBy("app", "complaint_category").agg(*aggs)
    cols = [F.when(F.col(f"_h{i}") == 1, F.coalesce(F.col(f"_v{i}"), F.lit(0.0)))
            .alias(era_column(e, params)) for i, e in enumerate(codes)]
    return a.select("app", "complaint_category", *cols).orderBy("app", "complaint_category")


def era_summary_grid(top: DataFrame, params: Params) -> DataFrame:
    """App rows, per era the top complaint (alphabetically first among
    ties) and its share."""
    aggs = []
    for e, _, _ in params.eras:
        c = era_column(e, params)
        hit = F.col("era") == e
        aggs.append(F.min(F.when(hit, F.col("top_complaint"))).alias(f"{c}_top"))
        aggs.append(F.max(F.when(hit, F.col("pct_of_negatives"))).alias(f"{c}_pct"))
    return top.groupBy("app").agg(*aggs).orderBy("app")


def era_labels(df: DataFrame, params: Params) -> DataFrame:
    """Add the display label of each era code."""
    return df.withColumn("era_label", era_display("era", params))


# --------------------------------------------------------------------------
# The nine-result suite
# --------------------------------------------------------------------------

SUITE_NAMES = (
    ("q1_ratings_overview", 1), ("q2_ratings_trend", 1), ("q3_complaint_categories", 1),
    ("q4_paytm_deepdive", 1), ("q5_response_analysis", 1), ("q5_response_analysis", 2),
    ("q6_era_comparison", 1), ("q6_era_comparison", 2), ("q6_era_comparison", 3),
)


def suite(gold: DataFrame, neg: DataFrame, params: Params) -> dict[str, DataFrame]:
    """The nine result sets, named ``{prefix}_result{n}``."""
    frames = [ratings_overview(gold, params), rating_trend_yearly(gold, params),
              complaint_categories(neg), monthly_deepdive(neg, params),
              response_summary(gold, params), response_by_year(gold, params),
              era_sentiment(gold, params), era_complaints(neg, params),
              era_top_complaint(neg, params)]
    return {f"{p}_result{n}": df for (p, n), df in zip(SUITE_NAMES, frames)}
