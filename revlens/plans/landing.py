"""Landing jobs: scraped reviews (P13) and news-feed items.

Only the table work after the fetch is in scope (HTTP fetching is not
rebuilt).  Both caps are the feature (newest N reviews per app, first N
items per feed query) and run as ``row_number() <= N``, planned as a
partial WindowGroupLimit before the shuffle, so a hot app or query sends
at most N rows per map task.  URL dedup across feed queries is a
map-side-combined ``min(query_idx)`` per URL and a semi join on
(url, query_idx); AQE splits a hot URL in that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.dates import fmt_day, parse_rfc822, rfc822_local
from revlens.functions.rounding import round_ratio
from revlens.functions.text import clean_text
from revlens.operators.dedup import dedup_first, dedup_first_by_rank
from revlens.operators.windows import top_n_per_group

SCRAPE_COLUMNS = ("app", "review_id", "date", "rating", "review_text", "thumbs_up", "app_version")


def scrape_landing(fetched: DataFrame, cutoff: str, cap: int,
                   app_order: tuple[str, ...] | None = None) -> DataFrame:
    """P13.  ``fetched``: app, review_id, date (timestamp), rating,
    review_text, thumbs_up, app_version.  Newest first per app (date desc,
    then review_id), stop at the first review older than ``cutoff``
    (take-while == filter on date-sorted input), keep at most ``cap`` per app
    *before* cleaning, then strip text, drop empty text, keep the first copy
    of each id (apps in ``app_order``, the order they were fetched in;
    alphabetical when not given), and format the day."""
    newest_first = [F.desc("date"), F.asc("review_id")]
    recent = fetched.where(F.col("date") >= F.lit(cutoff).cast("timestamp_ntz"))
    capped = top_n_per_group(recent, ["app"], newest_first, cap, rank_col="_rank")
    cleaned = (capped.withColumn("review_text", clean_text("review_text"))
                     .where(F.col("review_text") != ""))
    if app_order:
        pos = F.create_map(*[F.lit(x) for i, a in enumerate(app_order) for x in (a, i)])
        app_rank = F.coalesce(pos[F.col("app")], F.lit(len(app_order)))
    else:
        app_rank = F.lit(0)
    first = dedup_first(cleaned.withColumn("_app_rank", app_rank), ["review_id"], ["_app_rank", "app", "_rank"])
    return (first.select(
                "app", "review_id", fmt_day("date").alias("date"), "rating", "review_text",
                "thumbs_up", F.coalesce(F.col("app_version"), F.lit("")).alias("app_version"))
            .orderBy(F.asc("app"), F.desc("date"), F.asc("review_id")))


def landing_summary(landed: DataFrame) -> DataFrame:
    """Reviews and average rating (2 dp) per app."""
    a = landed.groupBy("app").agg(F.count("rating").alias("count"),
                                  F.sum("rating").alias("_s"))
    return (a.select("app", "count", round_ratio("_s", "count", 2).alias("average_rating"))
             .orderBy("app"))


def feed_items_with_dates(items: DataFrame) -> DataFrame:
    """B7 + A3 defaults: missing tags -> '', pubDate parsed to a UTC instant
    (``pub_ts``, NULL if it matches neither RFC-822 spelling) and to the
    wall-clock time written in it (``pub_local``, for the item's day)."""
    pub = F.coalesce("pubDate", F.lit(""))
    parsed = items.withColumns({
        "title": F.coalesce("title", F.lit("")),
        "link": F.coalesce("link", F.lit("")),
        "source": F.coalesce("source", F.lit("")),
        "pub_ts": parse_rfc822(pub),
    })
    return parsed.withColumn("pub_local", rfc822_local(pub, "pub_ts"))


def feed_landing(items: DataFrame, cutoff: str, cap: int) -> DataFrame:
    """P14.  ``items``: query, query_idx (position in the query list),
    position (feed order), title, link, source, pubDate (text).
    First ``cap`` items per query in feed order, *then* drop items with a
    known date before ``cutoff`` (unknown dates stay; compared as instants),
    then URL dedup: the first query (list order) that kept a URL wins and
    every copy of it in that query survives.  The day is the item's own
    (in its zone).  Sorted by day text, newest first, '' last."""
    capped = top_n_per_group(items, ["query_idx"], [F.col("position")], cap)
    dated = feed_items_with_dates(capped)
    kept = dated.where(F.col("pub_ts").isNull()
                       | (F.col("pub_ts") >= F.lit(cutoff).cast("timestamp_ntz")))
    first = dedup_first_by_rank(kept.withColumnRenamed("link", "url"), "url", "query_idx")
    return (first.select("query", fmt_day("pub_local").alias("date"), "title", "source", "url")
                 .orderBy(F.desc("date"), "query", "url"))


def feed_dedup(items: DataFrame) -> DataFrame:
    """E3 alone over the whole feed: rows of the first query per URL."""
    return dedup_first_by_rank(items.withColumnRenamed("link", "url"), "url", "query_idx")


def top_sources(news: DataFrame, n: int) -> DataFrame:
    """Most frequent sources (ties by name)."""
    return (news.groupBy("source").agg(F.count(F.lit(1)).alias("count"))
                .orderBy(F.desc("count"), "source").limit(n))
