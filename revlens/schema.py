"""Explicit schemas: raw landing files, the gold review table, feed items.

Nothing is inferred: CSV inference is slow at scale and XML inference turns
titles such as "T1" into timestamps.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Timestamps are wall-clock UTC without a zone (TIMESTAMP_NTZ), like the
# source tables and the study's DATETIME columns.
S, I, L, TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Gold review table, 13 columns in this order.
GOLD = _struct(
    ("review_id", S), ("app", S), ("data_source", S), ("date", TS), ("year", I),
    ("year_month", S), ("rating", I), ("review_text", S), ("thumbs_up", I),
    ("reply_text", S), ("reply_date", TS), ("user_name", S), ("app_version", S),
)
GOLD_COLUMNS = tuple(GOLD.fieldNames())

# Historical review export (one file per app x listing), before renaming.
RAW_HISTORICAL = _struct(
    ("reviewId", S), ("userName", S), ("userImage", S), ("content", S),
    ("score", I), ("thumbsUpCount", I), ("reviewCreatedVersion", S),
    ("at", S), ("replyContent", S), ("repliedAt", S),
)

# Rename map from the historical export to gold names.
HISTORICAL_RENAME = {
    "reviewId": "review_id",
    "userName": "user_name",
    "content": "review_text",
    "score": "rating",
    "thumbsUpCount": "thumbs_up",
    "reviewCreatedVersion": "app_version",
    "at": "date",
    "replyContent": "reply_text",
    "repliedAt": "reply_date",
}

# Fresh scrape landing file (already in gold names, no reply columns).
RAW_SCRAPE = _struct(
    ("app", S), ("review_id", S), ("date", S), ("rating", I),
    ("review_text", S), ("thumbs_up", I), ("app_version", S),
)

# One RSS <item>; every field read as text.
FEED_ITEM = _struct(("title", S), ("link", S), ("source", S), ("pubDate", S))

# Landed news table.
NEWS = _struct(("query", S), ("date", S), ("title", S), ("source", S), ("url", S))
