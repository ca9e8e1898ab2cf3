"""Classified negatives: the table that every complaint report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.classify import classify
from revlens.functions.text import trimmed_length
from revlens.params import Params


def negative_texts(gold_df: DataFrame, params: Params) -> DataFrame:
    """(review_id, review_text) of the negative, non-trivial reviews."""
    return gold_df.where((F.col("rating") <= params.negative_max_rating)
                         & (trimmed_length("review_text") >= params.min_complaint_chars)).select("review_id", "review_text")


def classified_negatives(gold_df: DataFrame, params: Params) -> DataFrame:
    """Negative, non-trivial reviews with their complaint category.  The
    filter runs first so only negatives pay for the substring tests, and the
    text is lowered once per row."""
    neg = gold_df.where((F.col("rating") <= params.negative_max_rating)
                        & (trimmed_length("review_text") >= params.min_complaint_chars))
    low = neg.select("review_id", "app", "data_source", "year", "year_month",
                     F.lower("review_text").alias("_t"))
    return low.select("review_id", "app", "data_source", "year", "year_month",
                      classify("_t", params).alias("complaint_category"))
