"""Row classifiers: complaint category, sentiment, era, trend direction.

All are composed Column expressions (CASE WHEN chains), so they run inside
whole-stage codegen; there is no Python UDF on any path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.text import contains_any
from revlens.params import Params


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify(lowered_text, params: Params) -> Column:
    """First category (in lexicon order) whose any pattern is a substring of
    the already-lowered text; otherwise the fallback category.  Lowering is
    left to the caller so it happens once per row, not once per pattern."""
    t = _c(lowered_text)
    expr = None
    for category, patterns in params.lexicon:
        cond = contains_any(t, patterns)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    fallback = F.lit(params.fallback_category)
    return fallback if expr is None else expr.otherwise(fallback)


def sentiment(rating, params: Params) -> Column:
    r = _c(rating)
    return (F.when(r <= params.negative_max_rating, "negative")
            .when(r >= params.positive_min_rating, "positive")
            .when(r.isNotNull(), "neutral"))


def is_negative(rating, params: Params) -> Column:
    return _c(rating) <= params.negative_max_rating


def is_positive(rating, params: Params) -> Column:
    return _c(rating) >= params.positive_min_rating


def era(year, params: Params) -> Column:
    """Era label for a year; NULL outside every era."""
    y = _c(year)
    expr = None
    for label, lo, hi in params.eras:
        cond = y.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr if expr is not None else F.lit(None).cast("string")


def era_display(era_col, params: Params) -> Column:
    """Display label for an era code (NULL for unknown codes)."""
    m = F.create_map(*[F.lit(x) for kv in params.era_labels.items() for x in kv])
    return m[_c(era_col)]


def direction(cur, prev, eps: float) -> Column:
    """BASELINE / IMPROVED / DECLINED / STABLE with a +-eps band, compared as
    the double expressions ``prev + eps`` and ``prev - eps``."""
    c, p = _c(cur), _c(prev)
    return (F.when(p.isNull(), "BASELINE")
            .when(c > p + F.lit(eps), "IMPROVED")
            .when(c < p - F.lit(eps), "DECLINED")
            .otherwise("STABLE"))
