"""SQL access: the gold table, the classified negatives and the nine result
sets as temporary views, so ad-hoc questions are plain Spark SQL
(``SELECT ... FROM reviews``), planned by Catalyst like the DataFrame
reports.  T-SQL idioms map as: ``LEN`` -> ``length``, ``TOP n`` ->
``LIMIT n``, ``DATEDIFF(day, a, b)`` -> ``datediff(b, a)``,
``CROSS APPLY STRING_SPLIT(x, ' ')`` -> ``LATERAL VIEW explode(split(x, ' '))``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlens.params import Params
from revlens.plans import reports


def register_views(gold: DataFrame, neg: DataFrame, params: Params) -> list[str]:
    """Register ``reviews``, ``classified_negatives`` and one view per
    result set (``q1_ratings_overview_result1`` ...); returns the names."""
    gold.createOrReplaceTempView("reviews")
    neg.createOrReplaceTempView("classified_negatives")
    names = ["reviews", "classified_negatives"]
    for name, df in reports.suite(gold, neg, params).items():
        df.createOrReplaceTempView(name)
        names.append(name)
    return names
