"""Gold-table quality checks (K1-K7) as a DataFrame ``(check, passed, observed)``.

One aggregation pass computes every check (the distinct id count is a
partially-aggregated distinct, so a hot id is combined map-side); the app
check compares counts against the allow-list instead of collecting the set
of app values, so nothing unbounded is gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.params import Params


class ValidationError(RuntimeError):
    pass


def validate(gold: DataFrame, params: Params) -> DataFrame:
    lo, hi = params.valid_years
    apps = list(params.apps)
    r, y = F.col("rating"), F.col("year")
    a = gold.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("review_id").alias("unique_ids"),
        F.count_if(~F.coalesce(r.between(1, 5), F.lit(False))).alias("bad_ratings"),
        F.min(r).alias("min_rating"), F.max(r).alias("max_rating"),
        F.count_if(F.col("date").isNull()).alias("null_dates"),
        F.count_if(F.col("review_text").isNull()).alias("null_texts"),
        F.count_if(~F.coalesce(F.col("app").isin(*apps), F.lit(False))).alias("foreign_apps"),
        *[F.count_if(F.col("app") == x).alias(f"_app{i}") for i, x in enumerate(apps)],
        F.count_if(~F.coalesce(y.between(lo, hi), F.lit(False))).alias("bad_years"),
        F.min(y).alias("min_year"), F.max(y).alias("max_year"),
    )
    missing = F.concat_ws(",", F.array_compact(F.array(
        *[F.when(F.col(f"_app{i}") == 0, F.lit(x)) for i, x in enumerate(apps)])))
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    checks = [
        ("No duplicate review_ids", F.col("unique_ids") == F.col("total"),
         F.concat(s("unique_ids"), F.lit(" unique / "), s("total"), F.lit(" total"))),
        ("All ratings 1-5", F.col("bad_ratings") == 0,
         F.concat(F.lit("Min="), s("min_rating"), F.lit(" Max="), s("max_rating"))),
        ("No null dates", F.col("null_dates") == 0, F.concat(F.lit("Null dates: "), s("null_dates"))),
        ("No null review_text", F.col("null_texts") == 0,
         F.concat(F.lit("Null texts: "), s("null_texts"))),
        (f"Only {len(apps)} apps", (F.col("foreign_apps") == 0) & (missing == ""),
         F.concat(F.lit("Foreign rows: "), s("foreign_apps"), F.lit(" Missing: "), missing)),
        (f"Year range {lo}-{hi}", F.col("bad_years") == 0,
         F.concat(F.lit("Years: "), s("min_year"), F.lit("-"), s("max_year"))),
        (f"At least {params.min_gold_rows:,} rows", F.col("total") >= params.min_gold_rows,
         F.concat(F.lit("Total: "), s("total"))),
    ]
    rows = [F.struct(F.lit(i + 1).cast("long").alias("seq"), F.lit(n).alias("check"),
                     c.alias("passed"), o.alias("observed"))
            for i, (n, c, o) in enumerate(checks)]
    return a.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def require(report: DataFrame) -> None:
    """Raise when any check failed (``strict`` mode).  Collects the 7-row
    report only."""
    failed = [r["check"] for r in report.where(~F.col("passed")).collect()]
    if failed:
        raise ValidationError(f"failed checks: {failed}")
