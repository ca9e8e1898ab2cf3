"""Date parsing and formatting (tolerant: bad input becomes NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.constants import RFC822_GMT, RFC822_LOCAL, RFC822_ZONED

# Accepted spellings of a review timestamp: a day; day and time with or without
# seconds, fraction and offset.
ISO_TS = (r"^\d{4}-\d{2}-\d{2}"
          r"([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$")
MONTH_FIRST_FORMATS = ("MM/dd/yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c) -> Column:
    """``ISO_TS`` or month-first ``MM/dd/yyyy[ HH:mm[:ss]]`` text; NULL for
    anything else (never raises under ANSI).  Wall-clock time without a zone
    (TIMESTAMP_NTZ); a value with an offset is taken as its instant in UTC,
    the session's zone.

    Text of no accepted shape is never parsed (a failed parse is the
    expensive path).  Spellings left out: month names, compact ``yyyyMMdd``,
    day-first dates, 12-hour clocks, epoch numbers."""
    s = F.trim(_c(c).cast("string"))
    month_first = F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in MONTH_FIRST_FORMATS))
    return (F.when(s.rlike(ISO_TS), s.try_cast("timestamp"))
             .when(s.contains("/"), month_first).cast("timestamp_ntz"))


def parse_rfc822(c) -> Column:
    """``Tue, 03 Jan 2023 10:00:00 +0530`` or ``... GMT`` -> UTC timestamp.
    The weekday prefix is dropped (the parser rejects pattern letter E)."""
    s = F.regexp_replace(F.trim(_c(c)), r"^[A-Za-z]{3},\s*", "")
    # only the 'GMT' spelling can end in " GMT" and only the zoned one can
    # end otherwise, so one parse per value; parsed as an instant, then kept
    # as UTC wall-clock time (session tz UTC)
    return (F.when(s.endswith(" GMT"), F.try_to_timestamp(s, F.lit(RFC822_GMT)))
             .otherwise(F.try_to_timestamp(s, F.lit(RFC822_ZONED)))
             .cast("timestamp_ntz"))


def rfc822_local(c, instant=None) -> Column:
    """The wall-clock time written in an RFC-822 date, zone ignored (for a
    ``+0530`` date: the local time there).  NULL when the date does not
    parse as an instant (pass ``instant`` when it is already parsed, so the
    text is not parsed twice).  The feed reports an item's day in its own
    zone."""
    s = F.regexp_replace(F.trim(_c(c)), r"^[A-Za-z]{3},\s*", "")
    local = (F.when(s.endswith(" GMT"), F.try_to_timestamp(s, F.lit(RFC822_GMT)))
              .otherwise(F.try_to_timestamp(F.regexp_replace(s, r" [+-][0-9]{4}$", ""),
                                            F.lit(RFC822_LOCAL))))
    ok = (parse_rfc822(c) if instant is None else _c(instant)).isNotNull()
    return F.when(ok, local.cast("timestamp_ntz"))


def fmt_day(c) -> Column:
    """``yyyy-MM-dd`` or '' when missing."""
    return F.coalesce(F.date_format(_c(c), "yyyy-MM-dd"), F.lit(""))


def fmt_ts(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


def add_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Precomputed ``year`` (int) and ``year_month`` (``yyyy-MM``, NULL for a
    missing date)."""
    return df.withColumns({
        "year": F.year(date_col).cast("int"),
        "year_month": F.date_format(date_col, "yyyy-MM"),
    })
