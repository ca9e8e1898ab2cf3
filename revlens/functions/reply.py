"""Company-reply rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions.text import is_non_blank


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def was_replied(reply_text="reply_text") -> Column:
    """1 when the reply text is present and not blank after trimming, else 0."""
    return F.when(is_non_blank(reply_text), 1).otherwise(0)


def days_to_reply(reply_text="reply_text", reply_date="reply_date", date="date") -> Column:
    """Calendar-day boundaries crossed between review and reply, only when a
    reply text exists (a blank one counts), both timestamps are present and
    the reply is strictly later; otherwise NULL.  A later reply on the same
    day is 0, 23:59 -> 00:01 is 1."""
    rt, rd, d = _c(reply_text), _c(reply_date), _c(date)
    ok = rt.isNotNull() & rd.isNotNull() & d.isNotNull() & (rd > d)
    return F.when(ok, F.datediff(rd, d).cast("long"))
