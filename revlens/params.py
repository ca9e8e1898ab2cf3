"""Report parameters.

Every report takes a ``Params``: the lexicon, eras, apps, year bounds and
source tags.  ``REFERENCE`` carries the study's fixed values; ``FIXTURE``
re-aims the same reports at the driver's synthetic tables (orders from
1995-2001, three order statuses as apps, invented prose as review text).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from revlens import constants as K

Lexicon = tuple[tuple[str, tuple[str, ...]], ...]
Eras = tuple[tuple[str, int, int], ...]


@dataclass(frozen=True)
class Params:
    lexicon: Lexicon = K.COMPLAINT_LEXICON
    fallback_category: str = K.FALLBACK_CATEGORY
    word_count_excluded: tuple[str, ...] = K.WORD_COUNT_EXCLUDED
    eras: Eras = K.ERAS
    era_labels: dict = field(default_factory=lambda: dict(K.ERA_DISPLAY_LABELS))
    apps: tuple[str, ...] = K.APPS
    scrape_apps: tuple[str, ...] = K.SCRAPE_APPS
    reply_sources: tuple[str, ...] = K.REPLY_SOURCES
    deep_dive_apps: tuple[str, ...] = K.DEEP_DIVE_APPS
    trend_years: tuple[int, int] = K.TREND_YEARS
    response_years: tuple[int, int] = K.RESPONSE_YEARS
    valid_years: tuple[int, int] = K.VALID_YEARS
    min_gold_rows: int = K.MIN_GOLD_ROWS
    category_relabel: dict = field(default_factory=lambda: dict(K.CATEGORY_RELABEL))
    excluded_month_prefix: str = K.EXCLUDED_MONTH_PREFIX
    negative_max_rating: int = K.NEGATIVE_MAX_RATING
    positive_min_rating: int = K.POSITIVE_MIN_RATING
    min_complaint_chars: int = K.MIN_COMPLAINT_CHARS
    min_review_chars: int = K.MIN_REVIEW_CHARS
    min_word_chars: int = K.MIN_WORD_CHARS
    word_count_top: int = K.WORD_COUNT_TOP
    direction_epsilon: float = K.DIRECTION_EPSILON
    # (app, category, first month, second month) for the period-change metric
    period_change: tuple[str, str, str] = ("Paytm", "2023-01", "2023-06")
    # (category, app with the larger share, app with the smaller share)
    category_ratio: tuple[str, str, str] = ("Regulatory Issues", "Paytm", "GPay")

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    @property
    def categories(self) -> tuple[str, ...]:
        """All output categories in priority order, fallback last."""
        return tuple(c for c, _ in self.lexicon) + (self.fallback_category,)


REFERENCE = Params()

# Lexicon for the synthetic prose: the 48 study patterns hardly occur in it,
# so this one is chosen to hit every category (hits at sf0.01 in brackets in
# FIXTURES.md).  Same shape, same first-match semantics.
FIXTURE_LEXICON: Lexicon = (
    ("Payment Failures", ("license", "apache")),
    ("Trust & Security", ("@", "mail")),
    ("Technical Failures", ("token", "+")),
    ("Customer Support", ("!!", "###")),
    ("Regulatory Issues", ("mit",)),
    ("UX Problems", ("with",)),
)
FIXTURE_ERAS: Eras = (
    ("1_Early (1995-1996)", 1995, 1996),
    ("2_Crisis (1997-1998)", 1997, 1998),
    ("3_Recovery (1999-2001)", 1999, 2001),
)

FIXTURE = Params(
    lexicon=FIXTURE_LEXICON,
    eras=FIXTURE_ERAS,
    era_labels={
        "1_Early (1995-1996)": "Early\n1995-96",
        "2_Crisis (1997-1998)": "Crisis\n1997-98",
        "3_Recovery (1999-2001)": "Recovery\n1999-2001",
    },
    apps=("AppF", "AppO", "AppP"),
    scrape_apps=("AppF", "AppO", "AppP"),
    reply_sources=("help", "new"),
    deep_dive_apps=("AppF", "AppO"),
    trend_years=(1995, 2001),
    response_years=(1995, 1999),
    valid_years=(1995, 2001),
    min_gold_rows=1000,
    excluded_month_prefix="2001",
    period_change=("AppF", "1997-01", "1997-06"),
    category_ratio=("UX Problems", "AppF", "AppO"),
)
