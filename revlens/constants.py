"""Fixed values that must equal the reference study's definitions.

Everything in this module is a FIXED VALUE: the keyword lexicon, the era
table, the app allow-list, source tags and display labels are the study's
definitions, stated here as plain data in their natural (priority) order.
Reports never hard-code them; they receive them through ``revlens.params``.
"""

from __future__ import annotations

# --- FIXED VALUES: complaint lexicon (ordered; first matching category wins,
# --- every pattern is a case-insensitive substring of the review text) -------
COMPLAINT_LEXICON: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Payment Failures", (
        "money deduct", "amount deduct", "not received", "not credited",
        "transaction fail", "payment fail", "refund", "money stuck", "pending",
    )),
    ("Trust & Security", (
        "fraud", "scam", "cheat", "hack", "unauthori", "stolen", "fake",
    )),
    ("Technical Failures", (
        "crash", "not working", "not open", "not load", "error", "bug", "otp",
        "login", "server",
    )),
    ("Customer Support", (
        "customer care", "customer support", "no response", "not respond",
        "helpline", "no help", "complaint",
    )),
    ("Regulatory Issues", (
        "rbi", "kyc", "account block", "account suspend", "paytm bank",
        "payments bank", "license",
    )),
    ("UX Problems", (
        "slow", "ads", "advertisement", "confus", "difficult", "complicated",
        "useless", "worst app", "bad app",
    )),
)
FALLBACK_CATEGORY = "Other"

# --- FIXED VALUES: substrings excluded by the "unexplained negatives" word
# --- count (a 7-pattern subset, not the classifier's Other) ------------------
WORD_COUNT_EXCLUDED = (
    "deduct", "refund", "fraud", "crash", "customer care", "rbi", "slow",
)

# --- FIXED VALUES: eras (label, first year, last year), labels sort by digit --
ERAS: tuple[tuple[str, int, int], ...] = (
    ("1_Early (2018-2019)", 2018, 2019),
    ("2_Crisis (2020-2022)", 2020, 2022),
    ("3_Recovery (2023-2026)", 2023, 2026),
)
ERA_DISPLAY_LABELS = {
    "1_Early (2018-2019)": "Early\n2018-19",
    "2_Crisis (2020-2022)": "Crisis\n2020-22",
    "3_Recovery (2023-2026)": "Recovery\n2023-26",
}

# --- FIXED VALUES: apps, source tags, report bounds --------------------------
APPS = ("GPay", "Paytm", "PhonePe")
SCRAPE_APPS = ("Paytm", "BharatPe", "PhonePe", "GPay")   # scraper's app order
SCRAPE_SOURCE = "fresh_scrape_2026"
REPLY_SOURCES = ("kaggle_help", "kaggle_new")
DEEP_DIVE_APPS = ("Paytm", "PhonePe")
TREND_YEARS = (2018, 2026)
RESPONSE_YEARS = (2018, 2023)
VALID_YEARS = (2018, 2026)
MIN_GOLD_ROWS = 150_000
CATEGORY_RELABEL = {"Other": "General Dissatisfaction"}
EXCLUDED_MONTH_PREFIX = "2026"

# --- FIXED VALUES: thresholds in the report definitions -----------------------
NEGATIVE_MAX_RATING = 2          # rating <= 2 is negative
POSITIVE_MIN_RATING = 4          # rating >= 4 is positive
MIN_COMPLAINT_CHARS = 10         # LEN(TRIM(text)) >= 10 in complaint reports
MIN_REVIEW_CHARS = 5             # cleaned text shorter than this is dropped
MIN_WORD_CHARS = 4               # LEN(word) > 3 in the word count
WORD_COUNT_TOP = 20              # TOP 20 words
DIRECTION_EPSILON = 0.05         # IMPROVED / DECLINED band
SCRAPE_CAP_PER_APP = 1000        # newest reviews kept per app by the scraper
FEED_CAP_PER_QUERY = 20          # feed items kept per query
FEED_TOP_SOURCES = 10

# --- FIXED VALUES: whitespace removed by the text strip: the characters for
# --- which Python's str.isspace() is true, as a plain set and as a regex class
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
STRIP_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# --- FIXED VALUES: feed date formats (RFC-822, with and without a zone); the
# --- day may have one or two digits, as with strptime's %d ------------------
RFC822_ZONED = "d MMM yyyy HH:mm:ss xx"
RFC822_LOCAL = "d MMM yyyy HH:mm:ss"
RFC822_GMT = "d MMM yyyy HH:mm:ss 'GMT'"
