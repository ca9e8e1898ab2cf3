"""Independent SQL for the parity check (DuckDB dialect).

Each report is restated as one SQL query over the driver's tables, so the
DataFrame plan is checked against a second engine.  Shared pieces are the
view R text, the lexicon-driven CASE chain and the exact-rounding formula
(the definition of "rounded"); everything else (filters, grouping, windows,
pivots) is written independently.
"""

from __future__ import annotations

from revlens.functions.rounding import ratio_sql, units_sql
from revlens.params import FIXTURE, Params
from revlens.plans.reports import category_column, era_column


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def avg(s: str, n: str, k: int = 2) -> str:
    return ratio_sql(s, n, k, engine="duckdb")


def pct(part: str, whole: str) -> str:
    return ratio_sql(part, whole, 1, scale=100, engine="duckdb")


def units(s: str, n: str, k: int = 2) -> str:
    return units_sql(s, n, k, engine="duckdb")


R_SQL = """
SELECT cast(o_orderkey AS VARCHAR) AS review_id,
       CASE o_orderstatus WHEN 'F' THEN 'AppF' WHEN 'O' THEN 'AppO' ELSE 'AppP' END AS app,
       CASE WHEN o_orderkey % 4 < 2 THEN 'help' WHEN o_orderkey % 4 = 2 THEN 'new' ELSE 'fresh' END AS data_source,
       o_orderdate AS date,
       cast(year(o_orderdate) AS INTEGER) AS year,
       strftime(o_orderdate, '%Y-%m') AS year_month,
       try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating,
       text AS review_text,
       cast(o_custkey % 50 AS INTEGER) AS thumbs_up,
       CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN rf = 'R' THEN 'thanks'
            WHEN rf = 'N' THEN '  ' WHEN rf = 'A' THEN 'noted' END AS reply_text,
       CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE rd END AS reply_date,
       'cust' || cast(o_custkey AS VARCHAR) AS user_name,
       cast(NULL AS VARCHAR) AS app_version
FROM orders
LEFT JOIN documents ON doc_id = o_orderkey
LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS rd, max(l_returnflag) AS rf
           FROM lineitem GROUP BY l_orderkey) x ON l_orderkey = o_orderkey
"""


def case_category(p: Params, text: str = "lower(review_text)") -> str:
    whens = []
    for cat, pats in p.lexicon:
        cond = " OR ".join(f"contains({text}, {q(x)})" for x in pats)
        whens.append(f"WHEN {cond} THEN {q(cat)}")
    return f"CASE {' '.join(whens)} ELSE {q(p.fallback_category)} END"


def case_era(p: Params, col: str = "year") -> str:
    whens = " ".join(f"WHEN {col} BETWEEN {lo} AND {hi} THEN {q(lab)}" for lab, lo, hi in p.eras)
    return f"CASE {whens} END"


def neg_sql(p: Params) -> str:
    return f"""
SELECT review_id, app, data_source, year, year_month, {case_category(p)} AS complaint_category
FROM R WHERE rating <= {p.negative_max_rating} AND length(trim(review_text)) >= {p.min_complaint_chars}
"""


def with_r(body: str, p: Params = FIXTURE, neg: bool = False, ctes: str = "") -> str:
    """``WITH R AS (view R) [, NEG AS (...)] [, more CTEs] body``."""
    parts = [f"R AS ({R_SQL})"]
    if neg:
        parts.append(f"NEG AS ({neg_sql(p)})")
    if ctes:
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body


def import_check() -> str:
    return with_r(f"""
SELECT app, count(*) AS total_reviews, {avg('sum(rating)', 'count(rating)')} AS avg_rating,
       min(date) AS earliest_review, max(date) AS latest_review
FROM R GROUP BY app""")


def import_check_nocase() -> str:
    return with_r(f"""
SELECT min(app) AS app, count(*) AS total_reviews, {avg('sum(rating)', 'count(rating)')} AS avg_rating,
       min(date) AS earliest_review, max(date) AS latest_review
FROM (SELECT * REPLACE (CASE WHEN rating % 2 = 0 THEN upper(app) ELSE app END AS app) FROM R) m
GROUP BY lower(app)""")


def distinct_values() -> str:
    return with_r("\nUNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", cast({c} AS VARCHAR) AS value, count(*) AS rows FROM R GROUP BY {c}"
        for c in ("app", "year", "data_source")))


def gold_sorted() -> str:
    return with_r("""
SELECT row_number() OVER (ORDER BY app NULLS FIRST, date NULLS LAST, review_id NULLS FIRST) AS position,
       review_id, app, date, rating FROM R""")


def ratings_overview(p: Params = FIXTURE) -> str:
    return with_r(f"""
SELECT app, total_reviews, {avg('s', 'n')} AS avg_rating, negative_count, neutral_count, positive_count,
       {pct('negative_count', 'total_reviews')} AS negative_pct,
       {pct('positive_count', 'total_reviews')} AS positive_pct
FROM (SELECT app, count(review_id) AS total_reviews, sum(rating) AS s, count(rating) AS n,
             count(CASE WHEN rating <= {p.negative_max_rating} THEN 1 END) AS negative_count,
             count(CASE WHEN rating > {p.negative_max_rating} AND rating < {p.positive_min_rating} THEN 1 END) AS neutral_count,
             count(CASE WHEN rating >= {p.positive_min_rating} THEN 1 END) AS positive_count
      FROM R GROUP BY app) a""")


def _trend_sql(p: Params) -> str:
    lo, hi = p.trend_years
    return f"""
T0 AS (SELECT app, year, count(review_id) AS review_count, {units('sum(rating)', 'count(rating)')} AS u
       FROM R WHERE year BETWEEN {lo} AND {hi} GROUP BY app, year),
T1 AS (SELECT *, lag(u) OVER (PARTITION BY app ORDER BY year) AS pu FROM T0),
T AS (SELECT app, cast(year AS BIGINT) AS year, review_count,
             cast(u AS DOUBLE) / 100 AS avg_rating, cast(pu AS DOUBLE) / 100 AS prev_year_rating,
             cast(u - pu AS DOUBLE) / 100 AS rating_change
      FROM T1)"""


def rating_trend_yearly(p: Params = FIXTURE) -> str:
    e = p.direction_epsilon
    return with_r(f"""
SELECT *, CASE WHEN prev_year_rating IS NULL THEN 'BASELINE'
               WHEN avg_rating > prev_year_rating + {e} THEN 'IMPROVED'
               WHEN avg_rating < prev_year_rating - {e} THEN 'DECLINED'
               ELSE 'STABLE' END AS direction
FROM T""", ctes=_trend_sql(p))


def worst_year(p: Params = FIXTURE) -> str:
    return with_r(f"""
SELECT app, year AS worst_year, avg_rating AS worst_avg_rating FROM (
  SELECT *, row_number() OVER (PARTITION BY app ORDER BY avg_rating, year) AS rn
  FROM T WHERE avg_rating IS NOT NULL) z WHERE rn = 1""", ctes=_trend_sql(p))


def last_rating_per_app(p: Params = FIXTURE) -> str:
    return with_r(f"""
SELECT app, year AS last_year, avg_rating AS last_avg_rating FROM (
  SELECT *, row_number() OVER (PARTITION BY app ORDER BY year DESC) AS rn FROM T) z
WHERE rn = 1""", ctes=_trend_sql(p))


def source_bias_profile() -> str:
    return with_r(f"""
SELECT app, data_source, count(*) AS review_count, {avg('sum(rating)', 'count(rating)')} AS avg_rating
FROM R GROUP BY app, data_source""")


def layer_profile() -> str:
    return with_r(f"""
SELECT app, count(*) AS rows, cast(min(year) AS BIGINT) AS min_year, cast(max(year) AS BIGINT) AS max_year,
       count(DISTINCT data_source) AS sources, {avg('sum(rating)', 'count(rating)')} AS avg_rating
FROM R GROUP BY app""")


def complaint_categories(p: Params = FIXTURE) -> str:
    return with_r(f"""
SELECT app, complaint_category, complaint_count,
       {pct('complaint_count', 'tot')} AS pct_of_app_negatives,
       rank() OVER (PARTITION BY app ORDER BY complaint_count DESC) AS rank_within_app
FROM (SELECT app, complaint_category, count(review_id) AS complaint_count,
             sum(count(review_id)) OVER (PARTITION BY app) AS tot
      FROM NEG GROUP BY app, complaint_category) a""", p, neg=True)


def category_ratio(p: Params = FIXTURE) -> str:
    _, a, b = p.category_ratio
    return with_r(f"""
SELECT complaint_category, {q(a)} AS app_a, {q(b)} AS app_b, count_a, count_b,
       {pct('count_a', 'ta')} AS pct_a, {pct('count_b', 'tb')} AS pct_b,
       {ratio_sql('cast(count_a AS HUGEINT) * tb', 'cast(ta AS HUGEINT) * count_b', 1, engine='duckdb')} AS share_ratio
FROM (SELECT *, sum(count_a) OVER () AS ta, sum(count_b) OVER () AS tb FROM (
        SELECT complaint_category,
               count(CASE WHEN app = {q(a)} THEN 1 END) AS count_a,
               count(CASE WHEN app = {q(b)} THEN 1 END) AS count_b
        FROM NEG WHERE app IN ({q(a)}, {q(b)}) GROUP BY complaint_category) c) d""", p, neg=True)


def word_frequency(p: Params = FIXTURE) -> str:
    excl = " AND ".join(f"lower(review_text) NOT LIKE {q('%' + w + '%')}" for w in p.word_count_excluded)
    return with_r(f"""
SELECT word, count(*) AS frequency
FROM (SELECT unnest(string_split(lower(review_text), ' ')) AS word FROM R
      WHERE rating <= {p.negative_max_rating} AND length(trim(review_text)) >= {p.min_complaint_chars}
        AND {excl}) w
WHERE length(word) > {p.min_word_chars - 1}
GROUP BY word ORDER BY frequency DESC, word LIMIT {p.word_count_top}""")


def word_frequency_of(category: str, p: Params = FIXTURE) -> str:
    return with_r(f"""
SELECT word, count(*) AS frequency
FROM (SELECT unnest(string_split(lower(review_text), ' ')) AS word FROM R
      WHERE review_id IN (SELECT review_id FROM NEG WHERE complaint_category = {q(category)})) w
WHERE length(word) > {p.min_word_chars - 1}
GROUP BY word ORDER BY frequency DESC, word LIMIT {p.word_count_top}""", p, neg=True)


def _deep_sql(p: Params) -> str:
    apps = ", ".join(q(a) for a in p.deep_dive_apps)
    cols = ",\n       ".join(
        f"cast(sum(CASE WHEN complaint_category = {q(c)} THEN 1 ELSE 0 END) AS BIGINT) AS {category_column(c, p)}"
        for c in p.categories)
    return f"""
M AS (SELECT app, year_month, count(review_id) AS total_negative,
       {cols}
      FROM NEG WHERE app IN ({apps}) GROUP BY app, year_month),
D AS (SELECT *, cast(sum(total_negative) OVER (PARTITION BY app ORDER BY year_month
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_total_negative
      FROM M)"""


def _with_deep(body: str, p: Params) -> str:
    return with_r("\n" + body, p, neg=True, ctes=_deep_sql(p))


def monthly_deepdive(p: Params = FIXTURE) -> str:
    return _with_deep("SELECT * FROM D", p)


def monthly_prefix_excluded(p: Params = FIXTURE) -> str:
    return _with_deep(f"SELECT * FROM D WHERE NOT starts_with(year_month, {q(p.excluded_month_prefix)})", p)


def monthly_slice(app: str, p: Params = FIXTURE) -> str:
    return _with_deep(f"""
SELECT * FROM D WHERE NOT starts_with(year_month, {q(p.excluded_month_prefix)}) AND app = {q(app)}""", p)


def period_change(p: Params = FIXTURE) -> str:
    _, m1, m2 = p.period_change
    return _with_deep(f"""
SELECT app, {q(m1)} AS from_month, {q(m2)} AS to_month, from_count, to_count,
       {ratio_sql('to_count - from_count', 'from_count', 1, scale=100, engine='duckdb')} AS pct_change
FROM (SELECT app, max(CASE WHEN year_month = {q(m1)} THEN total_negative END) AS from_count,
             max(CASE WHEN year_month = {q(m2)} THEN total_negative END) AS to_count
      FROM D GROUP BY app) z""", p)


def _sources(p: Params) -> str:
    return ", ".join(q(s) for s in p.reply_sources)


def response_summary(p: Params = FIXTURE) -> str:
    return with_r(f"""
SELECT app, total_reviews, replied_count, response_rate_pct, avg_rating_all, avg_rating_replied,
       avg_rating_not_replied, reply_impact_on_rating, avg_days_to_reply, min_days_to_reply, max_days_to_reply,
       rank() OVER (ORDER BY response_rate_pct DESC) AS response_rank
FROM (
  SELECT app, count(review_id) AS total_reviews, cast(sum(was_replied) AS BIGINT) AS replied_count,
         {pct('sum(was_replied)', 'count(review_id)')} AS response_rate_pct,
         {avg('sum(rating)', 'count(rating)')} AS avg_rating_all,
         {avg('sum(CASE WHEN was_replied = 1 THEN rating END)', 'count(CASE WHEN was_replied = 1 THEN rating END)')} AS avg_rating_replied,
         {avg('sum(CASE WHEN was_replied = 0 THEN rating END)', 'count(CASE WHEN was_replied = 0 THEN rating END)')} AS avg_rating_not_replied,
         cast({units('sum(CASE WHEN was_replied = 1 THEN rating END)', 'count(CASE WHEN was_replied = 1 THEN rating END)')}
            - {units('sum(CASE WHEN was_replied = 0 THEN rating END)', 'count(CASE WHEN was_replied = 0 THEN rating END)')} AS DOUBLE) / 100
           AS reply_impact_on_rating,
         {avg('sum(days_to_reply)', 'count(days_to_reply)', 1)} AS avg_days_to_reply,
         min(days_to_reply) AS min_days_to_reply, max(days_to_reply) AS max_days_to_reply
  FROM (SELECT app, review_id, rating,
               CASE WHEN reply_text IS NOT NULL AND length(trim(reply_text)) > 0 THEN 1 ELSE 0 END AS was_replied,
               CASE WHEN reply_text IS NOT NULL AND reply_date IS NOT NULL AND date IS NOT NULL
                         AND reply_date > date
                    THEN cast(date_diff('day', cast(date AS DATE), cast(reply_date AS DATE)) AS BIGINT) END AS days_to_reply
        FROM R WHERE data_source IN ({_sources(p)})) f
  GROUP BY app) a""")


def response_by_year(p: Params = FIXTURE) -> str:
    lo, hi = p.response_years
    return with_r(f"""
SELECT app, cast(year AS BIGINT) AS year, total_reviews, replied_count,
       {pct('replied_count', 'total_reviews')} AS response_rate_pct,
       {ratio_sql('(cast(replied_count AS HUGEINT) * n0 - cast(r0 AS HUGEINT) * total_reviews)', '(cast(total_reviews AS HUGEINT) * n0)', 1, scale=100, engine='duckdb')} AS response_rate_change
FROM (SELECT *, lag(replied_count) OVER (PARTITION BY app ORDER BY year) AS r0,
                lag(total_reviews) OVER (PARTITION BY app ORDER BY year) AS n0
      FROM (SELECT app, year, count(review_id) AS total_reviews,
                   cast(sum(CASE WHEN reply_text IS NOT NULL AND length(trim(reply_text)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS replied_count
            FROM R WHERE data_source IN ({_sources(p)}) AND year BETWEEN {lo} AND {hi}
            GROUP BY app, year) a) b""")


def _era_from(p: Params, src: str) -> str:
    lo = min(x for _, x, _ in p.eras)
    hi = max(x for _, _, x in p.eras)
    return f"(SELECT *, {case_era(p)} AS era FROM {src} WHERE year BETWEEN {lo} AND {hi})"


def era_sentiment(p: Params = FIXTURE) -> str:
    return with_r(f"""
SELECT a.app, a.era, total_reviews, {avg('s', 'n')} AS avg_rating,
       negative_count, {pct('negative_count', 'total_reviews')} AS negative_pct,
       positive_count, {pct('positive_count', 'total_reviews')} AS positive_pct,
       {avg('st', 'nt', 1)} AS avg_thumbs_up, sample_data_source, m.data_source AS most_common_source
FROM (SELECT app, era, count(review_id) AS total_reviews, sum(rating) AS s, count(rating) AS n,
             count(CASE WHEN rating <= {p.negative_max_rating} THEN 1 END) AS negative_count,
             count(CASE WHEN rating >= {p.positive_min_rating} THEN 1 END) AS positive_count,
             sum(thumbs_up) AS st, count(thumbs_up) AS nt, max(data_source) AS sample_data_source
      FROM {_era_from(p, 'R')} e WHERE era IS NOT NULL GROUP BY app, era) a
LEFT JOIN (SELECT app, era, data_source FROM (
             SELECT app, era, data_source,
                    row_number() OVER (PARTITION BY app, era ORDER BY count(*) DESC, data_source) AS rn
             FROM {_era_from(p, 'R')} e2 WHERE era IS NOT NULL AND data_source IS NOT NULL
             GROUP BY app, era, data_source) z WHERE rn = 1) m
  ON m.app = a.app AND m.era = a.era""")


def _era_cmp_sql(p: Params) -> str:
    return f"""
E AS (SELECT app, era, complaint_category, complaint_count,
             {pct('complaint_count', 'tot')} AS pct_of_era_negatives,
             rank() OVER (PARTITION BY app, era ORDER BY complaint_count DESC) AS rank_in_era
      FROM (SELECT app, era, complaint_category, count(review_id) AS complaint_count,
                   sum(count(review_id)) OVER (PARTITION BY app, era) AS tot
            FROM {_era_from(p, 'NEG')} e WHERE era IS NOT NULL
            GROUP BY app, era, complaint_category) a)"""


def _top_sql(p: Params) -> str:
    return f"""
TOPC AS (SELECT app, era, complaint_category AS top_complaint, complaint_count, pct_of_negatives FROM (
  SELECT *, rank() OVER (PARTITION BY app, era ORDER BY complaint_count DESC) AS rnk FROM (
    SELECT app, era, complaint_category, complaint_count, {pct('complaint_count', 'tot')} AS pct_of_negatives
    FROM (SELECT app, era, complaint_category, count(review_id) AS complaint_count,
                 sum(count(review_id)) OVER (PARTITION BY app, era) AS tot
          FROM {_era_from(p, 'NEG')} e
          WHERE era IS NOT NULL AND complaint_category <> {q(p.fallback_category)}
          GROUP BY app, era, complaint_category) a) b) c WHERE rnk = 1)"""


def era_complaints(p: Params = FIXTURE) -> str:
    return with_r("\nSELECT * FROM E", p, neg=True, ctes=_era_cmp_sql(p))


def era_top_complaint(p: Params = FIXTURE) -> str:
    return with_r("\nSELECT * FROM TOPC", p, neg=True, ctes=_top_sql(p))


def era_heatmap(p: Params = FIXTURE) -> str:
    relabel = " ".join(f"WHEN complaint_category = {q(k)} THEN {q(v)}" for k, v in p.category_relabel.items())
    cat = f"CASE {relabel} ELSE complaint_category END" if relabel else "complaint_category"
    cols = []
    for e, _, _ in p.eras:
        cols.append(
            f"CASE WHEN max(has_{era_column(e, p)}) = 1 THEN coalesce(max(CASE WHEN era = {q(e)} "
            f"THEN pct_of_era_negatives END), 0.0) END AS {era_column(e, p)}")
    has = ", ".join(f"max(CASE WHEN era = {q(e)} THEN 1 END) OVER (PARTITION BY app) AS has_{era_column(e, p)}"
                    for e, _, _ in p.eras)
    return with_r(f"""
SELECT app, {cat} AS complaint_category, {', '.join(cols)}
FROM (SELECT *, {has} FROM E) h
GROUP BY app, {cat}""", p, neg=True, ctes=_era_cmp_sql(p))


def era_summary_grid(p: Params = FIXTURE) -> str:
    cols = []
    for e, _, _ in p.eras:
        c = era_column(e, p)
        cols.append(f"min(CASE WHEN era = {q(e)} THEN top_complaint END) AS {c}_top")
        cols.append(f"max(CASE WHEN era = {q(e)} THEN pct_of_negatives END) AS {c}_pct")
    return with_r(f"""
SELECT app, {', '.join(cols)} FROM TOPC GROUP BY app""", p, neg=True, ctes=_top_sql(p))


# --------------------------------------------------------------------------
# Cleaning pipeline (raw fixtures -> silver -> gold), dedup, validation
# --------------------------------------------------------------------------

def _strip(x: str) -> str:
    from revlens.constants import STRIP_CLASS
    pat = f"^{STRIP_CLASS}+|{STRIP_CLASS}+$"
    return f"regexp_replace(coalesce({x}, ''), {q(pat)}, '', 'g')"


def _parse_ts(x: str) -> str:
    return (f"coalesce(try_strptime(trim({x}), '%Y-%m-%d %H:%M:%S'), "
            f"try_strptime(trim({x}), '%Y-%m-%dT%H:%M:%S'), try_strptime(trim({x}), '%Y-%m-%d'))")


LINE_ORDER_SQL = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
                  "l_tax, l_returnflag, l_linestatus, l_shipdate")


def _raw_ctes(p: Params, from_files: bool = False) -> str:
    """``from_files``: as landed from the raw CSV files, where some lines are
    cut and some counts are no numbers."""
    from revlens.sources.testdata import HIST_MANIFEST
    app = "CASE o_orderstatus WHEN 'F' THEN 'AppF' WHEN 'O' THEN 'AppO' ELSE {o} END"
    src = "CASE WHEN l_linestatus = 'F' THEN 'help' ELSE 'new' END"
    frank = "CASE " + " ".join(
        f"WHEN ({app.format(o=q('AppP'))}) = {q(a)} AND ({src}) = {q(s)} THEN {i}"
        for i, (a, s) in enumerate(HIST_MANIFEST)) + " END"
    reply = "CASE WHEN l_returnflag = 'R' THEN 'thanks' WHEN l_linestatus = 'O' THEN '  ' END"
    ship = "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"
    lines = ("lineitem JOIN orders ON l_orderkey = o_orderkey "
             "LEFT JOIN documents ON doc_id = o_orderkey")
    apps = ", ".join(q(a) for a in p.apps)
    cut, thumbs, text = "false", "cast(l_quantity AS INTEGER)", "text"
    if from_files:
        cut, text = "(round(l_tax * 100) = 8)", "nullif(text, '')"
        thumbs = f"CASE WHEN round(l_discount * 100) <> 10 THEN {thumbs} END"
    return f"""
RH AS (SELECT cast(o_orderkey AS VARCHAR) AS review_id, 'cust' || cast(o_custkey AS VARCHAR) AS user_name,
              'img/' || cast(o_custkey AS VARCHAR) AS user_image,
              {text} AS review_text, l_linenumber AS rating, {thumbs} AS thumbs_up,
              '1.' || cast(l_linenumber AS VARCHAR) AS app_version, {cut} AS cut,
              CASE WHEN {cut} THEN NULL WHEN l_quantity >= 49 THEN 'bad' ELSE {ship} END AS date_text,
              CASE WHEN NOT {cut} THEN {reply} END AS reply_text,
              CASE WHEN NOT {cut} AND ({reply}) IS NOT NULL THEN {ship} END AS reply_date_text,
              {app.format(o=q('AppP'))} AS app, {src} AS data_source, {frank} AS _file, {LINE_ORDER_SQL}
       FROM {lines} WHERE l_returnflag <> 'N'),
H0 AS (SELECT review_id, user_name, {_strip('review_text')} AS review_text, rating, thumbs_up, app_version,
              {_parse_ts('date_text')} AS date, reply_text, {_parse_ts('reply_date_text')} AS reply_date,
              app, data_source, _file, {LINE_ORDER_SQL}
       FROM RH),
H2 AS (SELECT * FROM H0 WHERE length(review_text) >= {p.min_review_chars}),
H3 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id
         ORDER BY _file, {LINE_ORDER_SQL}) AS rn FROM H2) z WHERE rn = 1),
H4 AS (SELECT * FROM H3 WHERE date IS NOT NULL AND rating BETWEEN 1 AND 5),
RS AS (SELECT {app.format(o=q('AppX'))} AS app, cast(o_orderkey AS VARCHAR) AS review_id,
              strftime(l_shipdate, '%Y-%m-%d') AS date_text, l_linenumber AS rating, {text} AS review_text,
              cast(l_quantity AS INTEGER) AS thumbs_up, '1.' || cast(l_linenumber AS VARCHAR) AS app_version,
              'fresh' AS data_source, 0 AS _file, {LINE_ORDER_SQL}
       FROM {lines} WHERE l_returnflag = 'N'),
S0 AS (SELECT app, review_id, {_parse_ts('date_text')} AS date, rating, {_strip('review_text')} AS review_text,
              thumbs_up, app_version, data_source, cast(NULL AS VARCHAR) AS reply_text,
              cast(NULL AS TIMESTAMP) AS reply_date, cast(NULL AS VARCHAR) AS user_name, _file, {LINE_ORDER_SQL}
       FROM RS),
S2 AS (SELECT * FROM S0 WHERE length(review_text) >= {p.min_review_chars}),
S3 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id
         ORDER BY _file, {LINE_ORDER_SQL}) AS rn FROM S2) z WHERE rn = 1),
S4 AS (SELECT * FROM S3 WHERE app IN ({apps})),
U AS (SELECT review_id, app, data_source, date, rating, review_text, thumbs_up, reply_text, reply_date,
             user_name, app_version, 0 AS _src, _file, {LINE_ORDER_SQL} FROM H4
      UNION ALL
      SELECT review_id, app, data_source, date, rating, review_text, thumbs_up, reply_text, reply_date,
             user_name, app_version, 1 AS _src, _file, {LINE_ORDER_SQL} FROM S4),
G AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id
        ORDER BY _src, _file, {LINE_ORDER_SQL}) AS rn FROM U) z WHERE rn = 1)"""


GOLD_SELECT = ("review_id, app, data_source, date, cast(year(date) AS INTEGER) AS year, "
               "strftime(date, '%Y-%m') AS year_month, rating, review_text, thumbs_up, reply_text, "
               "reply_date, user_name, app_version")


def silver_clean(p: Params = FIXTURE) -> str:
    return f"WITH {_raw_ctes(p).strip()}\nSELECT {GOLD_SELECT} FROM H4"


def gold_build(p: Params = FIXTURE) -> str:
    return f"WITH {_raw_ctes(p).strip()}\nSELECT {GOLD_SELECT} FROM G"


def gold_from_files(p: Params = FIXTURE) -> str:
    return f"WITH {_raw_ctes(p, from_files=True).strip()}\nSELECT {GOLD_SELECT} FROM G"


def bronze_reviews(p: Params = FIXTURE) -> str:
    return f"""WITH {_raw_ctes(p, from_files=True).strip()}
SELECT review_id AS "reviewId", user_name AS "userName", user_image AS "userImage", review_text AS content, rating AS score,
       thumbs_up AS "thumbsUpCount", app_version AS "reviewCreatedVersion", date_text AS "at", reply_text AS "replyContent",
       reply_date_text AS "repliedAt", app, data_source FROM RH"""


def bronze_scrape(p: Params = FIXTURE) -> str:
    return f"""WITH {_raw_ctes(p, from_files=True).strip()}
SELECT app, review_id, date_text AS date, rating, review_text, thumbs_up, app_version, data_source FROM RS"""


def bronze_rejects(p: Params = FIXTURE) -> str:
    return f"""WITH {_raw_ctes(p, from_files=True).strip()},
BAD AS (SELECT app, data_source, 'broken record' AS reason, cast(NULL AS VARCHAR) AS "column" FROM RH WHERE cut
        UNION ALL SELECT app, data_source, 'not a number', 'thumbsUpCount' FROM RH WHERE NOT cut AND thumbs_up IS NULL
        UNION ALL SELECT app, data_source, 'not a date', 'at' FROM RH WHERE date_text = 'bad')
SELECT app, data_source, reason, "column", count(*) AS rejects FROM BAD GROUP BY ALL"""


def clean_step_audit(p: Params = FIXTURE) -> str:
    return f"""WITH {_raw_ctes(p).strip()},
C AS (SELECT 'historical' AS layer, 0 AS seq, 'bronze' AS step, count(*) AS rows_out FROM H0
      UNION ALL SELECT 'historical', 1, 'length_filter', count(*) FROM H2
      UNION ALL SELECT 'historical', 2, 'dedup', count(*) FROM H3
      UNION ALL SELECT 'historical', 3, 'date_filter', count(*) FROM H3 WHERE date IS NOT NULL
      UNION ALL SELECT 'historical', 4, 'rating_filter', count(*) FROM H4
      UNION ALL SELECT 'scrape', 0, 'bronze', count(*) FROM S0
      UNION ALL SELECT 'scrape', 1, 'length_filter', count(*) FROM S2
      UNION ALL SELECT 'scrape', 2, 'dedup', count(*) FROM S3
      UNION ALL SELECT 'scrape', 3, 'app_filter', count(*) FROM S4
      UNION ALL SELECT 'gold', 0, 'union', count(*) FROM U
      UNION ALL SELECT 'gold', 1, 'cross_source_dedup', count(*) FROM G)
SELECT layer, cast(seq AS BIGINT) AS seq, step,
       coalesce(lag(rows_out) OVER (PARTITION BY layer ORDER BY seq), rows_out) AS rows_in, rows_out,
       coalesce(lag(rows_out) OVER (PARTITION BY layer ORDER BY seq), rows_out) - rows_out AS dropped
FROM C"""


def dedup_first_lineitem() -> str:
    cols = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
            "l_tax, l_returnflag, l_linestatus, l_shipdate")
    return f"""
SELECT {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
     ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
              l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
              l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS rn
  FROM lineitem) z WHERE rn = 1"""


def dedup_cross_source(p: Params = FIXTURE) -> str:
    return f"""WITH {_raw_ctes(p).strip()},
RU AS (SELECT review_id, app, data_source, rating, 0 AS source_priority, _file, {LINE_ORDER_SQL} FROM RH
       UNION ALL
       SELECT review_id, app, data_source, rating, 1, _file, {LINE_ORDER_SQL} FROM RS)
SELECT review_id, app, data_source, rating, cast(source_priority AS BIGINT) AS source_priority FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY source_priority, _file, {LINE_ORDER_SQL}) AS rn
  FROM RU) z WHERE rn = 1"""


def dedup_nocase() -> str:
    return """
SELECT order_id, line, part FROM (
  SELECT (CASE WHEN l_linenumber % 2 = 0 THEN 'Order-' ELSE 'ORDER-' END) || cast(l_orderkey AS VARCHAR) AS order_id,
         l_linenumber AS line, l_partkey AS part,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS rn
  FROM lineitem) z WHERE rn = 1"""


def gold_validation(p: Params = FIXTURE) -> str:
    lo, hi = p.valid_years
    apps = list(p.apps)
    s = lambda c: f"coalesce(cast({c} AS VARCHAR), 'NULL')"
    app_counts = ", ".join(f"count(CASE WHEN app = {q(a)} THEN 1 END) AS app{i}" for i, a in enumerate(apps))
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN app{i} = 0 THEN {q(a)} END"
                                           for i, a in enumerate(apps)) + ")"
    in_apps = ", ".join(q(a) for a in apps)
    rows = [
        ("No duplicate review_ids", "unique_ids = total",
         f"{s('unique_ids')} || ' unique / ' || {s('total')} || ' total'"),
        ("All ratings 1-5", "bad_ratings = 0", f"'Min=' || {s('min_rating')} || ' Max=' || {s('max_rating')}"),
        ("No null dates", "null_dates = 0", f"'Null dates: ' || {s('null_dates')}"),
        ("No null review_text", "null_texts = 0", f"'Null texts: ' || {s('null_texts')}"),
        (f"Only {len(apps)} apps", f"foreign_apps = 0 AND {missing} = ''",
         f"'Foreign rows: ' || {s('foreign_apps')} || ' Missing: ' || {missing}"),
        (f"Year range {lo}-{hi}", "bad_years = 0", f"'Years: ' || {s('min_year')} || '-' || {s('max_year')}"),
        (f"At least {p.min_gold_rows:,} rows", f"total >= {p.min_gold_rows}", f"'Total: ' || {s('total')}"),
    ]
    sel = "\nUNION ALL ".join(
        f"SELECT cast({i + 1} AS BIGINT) AS seq, {q(n)} AS \"check\", ({c}) AS passed, ({o}) AS observed FROM A"
        for i, (n, c, o) in enumerate(rows))
    return with_r(sel, ctes=f"""A AS (SELECT count(*) AS total, count(DISTINCT review_id) AS unique_ids,
       count(CASE WHEN NOT coalesce(rating BETWEEN 1 AND 5, false) THEN 1 END) AS bad_ratings,
       min(rating) AS min_rating, max(rating) AS max_rating,
       count(CASE WHEN date IS NULL THEN 1 END) AS null_dates,
       count(CASE WHEN review_text IS NULL THEN 1 END) AS null_texts,
       count(CASE WHEN NOT coalesce(app IN ({in_apps}), false) THEN 1 END) AS foreign_apps, {app_counts},
       count(CASE WHEN NOT coalesce(year BETWEEN {lo} AND {hi}, false) THEN 1 END) AS bad_years,
       min(year) AS min_year, max(year) AS max_year FROM R)""")


# --------------------------------------------------------------------------
# Landing jobs, feed, file round trips
# --------------------------------------------------------------------------

def newest_n_per_app(cutoff: str, cap: int) -> str:
    return with_r(f"""
SELECT app, review_id, coalesce(strftime(date, '%Y-%m-%d'), '') AS date, rating, review_text, thumbs_up,
       coalesce(app_version, '') AS app_version FROM D""", ctes=f"""
C AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY date DESC, review_id) AS rk
      FROM R WHERE date >= TIMESTAMP '{cutoff}'),
K AS (SELECT app, review_id, date, rating, {_strip('review_text')} AS review_text, thumbs_up, app_version, rk
      FROM C WHERE rk <= {cap}),
L AS (SELECT * FROM K WHERE review_text <> ''),
D AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY app, rk) AS rn
      FROM L) z WHERE rn = 1)""")


def landing_summary(cutoff: str, cap: int) -> str:
    inner = newest_n_per_app(cutoff, cap)
    return f"""SELECT app, count(rating) AS count, {avg('sum(rating)', 'count(rating)')} AS average_rating
FROM ({inner}) n GROUP BY app"""


def _feed_ev(queries) -> str:
    idx = " ".join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(queries))
    body = "'%a, %d %b %Y %H:%M:%S'"
    return f"""
EV AS (SELECT event_type AS query, CASE event_type {idx} END AS query_idx, event_id AS position,
              props AS title, 'https://news.example/u' || cast(user_id AS VARCHAR) AS link,
              's' || cast(user_id % 12 AS VARCHAR) AS source,
              CASE WHEN value < 1 THEN NULL WHEN value < 2 THEN 'not a date'
                   WHEN user_id % 2 = 0 THEN strftime(ts, {body}) || ' GMT'
                   ELSE strftime(ts + INTERVAL 330 MINUTE, {body}) || ' +0530' END AS pubDate
       FROM events WHERE event_type IN ({', '.join(q(x) for x in queries)}))"""


def rfc822_sql(x: str) -> str:
    s = f"regexp_replace(trim(coalesce({x}, '')), '^[A-Za-z]{{3}},\\s*', '')"
    zoned = (f"CASE WHEN regexp_matches({s}, ' [+-][0-9]{{4}}$') THEN "
             f"try_strptime(left({s}, length({s}) - 6), '%d %b %Y %H:%M:%S') - to_minutes("
             f"(CASE WHEN substr({s}, length({s}) - 4, 1) = '-' THEN -1 ELSE 1 END) * "
             f"(cast(substr({s}, length({s}) - 3, 2) AS INTEGER) * 60 + cast(substr({s}, length({s}) - 1, 2) AS INTEGER))) END")
    return f"coalesce({zoned}, try_strptime({s}, '%d %b %Y %H:%M:%S GMT'))"


def rfc822_local_sql(x: str) -> str:
    """Wall-clock time written in the date (zone ignored), NULL unless it
    parses as an instant."""
    s = f"regexp_replace(trim(coalesce({x}, '')), '^[A-Za-z]{{3}},\\s*', '')"
    local = (f"CASE WHEN regexp_matches({s}, ' [+-][0-9]{{4}}$') THEN "
             f"try_strptime(left({s}, length({s}) - 6), '%d %b %Y %H:%M:%S') "
             f"ELSE try_strptime({s}, '%d %b %Y %H:%M:%S GMT') END")
    return f"CASE WHEN ({rfc822_sql(x)}) IS NOT NULL THEN {local} END"


def rfc822_parse(queries) -> str:
    return f"""WITH {_feed_ev(queries).strip()}
SELECT position AS event_id, pubDate AS pub_date, {rfc822_sql('pubDate')} AS parsed_at FROM EV"""


def feed_clean(queries, cutoff: str, cap: int) -> str:
    return f"""WITH {_feed_ev(queries).strip()},
CAP AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY position) AS rn FROM EV) z
        WHERE rn <= {cap}),
DT AS (SELECT query, query_idx, coalesce(title, '') AS title, coalesce(link, '') AS url,
              coalesce(source, '') AS source, {rfc822_sql('pubDate')} AS pub_ts,
              {rfc822_local_sql('pubDate')} AS pub_local FROM CAP),
KEPT AS (SELECT * FROM DT WHERE pub_ts IS NULL OR pub_ts >= TIMESTAMP '{cutoff}'),
FQ AS (SELECT url AS u, min(query_idx) AS m FROM KEPT GROUP BY url)
SELECT query, coalesce(strftime(pub_local, '%Y-%m-%d'), '') AS date, title, source, url
FROM KEPT JOIN FQ ON url = u AND query_idx = m"""


def feed_top_sources(queries, cutoff: str, cap: int, n: int) -> str:
    return f"""SELECT source, count(*) AS count FROM ({feed_clean(queries, cutoff, cap)}) f
GROUP BY source ORDER BY count DESC, source LIMIT {n}"""


def dedup_feed(queries) -> str:
    return f"""WITH {_feed_ev(queries).strip()},
FQ AS (SELECT link AS u, min(query_idx) AS m FROM EV GROUP BY link)
SELECT query, position, link AS url, source FROM EV JOIN FQ ON link = u AND query_idx = m"""


def csv_roundtrip() -> str:
    strs = {"review_id", "app", "data_source", "year_month", "review_text", "reply_text", "user_name",
            "app_version"}
    from revlens.schema import GOLD_COLUMNS
    cols = ", ".join(f"nullif({c}, '') AS {c}" if c in strs else c for c in GOLD_COLUMNS)
    return with_r(f"\nSELECT {cols} FROM R")


def numbered(sql: str, order: str) -> str:
    """The rows with their place under ``order``."""
    return f"SELECT row_number() OVER (ORDER BY {order}) AS position, * FROM ({sql}) t"


def numbered_csv(sql: str, order: str, *texts: str) -> str:
    """The same read back from CSV, where empty text is NULL."""
    empty = ", ".join(f"nullif({c}, '') AS {c}" for c in texts)
    return f"SELECT * REPLACE ({empty}) FROM ({numbered(sql, order)}) c"


#: The order of each report that defines one (NULLs first where ascending).
ORDER = {
    "import_check": "app", "import_check_nocase": "app", "ratings_overview": "avg_rating NULLS FIRST, app",
    "rating_trend_yearly": "app, year", "worst_year": "app", "last_rating_per_app": "app",
    "source_bias_profile": "app, data_source", "layer_profile": "app",
    "distinct_values": "\"column\", value NULLS FIRST",
    "complaint_categories": "app, rank_within_app, complaint_category",
    "complaint_categories_default_lexicon": "app, rank_within_app, complaint_category",
    "category_ratio": "complaint_category", "word_frequency": "frequency DESC, word",
    "word_frequency_other": "frequency DESC, word",
    "monthly_deepdive": "app, year_month NULLS FIRST", "monthly_prefix_excluded": "app, year_month",
    "monthly_slice_app": "app, year_month", "period_change": "app",
    "response_summary": "response_rate_pct DESC, app", "response_by_year": "app, year", "era_sentiment": "app, era",
    "era_complaints": "app, era, rank_in_era, complaint_category", "era_heatmap": "app, complaint_category",
    "era_top_complaint": "app, era, top_complaint", "era_summary_grid": "app", "clean_step_audit": "layer, seq",
    "newest_n_per_app": "app, date DESC, review_id", "landing_summary": "app",
    "feed_clean": "date DESC, query, url", "feed_top_sources": "count DESC, source",
}


def fallback_first_name(p: Params) -> str:
    """SQL for a category's own name, given its display name."""
    back = " ".join(f"WHEN complaint_category = {q(v)} THEN {q(k)}" for k, v in p.category_relabel.items())
    return f"CASE {back} ELSE complaint_category END"


def bi_table(name: str, p: Params = FIXTURE) -> str:
    """One BI export: its result, with the fallback's display name and the
    era's display label where the charts show them."""
    relabel = " ".join(f"WHEN complaint_category = {q(k)} THEN {q(v)}" for k, v in p.category_relabel.items())
    renamed = f"* REPLACE (CASE {relabel} ELSE complaint_category END AS complaint_category)"
    labels = "CASE " + " ".join(f"WHEN era = {q(k)} THEN {q(v)}" for k, v in p.era_labels.items()) + " END AS era_label"
    plain = {"tableau_ratings.csv": ratings_overview, "tableau_trend.csv": rating_trend_yearly,
             "tableau_complaints.csv": complaint_categories, "tableau_monthly.csv": monthly_deepdive,
             "tableau_response_a.csv": response_summary, "tableau_response_b.csv": response_by_year,
             "tableau_era.csv": era_complaints, "tableau_summary.csv": era_top_complaint}
    what = {"tableau_complaints.csv": renamed, "tableau_era.csv": f"{renamed}, {labels}", "tableau_summary.csv": f"*, {labels}"}
    return f"SELECT {what.get(name, '*')} FROM ({plain[name](p)}) b"


def suite_manifest(named: list[tuple[str, str]], missing: tuple[str, ...] = ()) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(n)} AS report, cast(0 AS BIGINT) AS rows, false AS present" if n in missing else
        f"SELECT {q(n)} AS report, count(*) AS rows, true AS present FROM ({sql}) s{i}"
        for i, (n, sql) in enumerate(named))


def silver_scrape(p: Params = FIXTURE) -> str:
    return f"WITH {_raw_ctes(p).strip()}\nSELECT {GOLD_SELECT} FROM S4"
