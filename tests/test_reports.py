from revlens.functions.reply import days_to_reply, was_replied
from revlens.params import FIXTURE
from revlens.plans import reports as rp
from revlens.plans.complaints import classified_negatives


def test_reply_rules(spark, gold_df):
    g = gold_df([
        {"review_id": "blank", "date": "1999-01-01 10:00:00", "reply_text": "  ", "reply_date": "1999-01-03 09:00:00"},
        {"review_id": "before", "date": "1999-01-05 10:00:00", "reply_text": "hi", "reply_date": "1999-01-04 10:00:00"},
        {"review_id": "same_instant", "date": "1999-01-05 10:00:00", "reply_text": "hi", "reply_date": "1999-01-05 10:00:00"},
        {"review_id": "same_day", "date": "1999-01-05 10:00:00", "reply_text": "hi", "reply_date": "1999-01-05 18:00:00"},
        {"review_id": "midnight", "date": "1999-01-05 23:59:00", "reply_text": "hi", "reply_date": "1999-01-06 00:01:00"},
        {"review_id": "no_text", "date": "1999-01-05 10:00:00", "reply_text": None, "reply_date": "1999-01-09 10:00:00"},
    ])
    got = {r[0]: (r[1], r[2]) for r in g.select("review_id", was_replied(), days_to_reply()).collect()}
    assert got == {"blank": (0, 2), "before": (1, None), "same_instant": (1, None), "same_day": (1, 0),
                   "midnight": (1, 1), "no_text": (0, None)}


def test_trend_lag_bridges_gaps_and_direction_band(spark, gold_df):
    rows = []
    # AppF: 2.00 (1995), 2.05 (1997, +0.05 exactly -> STABLE), 2.20 (1998, IMPROVED), 1.00 (1999)
    for y, ratings in [(1995, [2, 2]), (1997, [2] * 19 + [3]), (1998, [2] * 4 + [3]), (1999, [1])]:
        for i, r in enumerate(ratings):
            rows.append({"review_id": f"{y}-{i}", "app": "AppF", "date": f"{y}-03-01 00:00:00", "rating": r})
    t = rp.rating_trend_yearly(gold_df(rows), FIXTURE).collect()
    got = [(r["year"], r["avg_rating"], r["prev_year_rating"], r["rating_change"], r["direction"]) for r in t]
    assert got == [(1995, 2.0, None, None, "BASELINE"), (1997, 2.05, 2.0, 0.05, "STABLE"),
                   (1998, 2.2, 2.05, 0.15, "IMPROVED"), (1999, 1.0, 2.2, -1.2, "DECLINED")]


def _neg_rows(texts_by_app_year):
    rows, i = [], 0
    for (app, year), texts in texts_by_app_year.items():
        for t in texts:
            rows.append({"review_id": str(i), "app": app, "date": f"{year}-02-01 00:00:00", "rating": 1,
                         "review_text": t, "data_source": "help"})
            i += 1
    return rows


def test_complaint_shares_ranks_and_ties(spark, gold_df):
    g = gold_df(_neg_rows({
        ("AppF", 1995): ["has a license here", "apache thing here", "mit license text",
                         "with ### marks!!", "plain words only", "short"],
        ("AppF", 2005): ["license outside eras"],
    }))
    neg = classified_negatives(g, FIXTURE)
    p3 = {r["complaint_category"]: (r["complaint_count"], r["pct_of_app_negatives"], r["rank_within_app"])
          for r in rp.complaint_categories(neg).collect()}
    # "short" (5 chars) is below the 10-char complaint minimum
    assert p3 == {"Payment Failures": (4, 66.7, 1), "Customer Support": (1, 16.7, 2), "Other": (1, 16.7, 2)}
    top = rp.era_top_complaint(neg, FIXTURE).collect()
    assert [(r["top_complaint"], r["complaint_count"], r["pct_of_negatives"]) for r in top] == \
        [("Payment Failures", 3, 75.0)]
    era_rows = rp.era_complaints(neg, FIXTURE).collect()
    assert sum(r["complaint_count"] for r in era_rows) == 5   # 2005 is outside every era


def test_rank_one_keeps_ties(spark, gold_df):
    g = gold_df(_neg_rows({("AppO", 1999): ["license one here", "token two here", "plain text here"]}))
    top = rp.era_top_complaint(classified_negatives(g, FIXTURE), FIXTURE).collect()
    assert sorted(r["top_complaint"] for r in top) == ["Payment Failures", "Technical Failures"]
    grid = rp.era_summary_grid(rp.era_top_complaint(classified_negatives(g, FIXTURE), FIXTURE), FIXTURE).first()
    assert grid["recovery_1999_2001_top"] == "Payment Failures"


def test_monthly_running_total_and_properties(spark):
    from revlens.catalog import QUERIES
    from tests.conftest import SF_MID
    deep = QUERIES["monthly_deepdive"](spark, SF_MID)
    cats = [rp.category_column(c, FIXTURE) for c in FIXTURE.categories]
    rows = deep.collect()
    assert all(sum(r[c] for c in cats) == r["total_negative"] for r in rows)
    for app in FIXTURE.deep_dive_apps:
        mine = sorted((r for r in rows if r["app"] == app), key=lambda r: r["year_month"])
        assert mine[-1]["running_total_negative"] == sum(r["total_negative"] for r in mine)
    p3 = QUERIES["complaint_categories"](spark, SF_MID).collect()
    for app in {r["app"] for r in p3}:
        assert abs(sum(r["pct_of_app_negatives"] for r in p3 if r["app"] == app) - 100) < 0.5


def test_dedup_is_idempotent(spark):
    from revlens.catalog import LINEITEM_ORDER
    from revlens.operators.dedup import dedup_first
    from revlens.sources.testdata import table
    from tests.conftest import SF_SMALL
    li = table(spark, SF_SMALL, "lineitem")
    once = dedup_first(li, ["l_orderkey", "l_linenumber"], LINEITEM_ORDER)
    twice = dedup_first(once, ["l_orderkey", "l_linenumber"], LINEITEM_ORDER)
    assert once.count() == twice.count() and once.exceptAll(twice).count() == 0


def test_era_counts_sum_to_overall_counts_when_all_years_are_in_eras(spark):
    from revlens.catalog import QUERIES
    from tests.conftest import SF_MID
    p3 = {(r["app"], r["complaint_category"]): r["complaint_count"]
          for r in QUERIES["complaint_categories"](spark, SF_MID).collect()}
    p9 = {}
    for r in QUERIES["era_complaints"](spark, SF_MID).collect():
        k = (r["app"], r["complaint_category"])
        p9[k] = p9.get(k, 0) + r["complaint_count"]
    assert p9 == p3


def test_word_count_and_reply_rules_match_restated_sql_semantics(spark, gold_df):
    import datetime as dt
    import random
    from collections import Counter

    from revlens.params import REFERENCE
    rng = random.Random(17)
    vocab = ["Refund", "money", "stuck", "app", "is", "slow!", "great", "  ", "\tcrash", "worst", "Worst",
             "payment", "failed", "again", "é-wallet", "kyc", "zzzz", "aaaa"]
    rows = []
    base = dt.datetime(2021, 5, 1, 8, 0)
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 9))]
        text = rng.choice([" ", "  ", ""]).join(words) if words else rng.choice([None, "", "   "])
        rd = base + dt.timedelta(hours=rng.randint(-30, 80))
        rows.append({"review_id": str(i), "app": "Paytm", "rating": rng.randint(1, 5), "review_text": text,
                     "date": base.strftime("%Y-%m-%d %H:%M:%S"), "data_source": "kaggle_help",
                     "reply_text": rng.choice([None, "", "  ", "thanks"]),
                     "reply_date": rng.choice([None, rd.strftime("%Y-%m-%d %H:%M:%S")])})
    g = gold_df(rows)

    # word count: rating <= 2, LEN(TRIM(text)) >= 10, 7 NOT LIKEs, split on ' ', LEN(word) > 3
    c = Counter()
    for r in rows:
        t = r["review_text"]
        if r["rating"] > 2 or t is None or len(t.strip(" ")) < 10:
            continue
        low = t.lower()
        if any(w in low for w in REFERENCE.word_count_excluded):
            continue
        c.update(w for w in low.split(" ") if len(w) > 3)
    want = sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:20]
    got = [(r["word"], r["frequency"]) for r in rp.word_frequency(g, REFERENCE).collect()]
    assert got == want

    # reply rules: was_replied = non-NULL and LEN(TRIM) > 0; days = calendar days when reply text is
    # non-NULL, both dates present and reply strictly later
    exp = {}
    for r in rows:
        rt, rd = r["reply_text"], r["reply_date"]
        replied = 1 if rt is not None and len(rt.strip(" ")) > 0 else 0
        days = None
        if rt is not None and rd is not None:
            rdt = dt.datetime.strptime(rd, "%Y-%m-%d %H:%M:%S")
            if rdt > base:
                days = (rdt.date() - base.date()).days
        exp[r["review_id"]] = (replied, days)
    got = {r[0]: (r[1], r[2]) for r in g.select("review_id", was_replied(), days_to_reply()).collect()}
    assert got == exp
