"""The study's own configuration (REFERENCE: real app names, 2018-2026 eras,
48-pattern lexicon, kaggle sources) end to end on hand-built gold rows."""

from revlens.params import REFERENCE as R
from revlens.plans import reports as rp
from revlens.plans.quality import validate
from revlens.plans.complaints import classified_negatives

TEXTS = {
    "Paytm": ["money deducted but not credited", "rbi banned the payments bank", "rbi again, kyc pending?",
              "great app works fine", "ok"],
    "PhonePe": ["app crash on login every time", "worst app ever made here", "fraud call from fake agent",
                "fast and simple to use"],
    "GPay": ["customer care never answers", "too many ads everywhere", "love it, smooth payments"],
}


def _rows():
    rows, i = [], 0
    for app, texts in TEXTS.items():
        for year in (2018, 2019, 2021, 2023, 2025):
            for j, t in enumerate(texts):
                rating = 5 if ("great" in t or "love" in t or "fast" in t) else (3 if t == "ok" else 1 + j % 2)
                src = ("kaggle_help", "kaggle_new", "fresh_scrape_2026")[i % 3]
                replied = src != "fresh_scrape_2026" and i % 2 == 0
                rows.append({"review_id": f"r{i}", "app": app, "data_source": src,
                             "date": f"{year}-0{1 + j % 9}-15 10:00:00", "rating": rating, "review_text": t,
                             "thumbs_up": j, "reply_text": "We are sorry" if replied else None,
                             "reply_date": f"{year}-0{1 + j % 9}-17 09:00:00" if replied else None})
                i += 1
    return rows


def test_reference_suite_shapes(spark, gold_df):
    gold = gold_df(_rows())
    neg = classified_negatives(gold, R)
    suite = {k: v.collect() for k, v in rp.suite(gold, neg, R).items()}
    assert len(suite) == 9
    assert {r["app"] for r in suite["q1_ratings_overview_result1"]} == {"GPay", "Paytm", "PhonePe"}
    # trend: 5 years per app, first is BASELINE
    trend = suite["q2_ratings_trend_result1"]
    assert len(trend) == 15 and sum(r["direction"] == "BASELINE" for r in trend) == 3
    cats = {(r["app"], r["complaint_category"]) for r in suite["q3_complaint_categories_result1"]}
    assert ("Paytm", "Payment Failures") in cats and ("Paytm", "Regulatory Issues") in cats
    assert ("PhonePe", "Technical Failures") in cats and ("GPay", "Customer Support") in cats
    assert ("GPay", "UX Problems") in cats and ("PhonePe", "Trust & Security") in cats
    # "rbi again, kyc pending?" is a Payment Failure: 'pending' comes first in lexicon order
    p3 = {(r["app"], r["complaint_category"]): r["complaint_count"] for r in suite["q3_complaint_categories_result1"]}
    assert p3[("Paytm", "Payment Failures")] == 10 and p3[("Paytm", "Regulatory Issues")] == 5
    # deep dive: only the two deep-dive apps
    assert {r["app"] for r in suite["q4_paytm_deepdive_result1"]} == {"Paytm", "PhonePe"}
    # reply analysis: kaggle sources only; by year within 2018-2023
    assert {r["year"] for r in suite["q5_response_analysis_result2"]} == {2018, 2019, 2021, 2023}
    # eras: 3 apps x 3 eras
    eras = suite["q6_era_comparison_result1"]
    assert len(eras) == 9 and {r["era"] for r in eras} == {e for e, _, _ in R.eras}
    assert all(r["top_complaint"] != "Other" for r in suite["q6_era_comparison_result3"])


def test_reference_validation(spark, gold_df):
    checks = {r["check"]: r["passed"] for r in validate(gold_df(_rows()), R).collect()}
    assert checks["Only 3 apps"] and checks["Year range 2018-2026"] and checks["All ratings 1-5"]
    assert checks["No duplicate review_ids"] and not checks["At least 150,000 rows"]
