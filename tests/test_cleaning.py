from revlens.params import FIXTURE
from revlens.plans import cleaning as cl
from revlens.schema import RAW_HISTORICAL, RAW_SCRAPE


def _hist(spark, rows):
    """rows: (reviewId, content, score, at, app, source, file, pos)"""
    data = [(r[0], "u", "img", r[1], r[2], 0, "1.0", r[3], None, None, r[4], r[5], r[6], r[7]) for r in rows]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_HISTORICAL.fields)
    return spark.createDataFrame(data, schema + ", app string, data_source string, _file int, _pos long")


def _scrape(spark, rows):
    """rows: (app, review_id, date, rating, text, pos)"""
    data = [(a, i, d, r, t, 0, "1", "fresh", 0, p) for a, i, d, r, t, p in rows]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCRAPE.fields)
    return spark.createDataFrame(data, schema + ", data_source string, _file int, _pos long")


def test_dedup_runs_before_date_filter(spark):
    h = _hist(spark, [
        ("a", "first copy text", 3, "bad", "AppF", "help", 0, 1),
        ("a", "second copy text", 3, "1999-01-02 10:00:00", "AppF", "help", 0, 2),
        ("b", "kept review", 4, "1999-01-02 10:00:00", "AppF", "help", 0, 3),
    ])
    out = cl.silver_historical(h, FIXTURE).select("review_id").collect()
    assert [r[0] for r in out] == ["b"]


def test_length_rating_and_strip_rules(spark):
    h = _hist(spark, [
        ("n", None, 3, "1999-01-01 00:00:00", "AppF", "help", 0, 1),
        ("e", "", 3, "1999-01-01 00:00:00", "AppF", "help", 0, 2),
        ("f", "abcd", 3, "1999-01-01 00:00:00", "AppF", "help", 0, 3),
        ("t", "\t\t\t\t\t\t", 3, "1999-01-01 00:00:00", "AppF", "help", 0, 4),
        ("k", " abcde　", 3, "1999-01-01 00:00:00", "AppF", "help", 0, 5),
        ("r0", "rating zero", 0, "1999-01-01 00:00:00", "AppF", "help", 0, 6),
        ("r6", "rating six!", 6, "1999-01-01 00:00:00", "AppF", "help", 0, 7),
        ("rn", "rating null", None, "1999-01-01 00:00:00", "AppF", "help", 0, 8),
    ])
    out = cl.silver_historical(h, FIXTURE).select("review_id", "review_text", "year", "year_month").collect()
    assert [tuple(r) for r in out] == [("k", "abcde", 1999, "1999-01")]


def test_cross_source_priority_and_scrape_rules(spark):
    h = _hist(spark, [("x", "historical text", 2, "1999-05-01 08:00:00", "AppF", "help", 0, 1)])
    s = _scrape(spark, [
        ("AppF", "x", "1999-06-01", 5, "scrape copy text", 1),
        ("AppX", "y", "1999-06-01", 5, "other app review", 2),
        ("AppO", "z", "junk", 9, "no date, bad rating", 3),   # kept: scrape has no such filters
    ])
    g = cl.gold_build(h, s, FIXTURE)
    rows = {r["review_id"]: r for r in g.collect()}
    assert set(rows) == {"x", "z"}
    assert rows["x"]["data_source"] == "help" and rows["x"]["rating"] == 2
    assert rows["z"]["date"] is None and rows["z"]["year_month"] is None and rows["z"]["rating"] == 9


def test_audit_counts_chain(spark):
    h = _hist(spark, [
        ("a", "first copy text", 3, "bad", "AppF", "help", 0, 1),
        ("a", "second copy text", 3, "1999-01-02 10:00:00", "AppF", "help", 0, 2),
        ("b", "kept review", 4, "1999-01-02 10:00:00", "AppF", "help", 0, 3),
        ("c", "abc", 4, "1999-01-02 10:00:00", "AppF", "help", 0, 4),
        ("d", "rating seven", 7, "1999-01-02 10:00:00", "AppF", "help", 0, 5),
    ])
    s = _scrape(spark, [("AppF", "b", "1999-06-01", 5, "scrape copy", 1)])
    a = {(r["layer"], r["step"]): (r["rows_in"], r["rows_out"]) for r in cl.clean_step_audit(h, s, FIXTURE).collect()}
    assert a[("historical", "length_filter")] == (5, 4)
    assert a[("historical", "dedup")] == (4, 3)
    assert a[("historical", "date_filter")] == (3, 2)
    assert a[("historical", "rating_filter")] == (2, 1)
    assert a[("gold", "cross_source_dedup")] == (2, 1)


def test_validation_flags(spark, gold_df):
    from revlens.plans.quality import ValidationError, require, validate
    g = gold_df([
        {"review_id": "1", "app": "AppF", "date": "1999-01-01 00:00:00", "rating": 3, "review_text": "ok ok"},
        {"review_id": "1", "app": "AppX", "date": None, "rating": 7, "review_text": None},
    ])
    v = {r["check"]: r["passed"] for r in validate(g, FIXTURE).collect()}
    assert v == {"No duplicate review_ids": False, "All ratings 1-5": False, "No null dates": False,
                 "No null review_text": False, "Only 3 apps": False, "Year range 1995-2001": False,
                 "At least 1,000 rows": False}
    import pytest
    with pytest.raises(ValidationError):
        require(validate(g, FIXTURE))


def test_null_ids_form_one_group(spark):
    h = _hist(spark, [
        (None, "first null id", 3, "1999-01-01 00:00:00", "AppF", "help", 0, 1),
        (None, "second null id", 4, "1999-01-01 00:00:00", "AppF", "help", 0, 2),
    ])
    out = cl.silver_historical(h, FIXTURE).collect()
    assert [(r["review_id"], r["review_text"]) for r in out] == [(None, "first null id")]


def test_complaint_text_minimum_is_ten_after_trim(spark, gold_df):
    from revlens.plans.complaints import classified_negatives
    g = gold_df([
        {"review_id": "9", "app": "AppF", "rating": 1, "review_text": "  123456789  ", "date": "1999-01-01 00:00:00"},
        {"review_id": "10", "app": "AppF", "rating": 1, "review_text": "1234567890", "date": "1999-01-01 00:00:00"},
        {"review_id": "pos", "app": "AppF", "rating": 3, "review_text": "1234567890", "date": "1999-01-01 00:00:00"},
    ])
    assert [r["review_id"] for r in classified_negatives(g, FIXTURE).collect()] == ["10"]


def test_gold_build_matches_a_pandas_restatement_on_random_rows(spark):
    import random

    import pandas as pd
    rng = random.Random(21)
    texts = ["", "  ", None, "abcd", " abcde ", "\tnice app\n", "ok", "works well", "　wide space　"]
    dates = ["2024-01-02 10:00:00", "2023-12-31 23:59:59", "bad", "", None, "2024-02-29 00:00:00"]
    hist = []
    for i in range(300):
        f = rng.randrange(3)
        hist.append((rng.choice([f"r{rng.randrange(80)}", None]), rng.choice(texts), rng.choice([None, 0, 1, 3, 5, 6]),
                     rng.choice(dates), ("AppF", "AppO", "AppP")[f], "help", f, i))
    scrape = [(rng.choice(["AppF", "AppO", "AppX"]), f"r{rng.randrange(120)}",
               rng.choice(["2024-03-01", "junk", None]), rng.randint(1, 7), rng.choice(texts), i) for i in range(200)]
    h_df, s_df = _hist(spark, hist), _scrape(spark, scrape)

    # pandas, step by step as the notebook does it (frame order = file, then position)
    h = pd.DataFrame(hist, columns=["review_id", "review_text", "rating", "date", "app", "data_source", "f", "p"])
    h = h.sort_values(["f", "p"], kind="stable")
    h["date"] = pd.to_datetime(h["date"], errors="coerce", format="%Y-%m-%d %H:%M:%S")
    h["review_text"] = h["review_text"].fillna("").astype(str).str.strip()
    h = h[h["review_text"].str.len() >= 5]
    h = h.drop_duplicates(subset="review_id")
    h = h.dropna(subset=["date"])
    h = h[h["rating"].between(1, 5)]
    s = pd.DataFrame(scrape, columns=["app", "review_id", "date", "rating", "review_text", "p"]).sort_values("p", kind="stable")
    s["date"] = pd.to_datetime(s["date"], errors="coerce", format="%Y-%m-%d")
    s["review_text"] = s["review_text"].fillna("").astype(str).str.strip()
    s = s[s["review_text"].str.len() >= 5]
    s = s.drop_duplicates(subset="review_id")
    s = s[s["app"].isin(["AppF", "AppO", "AppP"])]
    g = pd.concat([h[["review_id", "app", "date", "rating", "review_text"]],
                   s[["review_id", "app", "date", "rating", "review_text"]]], ignore_index=True)
    g = g.drop_duplicates(subset="review_id")
    want = [(None if pd.isna(r.review_id) else r.review_id, r.app,
             None if pd.isna(r.date) else r.date.to_pydatetime(), int(r.rating), r.review_text)
            for r in g.itertuples()]

    got = cl.gold_build(h_df, s_df, FIXTURE).select("review_id", "app", "date", "rating", "review_text").collect()
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
