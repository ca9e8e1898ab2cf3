import datetime as dt
import random

from revlens.functions.dates import parse_rfc822
from revlens.plans import landing as ld


def test_rfc822_spellings(spark):
    df = spark.createDataFrame([("Tue, 03 Jan 2023 10:00:00 GMT",), ("Tue, 03 Jan 2023 10:00:00 +0530",),
                                ("Tue, 03 Jan 2023 10:00:00 -0100",), ("junk",), (None,),
                                ("Tue, 3 Jan 2023 10:00:00 GMT",)], "s string")
    got = [r[0] for r in df.select(parse_rfc822("s")).collect()]
    assert got == [dt.datetime(2023, 1, 3, 10), dt.datetime(2023, 1, 3, 4, 30),
                   dt.datetime(2023, 1, 3, 11), None, None, dt.datetime(2023, 1, 3, 10)]


def _items(spark, rows):
    return spark.createDataFrame(
        rows, "query string, query_idx int, position long, title string, link string, source string, pubDate string")


def test_feed_landing_rules(spark):
    rows = [
        ("q1", 0, 1, "a", "u1", "s1", None),                                   # no date: kept with ''
        ("q1", 0, 2, "b", "u2", "s1", "Mon, 02 Jan 2023 10:00:00 GMT"),       # before cutoff: dropped
        ("q1", 0, 3, "c", "u3", "s2", "Tue, 03 Jan 2023 10:00:00 GMT"),
        ("q1", 0, 4, "c2", "u3", "s2", "Tue, 03 Jan 2023 11:00:00 GMT"),      # same URL twice in q1: both kept
        ("q2", 1, 5, "d", "u3", "s3", "Wed, 04 Jan 2023 10:00:00 GMT"),       # URL seen in q1: dropped
        ("q2", 1, 6, "e", "u2", "s3", "Wed, 04 Jan 2023 10:00:00 GMT"),       # u2 was dropped in q1: kept
        ("q2", 1, 7, "f", "u9", "s3", "Wed, 04 Jan 2023 10:00:00 GMT"),       # third in q2: cut by cap=2
    ]
    out = ld.feed_landing(_items(spark, rows), "2023-01-03 00:00:00", cap=4).collect()
    got = sorted((r["query"], r["title"], r["date"], r["url"]) for r in out)
    assert got == [("q1", "a", "", "u1"), ("q1", "c", "2023-01-03", "u3"), ("q1", "c2", "2023-01-03", "u3"),
                   ("q2", "e", "2023-01-04", "u2"), ("q2", "f", "2023-01-04", "u9")]
    # cap=2 keeps a, b of q1 (b then fails the cutoff, so u3 is not seen in
    # q1 and d survives in q2) and d, e of q2
    capped = ld.feed_landing(_items(spark, rows), "2023-01-03 00:00:00", cap=2).collect()
    assert sorted(r["title"] for r in capped) == ["a", "d", "e"]


def test_scrape_landing_cap_before_cleaning(spark):
    rows = [("A", str(i), dt.datetime(2024, 1, 1 + i), 5 - i % 5, "   " if i == 9 else f"text {i}", 1, None)
            for i in range(10)]
    df = spark.createDataFrame(rows, "app string, review_id string, date timestamp, rating int, "
                                     "review_text string, thumbs_up int, app_version string")
    out = ld.scrape_landing(df, "2024-01-03 00:00:00", cap=3).collect()
    # newest 3 since the cutoff are ids 9, 8, 7; id 9 has blank text and is dropped after the cap
    assert [r["review_id"] for r in out] == ["8", "7"]
    assert out[0]["date"] == "2024-01-09" and out[0]["app_version"] == ""


def test_feed_landing_on_random_items(spark):
    """Said as conditions on each item: among the first ``cap`` of its query,
    not known to be older than the cutoff, and of the smallest query index
    that its URL has among such items."""
    rng = random.Random(3)
    start = dt.datetime(2023, 1, 1, 5)
    told = {  # how a date is written -> (spelling, day shown) of an hour offset
        "gmt": lambda h: ((start + dt.timedelta(hours=h)).strftime("%a, %d %b %Y %H:%M:%S GMT"),
                          (start + dt.timedelta(hours=h)).strftime("%Y-%m-%d")),
        "east": lambda h: ((start + dt.timedelta(hours=h + 5, minutes=30)).strftime("%a, %d %b %Y %H:%M:%S +0530"),
                           (start + dt.timedelta(hours=h + 5, minutes=30)).strftime("%Y-%m-%d")),
        "junk": lambda h: ("garbage", ""),
        "none": lambda h: (None, ""),
    }
    items = []
    for position in range(400):
        query, url, source, hour = rng.randrange(4), rng.randrange(60), rng.randrange(5), rng.randrange(-72, 72)
        kind = rng.choice(["gmt"] * 4 + ["east"] * 4 + ["junk", "none"])
        items.append((query, position, f"t{position}", f"u{url}", f"s{source}", kind, hour))
    cap, cutoff = 30, dt.datetime(2023, 1, 2, 1)
    kept = [x for x in items
            if sum(y[0] == x[0] and y[1] < x[1] for y in items) < cap
            and (x[5] in ("junk", "none") or start + dt.timedelta(hours=x[6]) >= cutoff)]
    want = [(f"q{x[0]}", told[x[5]](x[6])[1], x[2], x[4], x[3]) for x in kept
            if x[0] == min(y[0] for y in kept if y[3] == x[3])]
    rows = [(f"q{x[0]}", x[0], x[1], x[2], x[3], x[4], told[x[5]](x[6])[0]) for x in items]
    got = ld.feed_landing(_items(spark, rows), str(cutoff), cap)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scrape_landing_on_random_reviews(spark):
    """Said as conditions on each review: fewer than ``cap`` of its app are
    newer (or as new, with a smaller id), its text is not blank, and no copy of
    its id that passes this comes earlier by (app order, newness)."""
    rng = random.Random(9)
    apps = ("Paytm", "BharatPe", "PhonePe", "GPay")  # not alphabetical
    cutoff, cap = dt.datetime(2023, 2, 1), 40
    day = dt.datetime(2023, 1, 1)
    rows = list({(a, i): (a, i, day + dt.timedelta(hours=rng.randrange(24 * 90)), rng.randint(1, 5),
                          rng.choice(["", "  ", None, " good ", "bad\t", "ok then"]), rng.randrange(9), rng.choice([None, "1.2"]))
                 for a, i in ((rng.choice(apps), f"id{rng.randrange(300)}") for _ in range(500))}.values())

    def newer(x):
        return sum(y[0] == x[0] and y[2] >= cutoff and (y[2] > x[2] or (y[2] == x[2] and y[1] < x[1])) for y in rows)

    taken = [x for x in rows if x[2] >= cutoff and newer(x) < cap and (x[4] or "").strip()]
    want = [(x[0], x[1], x[2].strftime("%Y-%m-%d"), x[3], x[4].strip(), x[5], x[6] or "") for x in taken
            if not any(y[1] == x[1] and (apps.index(y[0]), newer(y)) < (apps.index(x[0]), newer(x)) for y in taken)]
    df = spark.createDataFrame(rows, "app string, review_id string, date timestamp_ntz, rating int, "
                                     "review_text string, thumbs_up int, app_version string")
    assert sorted(map(tuple, ld.scrape_landing(df, str(cutoff), cap, apps).collect())) == sorted(want)
