import os
import tempfile

from pyspark.sql import functions as F

from revlens.schema import FEED_ITEM, RAW_SCRAPE
from revlens.sources import files


def _tmp():
    return tempfile.mkdtemp(prefix="revlens-test-")


def test_csv_quoted_newline_and_bom(spark):
    d = _tmp()
    p = os.path.join(d, "scrape.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write('app,review_id,date,rating,review_text,thumbs_up,app_version\n')
        f.write('AppF,1,2024-01-02,5,"line one\nline two, with ""quotes""",3,1.0\n')
        f.write('AppO,2,2024-01-03,1,plain,0,\n')
    df = files.read_scrape(spark, p).orderBy("review_id").collect()
    assert len(df) == 2
    assert df[0]["app"] == "AppF" and df[0]["review_text"] == 'line one\nline two, with "quotes"'
    assert df[1]["app_version"] is None and df[0]["data_source"] == "fresh_scrape_2026"


def test_gold_csv_roundtrip_keeps_blank_reply(spark, gold_df):
    g = gold_df([{"review_id": "1", "app": "AppF", "date": "1999-01-01 10:00:00", "rating": 3,
                  "review_text": " padded, \"quoted\"\nmultiline ", "reply_text": "  ",
                  "reply_date": "1999-01-02 00:00:00", "thumbs_up": None}])
    d = os.path.join(_tmp(), "gold")
    files.write_gold_csv(g, d)
    back = files.read_gold(spark, d).collect()[0]
    assert back["reply_text"] == "  " and back["thumbs_up"] is None
    assert back["review_text"] == " padded, \"quoted\"\nmultiline "
    assert back["date"].isoformat() == "1999-01-01T10:00:00"


def test_xml_items_explicit_schema(spark):
    d = _tmp()
    with open(os.path.join(d, "feed.xml"), "w") as f:
        f.write("<rss><channel><item><title>T1</title><link>u1</link><source url='x'>S</source>"
                "<pubDate>Tue, 03 Jan 2023 10:00:00 GMT</pubDate></item>"
                "<item><title>no date</title><link>u2</link></item></channel></rss>")
    df = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(d)
    rows = sorted(df.collect(), key=lambda r: r["link"])
    assert rows[0]["title"] == "T1" and rows[0]["source"] == "S"
    assert rows[1]["pubDate"] is None and rows[1]["source"] is None


def test_read_reviews_manifest_tags_and_order(spark):
    from revlens.schema import RAW_HISTORICAL
    d = _tmp()
    header = ",".join(RAW_HISTORICAL.fieldNames())
    paths = []
    for name, rows in [("f_help.csv", ['r1,u,i,"first, help",5,1,1.0,2024-01-01 10:00:00,,',
                                       'r2,u,i,second,4,0,1.0,2024-01-02 10:00:00,thanks,2024-01-03 10:00:00']),
                       ("f_new.csv", ['r1,u,i,dup in new,1,0,1.1,2024-02-01 10:00:00,,'])]:
        p = os.path.join(d, name)
        with open(p, "w") as f:
            f.write(header + "\n" + "\n".join(rows) + "\n")
        paths.append(p)
    df = files.read_reviews(spark, [(paths[0], "AppF", "help"), (paths[1], "AppF", "new")])
    from revlens.operators.dedup import dedup_first
    first = dedup_first(df, ["reviewId"], ["_file", "_pos"]).orderBy("reviewId").collect()
    assert [(r["reviewId"], r["data_source"], r["content"]) for r in first] == \
        [("r1", "help", "first, help"), ("r2", "help", "second")]


def test_landing_csv_has_bom_header_and_order(spark):
    df = spark.createDataFrame([("AppO", "1", "2024-01-02"), ("AppF", "2", "2024-01-01"),
                                ("AppF", "3", "2024-01-05")], "app string, review_id string, date string")
    d = os.path.join(_tmp(), "landed")
    files.write_landing_csv(df, d, [F.asc("app"), F.desc("date")])
    part = [f for f in os.listdir(d) if f.startswith("part-") and f.endswith(".csv")][0]
    raw = open(os.path.join(d, part), "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfapp,review_id,date\n")
    assert raw.decode("utf-8-sig").splitlines()[1:] == ["AppF,3,2024-01-05", "AppF,2,2024-01-01",
                                                        "AppO,1,2024-01-02"]
    back = files.read_report_csv(spark, d, df.schema).collect()
    assert back[0]["app"] == "AppF"


def test_bi_export_relabels_and_skips_era_sentiment(spark):
    from revlens.catalog import _suite
    from revlens.params import FIXTURE
    from revlens.plans.export import bi_tables, export_bi
    from tests.conftest import SF_SMALL
    reports = _suite(spark, SF_SMALL)
    tables = bi_tables(reports, FIXTURE)
    assert len(tables) == 8 and "q6_era_comparison_result1" not in str(tables.keys())
    cats = {r[0] for r in tables["tableau_complaints.csv"].select("complaint_category").collect()}
    assert "Other" not in cats and "General Dissatisfaction" in cats
    d = _tmp()
    export_bi(reports, FIXTURE, d)
    assert sorted(os.listdir(d)) == sorted(tables)


def test_stream_landing_is_incremental_and_exactly_once(spark):
    from revlens.streaming.landing import land_files, read_bronze
    d = _tmp()
    src, bronze, ckpt = (os.path.join(d, x) for x in ("in", "bronze", "ckpt"))
    os.makedirs(src)
    schema = RAW_SCRAPE
    header = ",".join(schema.fieldNames())

    def drop(name, rows):
        with open(os.path.join(src, name), "w") as f:
            f.write(header + "\n" + "\n".join(rows) + "\n")

    drop("a.csv", ["AppF,1,2024-01-01,5,good app,1,1.0", "AppF,2,2024-01-02,1,bad app,0,1.0"])
    land_files(spark, src, bronze, ckpt, schema, tags={"a.csv": ("AppF", "fresh"), "b.csv": ("AppO", "fresh")})
    assert read_bronze(spark, bronze, schema).count() == 2
    drop("b.csv", ["AppO,3,2024-01-03,3,\"multi\nline\",2,1.1"])
    land_files(spark, src, bronze, ckpt, schema, tags={"a.csv": ("AppF", "fresh"), "b.csv": ("AppO", "fresh")})
    rows = read_bronze(spark, bronze, schema).orderBy("review_id").collect()
    assert [r["review_id"] for r in rows] == ["1", "2", "3"]
    assert rows[2]["review_text"] == "multi\nline" and rows[2]["_source_file"] == "b.csv"


def test_read_reviews_with_differing_column_sets(spark):
    from pyspark.sql import types as T
    from revlens.schema import RAW_HISTORICAL
    d = _tmp()
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    with open(a, "w") as f:
        f.write(",".join(RAW_HISTORICAL.fieldNames()) + "\nr1,u,i,text one,5,1,1.0,2024-01-01 10:00:00,,\n")
    short = T.StructType([RAW_HISTORICAL[n] for n in ("reviewId", "content", "score", "at")])
    with open(b, "w") as f:
        f.write("reviewId,content,score,at\nr2,text two,4,2024-01-02 10:00:00\n")
    df = files.read_reviews(spark, [(a, "AppF", "help"), (b, "AppF", "new", short)]).orderBy("reviewId").collect()
    assert [(r["reviewId"], r["content"], r["userName"]) for r in df] == [("r1", "text one", "u"),
                                                                          ("r2", "text two", None)]


def test_store_key_sees_a_same_size_overwrite_below_a_partition(spark, tmp_path):
    import os

    from revlens.sources import store
    part = tmp_path / "t" / "year=2020"
    part.mkdir(parents=True)
    (part / "a.parquet").write_bytes(b"1234")
    times = [(x, os.stat(x)) for x in (part, tmp_path / "t")]
    before = store.fingerprint(spark, [str(tmp_path / "t")])
    assert store.fingerprint(spark, [str(tmp_path / "t")]) == before
    (part / "a.parquet").write_bytes(b"5678")
    os.utime(part / "a.parquet", (2_000_000_000, 2_000_000_000))
    for x, t in times:
        os.utime(x, ns=(t.st_atime_ns, t.st_mtime_ns))
    assert store.fingerprint(spark, [str(tmp_path / "t")]) != before
