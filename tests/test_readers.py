"""Readers on files as they come: CSV bound by header, feeds with text guids,
timestamp spellings, retried stream landing, NULL keys in the URL dedup."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from revlens.functions.dates import parse_ts
from revlens.operators.dedup import dedup_first, dedup_first_by_rank
from revlens.sources import files


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


def test_reviews_are_bound_by_header(spark, tmp_path):
    d = str(tmp_path)
    moved = _write(d, "moved.csv", "score,content,reviewId,at\n5,good,r1,2023-01-01\n")
    index = _write(d, "index.csv", ",reviewId,content,score,extra\n0,r2,\"a\nb\",4,x\n")
    out = {r.reviewId: r for r in files.read_reviews(
        spark, [(moved, "A", "help"), (index, "B", "new")]).collect()}
    assert (out["r1"].score, out["r1"].content, out["r1"].at, out["r1"]._file) == (5, "good", "2023-01-01", 0)
    assert (out["r2"].score, out["r2"].content, out["r2"].at, out["r2"].app) == (4, "a\nb", None, "B")
    assert "extra" not in out["r1"].asDict() and out["r1"].userName is None


def test_missing_key_column_raises(spark, tmp_path):
    path = _write(str(tmp_path), "nokey.csv", "content,score\nx,1\n")
    with pytest.raises(ValueError, match="reviewId"):
        files.read_reviews(spark, [(path, "A", "help")])


def test_scrape_header_with_bom_and_other_order(spark, tmp_path):
    path = _write(str(tmp_path), "scrape.csv", "﻿review_id,app,rating\nr1,A,3\n")
    row = files.read_scrape(spark, path).first()
    assert (row.review_id, row.app, row.rating, row.date) == ("r1", "A", 3, None)


def test_part_files_keep_their_order(spark, tmp_path):
    d = str(tmp_path / "parts")
    _write(d, "part-0.csv", "reviewId,content\nr1,first\n")
    _write(d, "part-1.csv", "reviewId,content\nr1,second\n" + "".join(f"x{i},{'y' * 200}\n" for i in range(50)))
    rows = files.read_reviews(spark, [(d, "A", "help")])
    kept = dedup_first(rows, ["reviewId"], ["_file", "_pos"]).where("reviewId = 'r1'").first()
    assert kept.content == "first"


def test_feed_with_text_guids_attributes_and_missing_tags(spark, tmp_path):
    item = "<item><title>T{0}</title>{1}<guid isPermaLink=\"false\">abc-{0}</guid>{2}</item>"
    _write(str(tmp_path / "query=q"), "feed.xml", "<?xml version=\"1.0\"?>\n<rss version=\"2.0\"><channel><title>feed</title>\n" + "\n".join([
        item.format(1, "<link>http://a/1</link>", "<pubDate>Tue, 03 Jan 2023 10:00:00 GMT</pubDate><source url=\"http://s\">Src</source>"),
        item.format(2, "", "<source url=\"http://s\">Other</source>"),
        item.format(3, "<link>http://a/3</link>", "")]) + "\n</channel></rss>\n")
    rows = files.read_feed_xml(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.title for r in rows] == ["T1", "T2", "T3"]
    assert [r.source for r in rows] == ["Src", "Other", None]
    assert [r.link for r in rows] == ["http://a/1", None, "http://a/3"]
    assert rows[0].pubDate == "Tue, 03 Jan 2023 10:00:00 GMT" and rows[0].query == "q"


TEN = dt.datetime(2023, 1, 1, 10)
SPELLINGS = {
    "2023-01-01 10:00:00": TEN, "2023-01-01T10:00:00": TEN, "2023-01-01 10:00": TEN,
    "2023-01-01T10:00:00Z": TEN, "2023-01-01 15:30:00+05:30": TEN, "2023-01-01 15:30:00+0530": TEN,
    "2023-01-01 10:00:00.123": TEN.replace(microsecond=123000), "2023-01-01 10:00:00.123456": TEN.replace(microsecond=123456),
    "2023-01-01": dt.datetime(2023, 1, 1), "01/02/2023": dt.datetime(2023, 1, 2), "01/02/2023 10:00": dt.datetime(2023, 1, 2, 10),
    "  2023-01-01  ": dt.datetime(2023, 1, 1),
    "2023-02-30": None, "2023-13-01 10:00:00": None, "bad": None, "": None, "10:00": None, "2023": None, "13/40/2023": None,
}


def test_timestamp_spellings(spark):
    df = spark.createDataFrame([(k,) for k in SPELLINGS] + [(None,)], "s string")
    got = {r.s: r.t for r in df.select("s", parse_ts("s").alias("t")).collect()}
    assert got == {**SPELLINGS, None: None}


def test_null_url_rows_stay_in_their_first_query(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 0, "b"), ("u", 1, "c"), (None, 0, "d")], "url string, query_idx int, x string")
    assert sorted(r.x for r in dedup_first_by_rank(df, "url", "query_idx").collect()) == ["b", "c", "d"]


def test_stream_landing_survives_a_failed_batch(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    from revlens.streaming.landing import land_files, read_bronze
    source, root = str(tmp_path / "in"), str(tmp_path / "landed")
    for k in range(3):
        _write(source, f"f{k}.csv", "id,name\n" + "".join(f"{k}{i},n\n" for i in range(5)))
    schema = spark.createDataFrame([], "id string, name string").schema
    write, calls = DataFrameWriter.parquet, []

    def failing(self, path, *args, **more):
        calls.append(path)
        write(self, path, *args, **more)
        if len(calls) == 2:
            raise RuntimeError("lost between the write and the commit")

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(Exception):
        land_files(spark, source, root, f"{root}/_checkpoint", schema, max_files_per_trigger=1)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    land_files(spark, source, root, f"{root}/_checkpoint", schema, max_files_per_trigger=1)
    land_files(spark, source, root, f"{root}/_checkpoint", schema, max_files_per_trigger=1)
    rows = read_bronze(spark, root, schema)
    assert rows.count() == 15 and rows.select(F.count_distinct("id")).first()[0] == 15
