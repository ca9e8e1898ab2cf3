"""CSV files read by many tasks, and the reject table."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.schema import RAW_HISTORICAL, RAW_SCRAPE
from revlens.sources import files, records
from revlens.sources import testdata as td
from revlens.sources.records import split_records

NAMES = RAW_HISTORICAL.fieldNames()


def _csv(rows, eol):
    def cell(v):
        if v is None:
            return ""
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\r\n') or v != v.strip() else v
    return eol.join(",".join(map(cell, r)) for r in [NAMES, *rows]) + eol


def _some_rows(rng, n):
    pieces = ["fine", ' "quoted" ', "line\nbreak", "cr\r\nlf", ",", "é漢🙂", '"', "\n\n", "a,b", "x" * 40, " "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        rows.append([f"id{i}", rng.choice(pieces), None, text, rng.choice(["1", "5", "7", "bad", None]), str(i),
                     None, rng.choice(["2020-01-02 03:04:05", "never", None]), None, None])
    return rows


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _plain(df):
    return [(tuple(r)[:len(NAMES)], r["_rejects"]) for r in df.orderBy("_pos").collect()]


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
@pytest.mark.parametrize("bom", [False, True])
def test_one_file_by_many_tasks_equals_the_multiline_reader(spark, small_splits, tmp_path, eol, bom):
    path = str(tmp_path / "reviews.csv")
    text = _csv(_some_rows(random.Random(len(eol)), 150), eol)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        f.write(text)
    split = files.read_reviews(spark, [(path, "A", "s")], split=True)
    whole = files.read_reviews(spark, [(path, "A", "s")])
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.rdd.getNumPartitions() > 10
    assert split.columns == whole.columns and split.count() == 150
    assert _plain(split) == _plain(whole)


def test_a_record_over_several_splits(spark, small_splits, tmp_path):
    path = str(tmp_path / "long.csv")
    texts = ["a\n" * 2000, "short", '"' * 301, "b, \n" * 900, "end"]
    with open(path, "w", newline="") as f:
        f.write(_csv([[f"id{i}", None, None, t, "3", "0", None, None, None, None] for i, t in enumerate(texts)], "\n").rstrip("\n"))
    got = files.read_reviews(spark, [(path, "A", "s")], split=True).orderBy("_pos").select("reviewId", "content").collect()
    assert [tuple(r) for r in got] == [(f"id{i}", t) for i, t in enumerate(texts)]
    assert [r["at"] for r in split_records(spark, path).orderBy("at").collect()][0] == 0


def test_files_of_a_folder_need_one_header(spark, tmp_path):
    for name, header in (("a", "reviewId,content"), ("b", "content,reviewId")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n1,x\n")
    with pytest.raises(Exception, match="header differs"):
        files.read_reviews(spark, [(str(tmp_path), "A", "s")], split=True).collect()
    (tmp_path / "b.csv").write_text("reviewId,content\n2,y\n")
    got = files.read_reviews(spark, [(str(tmp_path), "A", "s")], split=True).select("reviewId", "content", "score").collect()
    assert sorted(map(tuple, got)) == [("1", "x", None), ("2", "y", None)]


def test_absent_columns_and_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("content\nx\n")
    with pytest.raises(ValueError, match="reviewId"):
        files.read_reviews(spark, [(str(tmp_path / "a.csv"), "A", "s")], split=True)
    (tmp_path / "b.csv").write_text("reviewId,content\n")
    assert files.read_reviews(spark, [(str(tmp_path / "b.csv"), "A", "s")], split=True).count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_reject_table(spark, tmp_path, split):
    path = tmp_path / "r.csv"
    path.write_text(",".join(NAMES) + "\n"
                    "ok,u,i,text,5,1,1.0,2020-01-01,,\n"
                    "cut,u,i,text\n"
                    "wide,u,i,text,5,1,1.0,2020-01-01,,,extra\n"
                    "num,u,i,text,five,1.5x,1.0,2020-01-01,,\n"
                    "day,u,i,text,5,1,1.0,someday,,2020-13-45\n"
                    "blank,u,i,text, ,,1.0,,,\n")
    bronze = files.read_reviews(spark, [(str(path), "A", "s")], split=split)
    got = sorted(((r.app, r.data_source, r.file.rsplit("/", 1)[1], r.reason, r.column, r.value)
                  for r in files.rejects(bronze).collect()), key=str)
    assert got == sorted([
        ("A", "s", "r.csv", files.BROKEN, None, "cut,u,i,text"),
        ("A", "s", "r.csv", files.BROKEN, None, "wide,u,i,text,5,1,1.0,2020-01-01,,,extra"),
        ("A", "s", "r.csv", files.NOT_A_NUMBER, "score", "five"),
        ("A", "s", "r.csv", files.NOT_A_NUMBER, "thumbsUpCount", "1.5x"),
        ("A", "s", "r.csv", files.NOT_A_DATE, "at", "someday"),
        ("A", "s", "r.csv", files.NOT_A_DATE, "repliedAt", "2020-13-45")], key=str)
    rows = {r.reviewId: r for r in bronze.collect()}
    assert len(rows) == 6 and rows["num"].score is None and rows["cut"].content == "text" and rows["cut"].score is None
    assert bronze.where(F.size("_rejects") == 0).count() == 2


@pytest.mark.parametrize("broadcast", [True, False])
def test_records_over_batches_and_splits_without_sorting_lines(spark, small_splits, tmp_path, monkeypatch, broadcast):
    """Records that go on over batches and splits; read where they lie, lines
    are neither shuffled nor sorted."""
    if not broadcast:
        monkeypatch.setattr(records, "BROADCAST_SPLITS", 0)
    rows = _some_rows(random.Random(9), 150)
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes(_csv(rows[k::2], "\n").encode())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        split = files.read_reviews(spark, [(str(tmp_path), "A", "s")], split=True)
        whole = files.read_reviews(spark, [(str(tmp_path), "A", "s")])
        assert _plain(split) == _plain(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    if broadcast:
        plan = split_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "id#" in x and ("Sort" in x or "Exchange" in x)]


def test_raw_csv_shuffles_a_text_once(spark):
    """Each raw file starts with its header, holds an order's rows in order and
    no other file of its folder has that order; all rows are there."""
    sf = "/root/testdata/sf0.001"
    plan = td.csv_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    # in this plan an exchange stands above each scan, and none above the join with the texts
    assert plan.count("doc_id#") and plan.count("Exchange") == 3
    manifest, scrape = td.raw_csv(spark, sf)
    for path, app, source in [*manifest, (scrape, None, "fresh")]:
        text = spark.read.text(path, wholetext=True).collect()
        assert {t[0].split("\n")[0] for t in text} == {",".join(NAMES) if app else "﻿" + ",".join(RAW_SCRAPE.fieldNames())}
    landed = files.read_scrape(spark, scrape, "fresh", split=True).select("review_id", "_pos", "rating", "thumbs_up").collect()
    raw = td.raw_scrape(spark, sf).select("review_id", "_pos", "rating", "thumbs_up").collect()
    by_id = {}
    for r in sorted(landed, key=lambda r: r["_pos"]):
        by_id.setdefault(r["review_id"], []).append((r["_pos"]["file"], r["rating"], r["thumbs_up"]))
    want = {}
    for r in sorted(raw, key=lambda r: r["_pos"]):
        want.setdefault(r["review_id"], []).append((r["rating"], r["thumbs_up"]))
    assert {k: [x[1:] for x in v] for k, v in by_id.items()} == want
    assert all(len({x[0] for x in v}) == 1 for v in by_id.values())
