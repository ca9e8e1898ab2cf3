"""The sorted gold table, the manifest's listing, collations, distinct values."""

import datetime as dt
import random

from pyspark.sql import functions as F

from revlens.operators.dedup import dedup_first
from revlens.plans import reports as rp
from revlens.plans.export import suite_manifest, written_files
from revlens.sources import files


def _reviews(gold_df, n, hot=0.6):
    rng = random.Random(1)
    day = dt.datetime(2020, 1, 1)
    return gold_df([{"review_id": f"r{i:05d}", "app": "Hot" if rng.random() < hot else rng.choice(["A", "Z", None]),
                     "date": None if rng.random() < 0.1 else day + dt.timedelta(days=rng.randrange(50)),
                     "rating": 1, "review_text": "x"} for i in range(n)])


def test_numbered_files_are_the_table_in_order(spark, gold_df, tmp_path):
    gold = _reviews(gold_df, 3000)
    files.in_table_order(gold, 8).write.parquet(str(tmp_path / "g"))
    names = sorted(p.name for p in (tmp_path / "g").glob("part-*.parquet"))
    got = [tuple(r) for name in names
           for r in spark.read.parquet(str(tmp_path / "g" / name)).select("app", "date", "review_id").collect()]
    want = sorted(((r.app, r.date, r.review_id) for r in gold.collect()),
                  key=lambda x: (x[0] is not None, x[0] or "", x[1] is None, x[1] or dt.datetime.min, x[2]))
    assert got == want
    # the app with most of the rows is cut: no file holds much more than its share
    sizes = [spark.read.parquet(str(tmp_path / "g" / name)).count() for name in names]
    assert len(sizes) == 8 and max(sizes) < 3000 / 8 * 2
    placed = files.read_positions(spark, str(tmp_path / "g"), "review_id").orderBy("position").collect()
    assert [tuple(r) for r in placed] == [(i + 1, x[2]) for i, x in enumerate(want)]


def test_export_with_byte_order_mark_reads_back(spark, gold_df, tmp_path):
    gold = _reviews(gold_df, 200)
    files.write_gold_csv(files.in_table_order(gold, 3), str(tmp_path / "e"), bom=True)
    parts = sorted((tmp_path / "e").glob("part-*.csv"))
    assert len(parts) == 3 and all(p.read_bytes().startswith(b"\xef\xbb\xbfreview_id,") for p in parts)
    back = files.read_gold(spark, str(tmp_path / "e"))
    assert back.columns == gold.columns and sorted(map(str, back.collect())) == sorted(map(str, gold.collect()))


def test_manifest_lists_missing_files_without_reading_them(spark, tmp_path):
    reports = {n: spark.range(k).withColumnRenamed("id", n) for n, k in (("a", 3), ("b", 0), ("c", 2))}
    out = str(tmp_path / "suite")
    got = lambda: sorted(map(tuple, suite_manifest(spark, out, reports).collect()))
    assert got() == [("a", 0, False), ("b", 0, False), ("c", 0, False)]  # no folder yet
    for n in "ab":
        files.write_report_csv(reports[n], f"{out}/{n}.csv")
    assert got() == [("a", 3, True), ("b", 0, True), ("c", 0, False)]
    listed = written_files(spark, out)
    assert {r.report for r in listed.collect()} == {"a.csv", "b.csv"}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_collation_of_groups_and_keys(spark, gold_df):
    gold = gold_df([{"review_id": "X1", "app": "Alpha", "rating": 2}, {"review_id": "x1", "app": "ALPHA", "rating": 4},
                    {"review_id": "x2", "app": "alpha", "rating": 3}, {"review_id": None, "app": "Beta", "rating": 1},
                    {"review_id": None, "app": None, "rating": 1}])
    got = {r.app: (r.total_reviews, r.avg_rating) for r in rp.import_check(gold, nocase=True).collect()}
    assert got == {"ALPHA": (3, 3.0), "Beta": (1, 1.0), None: (1, 1.0)}
    assert rp.import_check(gold).count() == 5
    kept = dedup_first(gold, ["review_id"], [F.desc("rating"), "app"], rp.NOCASE).select("review_id", "rating").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [("x1", 4), ("x2", 3), (None, 1)]))
    assert dedup_first(gold, ["review_id"], ["rating"]).count() == 4


def test_distinct_values(spark, gold_df):
    gold = gold_df([{"app": "A", "data_source": "s", "date": "2020-01-01 00:00:00"}, {"app": "A", "data_source": None},
                    {"app": "B", "data_source": "t", "date": "2020-05-01 00:00:00"}])
    assert [tuple(r) for r in rp.distinct_values(gold).collect()] == [
        ("app", "A", 2), ("app", "B", 1), ("data_source", None, 1), ("data_source", "s", 1), ("data_source", "t", 1),
        ("year", None, 1), ("year", "2020", 2)]
