"""End to end: raw CSV files (written from the fixture's raw views) ->
run_study -> gold equals the in-memory gold build; nine results and eight
BI tables written."""

import os
import tempfile

from pyspark.sql import functions as F

from revlens.params import FIXTURE
from revlens.plans import cleaning
from revlens.plans.study import run_study
from revlens.schema import GOLD, RAW_HISTORICAL, RAW_SCRAPE
from revlens.sources import files
from revlens.sources import testdata as td
from tests.conftest import SF_SMALL


def _write_csv(df, cols, path):
    (df.orderBy("_pos").select(*cols).coalesce(1).write.mode("overwrite")
       .option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def test_run_study_from_csv_files(spark):
    d = tempfile.mkdtemp(prefix="revlens-study-")
    rh, rs = td.raw_historical(spark, SF_SMALL), td.raw_scrape(spark, SF_SMALL)
    manifest = []
    for i, (app, src) in enumerate(td.HIST_MANIFEST):
        p = os.path.join(d, f"{app}_{src}")
        _write_csv(rh.where((F.col("app") == app) & (F.col("data_source") == src)),
                   RAW_HISTORICAL.fieldNames(), p)
        manifest.append((p, app, src))
    sp = os.path.join(d, "scrape")
    _write_csv(rs, RAW_SCRAPE.fieldNames(), sp)

    out = run_study(spark, manifest, sp, os.path.join(d, "out"), FIXTURE)
    gold = spark.read.parquet(out["gold"])
    want = cleaning.gold_build(rh, rs, FIXTURE)
    key = ["review_id", "app", "rating", "review_text"]
    assert sorted(map(tuple, gold.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert len([x for x in os.listdir(out["results"]) if x.endswith(".csv")]) == 9
    # the export is in table order over its numbered files, and reads back whole
    export = files.read_gold(spark, out["gold_export"])
    assert sorted(map(tuple, export.select(*key).collect())) == sorted(map(tuple, gold.select(*key).collect()))
    placed = files.read_csv_by_header(spark, out["gold_export"], GOLD).orderBy("_pos").select("app", "date", "review_id")
    assert [tuple(r) for r in placed.collect()] == sorted(map(tuple, gold.select("app", "date", "review_id").collect()))
    # the raw rows' dates that are none are the rejects
    rejects = spark.read.parquet(out["rejects"]).groupBy("reason", "column").count().collect()
    assert [tuple(r) for r in rejects] == [("not a date", "at", rh.where("at = 'bad'").count())]
    # the same run with each CSV read by many tasks
    split = run_study(spark, manifest, sp, os.path.join(d, "split"), FIXTURE, split=True)
    again = spark.read.parquet(split["gold"])
    assert sorted(map(str, again.collect())) == sorted(map(str, gold.collect()))
    assert len(os.listdir(out["bi"])) == 8
    checks = spark.read.parquet(out["checks"]).count()
    assert checks == 7

    # strict mode: the sf0.001 gold is below FIXTURE's 1,000-row minimum, so
    # the run stops after the checks and writes no result sets
    import pytest
    from revlens.plans.quality import ValidationError
    strict_out = os.path.join(d, "strict")
    with pytest.raises(ValidationError):
        run_study(spark, manifest, sp, strict_out, FIXTURE, strict=True)
    assert os.path.exists(os.path.join(strict_out, "checks")) and not os.path.exists(os.path.join(strict_out, "results"))
