"""Plan checks (no Python, pre-shuffle group limits, column pruning, scans and
exchanges) and the DuckDB parity of every query of the catalog on sf0.001."""

import pytest

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    from revlens.catalog import QUERIES
    return QUERIES


PYTHON = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups", "FlatMapCoGroups")


def test_no_python_anywhere(spark, queries):
    for name, fn in queries.items():
        p = _plan(fn(spark, SF_SMALL))
        assert not [x for x in PYTHON if x in p], name


def test_audit_is_one_pass(spark, tmp_path):
    """Each source is scanned once; one exchange of ids, one of sums; no text
    behind the scan and no window."""
    from revlens.params import FIXTURE
    from revlens.plans.cleaning import clean_step_audit
    from revlens.sources import testdata as td
    for name, df in (("h", td.raw_historical(spark, SF_SMALL)), ("s", td.raw_scrape(spark, SF_SMALL))):
        df.write.parquet(f"{tmp_path}/{name}")
    audit = clean_step_audit(*(spark.read.parquet(f"{tmp_path}/{n}") for n in "hs"), FIXTURE)
    p = _plan(audit)
    assert p.count("FileScan") == 2 and "Window" not in p and "Join" not in p
    exchanges = [x for x in p.splitlines() if "Exchange" in x and "rangepartitioning" not in x]
    assert len(exchanges) == 2 and "hashpartitioning(review_id" in p and "SinglePartition" in p
    assert not any("review_text" in x for x in p.splitlines() if "SortAggregate" in x or "Exchange" in x)


def test_words_of_a_category_need_no_shuffle_for_the_join(spark, queries):
    p = _plan(queries["word_frequency_other"](spark, SF_SMALL))
    assert "LeftSemi" in p and "Exchange hashpartitioning(review_id" not in p
    assert p.count("Exchange") == 1 and "Exchange hashpartitioning(word" in p


def test_distinct_values_is_one_scan(spark, queries):
    p = _plan(queries["distinct_values"](spark, SF_SMALL))
    assert p.count("FileScan") == 1 and "review_text" not in p


def test_group_limits_run_before_the_shuffle(spark, queries):
    for name in ("era_top_complaint", "dedup_first", "newest_n_per_app", "feed_clean"):
        df = queries[name](spark, SF_SMALL)
        text = df._jdf.queryExecution().executedPlan().toString()
        if name == "era_top_complaint":
            assert "WindowGroupLimit" in text, name
        else:
            assert "Partial" in text and "WindowGroupLimit" in text, name


def test_text_column_is_pruned_from_non_text_reports(spark, queries):
    for name in ("ratings_overview", "rating_trend_yearly", "response_by_year", "era_sentiment", "import_check"):
        p = _plan(queries[name](spark, SF_SMALL))
        assert "review_text" not in p, name


def test_parity_with_duckdb(spark):
    """Every query has SQL; rows, names, types, values, and order where defined."""
    from revlens.catalog import ORACLE, QUERIES
    from tools.parity import compare
    assert set(ORACLE) == set(QUERIES)
    bad = {k: v for k, v in compare(spark, SF_SMALL, list(QUERIES), verbose=False).items() if v[0] != "OK"}
    assert not bad, bad


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["app", "complaint_category", "complaint_count", "pct_of_app_negatives",
                          "rank_within_app"]
    assert df.count() > 0
