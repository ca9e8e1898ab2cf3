from pyspark.sql import types as T

from revlens.operators.conform import add_nulls, conform, drop, rename, tag
from revlens.operators.dedup import dedup_first_by_rank, union_all
from revlens.schema import GOLD


def test_tag_rename_drop(spark):
    df = spark.createDataFrame([("1", "x", "img")], "reviewId string, content string, userImage string")
    out = drop(rename(tag(df, app="AppF", data_source="help"), {"reviewId": "review_id", "missing": "m"}), "userImage", "nope")
    assert out.columns == ["review_id", "content", "app", "data_source"]
    assert out.first()["app"] == "AppF"


def test_add_nulls_and_conform(spark):
    df = spark.createDataFrame([("1", 4, "extra")], "review_id string, rating int, junk string")
    filled = add_nulls(df, GOLD)
    assert set(GOLD.fieldNames()) <= set(filled.columns) and filled.first()["reply_text"] is None
    c = conform(df, GOLD)
    assert c.columns == list(GOLD.fieldNames()) and c.schema == GOLD
    assert c.first()["rating"] == 4 and c.first()["date"] is None


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "a")], "k int, x string")
    b = spark.createDataFrame([("b", 2, 9)], "x string, k int, y int")
    rows = sorted(tuple(r) for r in union_all([a, b]).collect())
    assert rows == [(1, "a", None), (2, "b", 9)]


def test_first_rank_keeps_all_copies_of_the_first_group(spark):
    df = spark.createDataFrame([("u1", 0, 1), ("u1", 0, 2), ("u1", 1, 3), ("u2", 1, 4), ("u2", 2, 5)],
                               "url string, q int, pos int")
    got = sorted(r["pos"] for r in dedup_first_by_rank(df, "url", "q").collect())
    assert got == [1, 2, 4]


def test_sql_views_over_gold(spark):
    from revlens.catalog import QUERIES, _gold, _neg, P
    from revlens.plans.views import register_views
    from tests.conftest import SF_SMALL
    names = register_views(_gold(spark, SF_SMALL), _neg(spark, SF_SMALL), P)
    assert len(names) == 11
    via_sql = spark.sql("SELECT * FROM q3_complaint_categories_result1").collect()
    assert sorted(map(tuple, via_sql)) == sorted(map(tuple, QUERIES["complaint_categories"](spark, SF_SMALL).collect()))
    # an ad-hoc T-SQL style question in Spark SQL: the word count's shape
    top = spark.sql("""
        SELECT word, count(*) AS frequency
        FROM reviews LATERAL VIEW explode(split(lower(review_text), ' ')) w AS word
        WHERE rating <= 2 AND length(trim(review_text)) >= 10 AND length(word) > 3
        GROUP BY word ORDER BY frequency DESC, word LIMIT 5""").collect()
    assert len(top) == 5
