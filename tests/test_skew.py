"""A key holding a third of all rows must not reach the shuffle whole.

Builds skewed inputs, runs the operators, then reads the executed (AQE
final) plan's shuffle metrics: records written by the hash exchange stay
bounded by (map tasks x distinct keys), not by the size of the hot group.
"""

import uuid

from pyspark.sql import functions as F

from revlens.operators.dedup import dedup_first
from revlens.operators.windows import top_n_per_group
from revlens.params import FIXTURE
from revlens.plans import reports as rp
from revlens.plans.complaints import classified_negatives

N = 60_000
MAPS = 8


def _skewed(spark):
    """A third of the rows share key 'hot'; the rest are unique."""
    return (spark.range(N, numPartitions=MAPS)
            .select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                    F.col("id").alias("pos")))


def _hash_exchange_records(df) -> list[int]:
    """shuffleRecordsWritten of every hash-partitioned exchange in the final
    (post-AQE) plan, in data-flow order (first exchange first)."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()   # run this DataFrame's own adaptive plan to completion
    seen = []

    def visit(node):
        cls = node.getClass().getSimpleName()
        if cls == "AdaptiveSparkPlanExec":
            visit(node.executedPlan())
            return
        if cls.endswith("QueryStageExec"):   # Shuffle / Result / Broadcast stages wrap plans
            visit(node.plan())
            return
        it = node.children().iterator()
        while it.hasNext():
            visit(it.next())
        if cls == "ShuffleExchangeExec" and "hashpartitioning" in node.outputPartitioning().toString():
            seen.append(int(node.metrics().apply("shuffleRecordsWritten").value()))

    plan = qe.executedPlan()
    assert "isFinalPlan=true" in plan.toString()
    visit(plan)
    assert seen and all(v > 0 for v in seen), seen
    return seen


def test_keep_first_sends_hot_key_at_most_once_per_map_task(spark):
    out = dedup_first(_skewed(spark), ["k"], ["pos"])
    hot = out.where(F.col("k") == "hot").collect()
    assert [r["pos"] for r in hot] == [0] and out.count() == N - N // 3 + 1
    written = _hash_exchange_records(out)[0]
    assert written <= (N - N // 3) + MAPS, written


def test_top_n_per_group_sends_at_most_n_per_map_task(spark):
    out = top_n_per_group(_skewed(spark), ["k"], [F.col("pos")], 5)
    assert sorted(r["pos"] for r in out.where(F.col("k") == "hot").collect()) == [0, 3, 6, 9, 12]
    written = _hash_exchange_records(out)[0]
    assert written <= (N - N // 3) + 5 * MAPS, written


def test_reports_combine_a_hot_app_map_side(spark, gold_df):
    rows = [{"review_id": str(i), "app": "AppF" if i % 3 == 0 else f"A{i % 7}", "rating": 1 + i % 5,
             "date": "1999-01-01 00:00:00", "data_source": "help", "review_text": "with license text here"}
            for i in range(3000)]
    g = gold_df(rows).repartition(MAPS)
    written = _hash_exchange_records(rp.ratings_overview(g, FIXTURE))
    # (the repartition is round-robin) the aggregation's hash exchange
    # carries at most one partial row per (map task, app)
    assert written[0] <= MAPS * 8, written
    neg = classified_negatives(g, FIXTURE)
    p3 = rp.complaint_categories(neg).collect()
    assert sum(r["complaint_count"] for r in p3) == neg.count() == 1200   # ratings 1 and 2


def test_hot_url_is_split_by_aqe_in_the_feed_semi_join(spark):
    from revlens.plans.landing import feed_dedup
    items = (spark.range(N, numPartitions=MAPS).select(
        F.lit("q").alias("query"), (F.col("id") % 3).cast("int").alias("query_idx"),
        F.col("id").alias("position"), F.lit("t").alias("title"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
         .otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("link"),
        F.lit("s").alias("source"), F.lit(None).cast("string").alias("pubDate")))
    # thresholds scaled down to the test's size (defaults: 256 MB, factor 5)
    test_conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
                 "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in test_conf}
    try:
        for k, v in test_conf.items():
            spark.conf.set(k, v)
        out = feed_dedup(items)
        qe = out._jdf.queryExecution()
        assert qe.toRdd().count() == N        # every 'hot' row is in query 0, so all stay
        assert "SortMergeJoin(skew=true)" in qe.executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_durable_write_tasks_stay_small_as_the_input_grows(spark, tmp_path):
    """A durable write starts with as many shuffle partitions as its input asks
    for and joins small ones up to a fixed size; settings are put back."""
    from revlens.sources import store
    (tmp_path / "in").mkdir()
    sizes = {}
    for gb in (0, 4):
        with open(tmp_path / "in" / "f.parquet", "wb") as f:
            f.truncate(gb << 30)  # no block of it is written
        seen = {}

        def write(path):
            seen.update({k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                                        "spark.sql.adaptive.coalescePartitions.initialPartitionNum")})
            spark.range(3).write.parquet(path)
        before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        store.materialize_with(spark, write, "sized", uuid.uuid4().hex, [str(tmp_path / "in")])
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
        advisory, parts = map(int, seen.values())
        assert advisory <= 32 << 20
        sizes[gb] = parts
    assert sizes[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) and sizes[4] >= 4 * 128
