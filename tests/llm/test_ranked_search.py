import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm import ranked_search, registry

from .helpers import docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, queries, k):
    """(item, rank, doc, score) of every query by scoring all documents."""
    counted = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for doc, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return Counter(out)


def zipf_text(rng, vocabulary, n):
    return " ".join(vocabulary[min(int(rng.paretovariate(0.7)) - 1, len(vocabulary) - 1)] for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(2000)]
    rows = [(k, zipf_text(rng, vocabulary, rng.choice([3, 20, 60, 200]))) for k in range(1500)]
    rows += [(2000 + k, rows[k % 7][1]) for k in range(300)]  # copies tie
    rows += [(3000, None), (3001, ""), (3002, "?! -- \n"), (None, rows[3][1]), (None, rows[3][1]), (5, rows[9][1]),
             (3003, "Größe GRÖSSE größe x y ÀB àb"), (3004, "a1-B2_c3.d4\x7fe5\x00f6")]
    queries = [(k, zipf_text(rng, vocabulary, rng.choice([1, 2, 10, 40]))) for k in range(60)]
    queries += [(100, None), (101, "..."), (102, "nowhere"), (103, "GRÖSSE ÀB b2 F6"), (None, "w3 w700"), (7, "w1"), (7, "w1 w2")]
    return rows, queries


@pytest.mark.parametrize("segment,group_terms,parts", [(16_000_000, 200_000, 1), (20_000, 50, 4)])
def test_equal_to_brute_force(spark, corpus, segment, group_terms, parts):
    rows, queries = corpus
    index = ranked_search.build_index(docs(spark, rows, parts), segment=segment)
    found = ranked_search.search(index, spark.createDataFrame(queries, ITEMS).repartition(2), k=20, group_terms=group_terms)
    assert found.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert Counter(map(tuple, found.collect())) == brute(rows, queries, 20)


def test_blocks_are_rejected_before_decompression(spark, corpus):
    """A rare term with a frequent one: few of the frequent one's blocks are read."""
    rng = random.Random(8)
    rows = [(k, "often " * rng.randint(1, 3) + f"x{k}") for k in range(20_000)]
    for k in (5, 77, 19_000):
        rows[k] = (k, "often rare rare rare")
    builder = ranked_search._Builder()
    for k, t in rows:
        builder.add(k, t.encode())
    batch = builder.row(len(rows), sum(builder.lengths))
    segment = ranked_search._Segment({n: batch.column(c)[0].as_py() for c, n in enumerate(ranked_search.NAMES)})
    best = ranked_search.Best(3)
    partial = np.zeros(len(segment.ids), np.int64)
    ranked_search.search_segment(segment, [(b"often", 30), (b"rare", 9000)], best, partial)
    assert sorted(best.rows[2].tolist()) == [5, 77, 19_000] and not partial.any()
    assert 0 < len(segment.held) <= 3 < len(segment.block_ends) // 10


def test_terms_cross_no_slice(monkeypatch):
    monkeypatch.setattr(ranked_search, "SLICE", 10)
    text = "Größe, alpha-BETA; gamma" * 20
    assert [t for part in ranked_search.terms(text.encode()) for t in part] == [t.encode() for t in terms(text)]


def test_empty_tables_and_clashing_names(spark):
    some, none = docs(spark, [(1, "a b")]), docs(spark, [(1, "a")]).where("false")
    items = spark.createDataFrame([(1, "a")], ITEMS)
    for d, q in ((none, items), (some, items.where("false")), (docs(spark, [(1, None)]), items)):
        assert ranked_search.search(ranked_search.build_index(d), q).count() == 0
    odd = some.union(docs(spark, [(2, "c")])).select("*", F.lit(1).alias("id"), F.lit("x").alias("terms"), F.lit(0).alias("rank"))
    found = ranked_search.search(ranked_search.build_index(odd), items.withColumn("score", F.lit("s")).withColumn("id", F.lit(0)))
    assert [r[:3] for r in map(tuple, found.collect())] == [(1, 1, 1)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    queries = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert Counter(map(tuple, registry.op13_ranked_search(spark, folder).collect())) == brute(rows, queries, 50)
