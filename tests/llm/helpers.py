"""Plain restatements that the operators are held against."""

from collections import Counter

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, rows, parts=3):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(*r, None)[:3] for r in rows]
    return spark.createDataFrame([(a, b, c, "s", len(b or "")) for a, b, c in full], DOCS).repartition(parts)


def words(text):
    return [w.decode("utf-8", "replace") for w in (text or "").encode("utf-8", "replace").split()]


def groups(nodes, links):
    """Smallest node of each node's component."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def rows_of(df):
    return Counter(map(tuple, df.collect()))
