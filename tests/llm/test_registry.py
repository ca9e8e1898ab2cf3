import pytest

from revlens.llm import registry

COLUMNS = {
    "op1_line_dedup": {"doc_id", "line_no", "component_id", "kept"},
    "op2_simhash": {"doc_id", "fingerprint", "component_id"},
    "op3_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op4_substring": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_embed_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op7_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op9_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op10_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op11_periodic": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_token_count": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op13_ranked_search": {"item_id", "rank", "doc_id", "score"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_covers_its_table(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert COLUMNS[name] <= set(df.columns)
    table = {"op6_embed_dedup": "embeddings", "op8_url_filter": "pages"}.get(name, "documents")
    rows, there = df.count(), spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    if name == "op13_ranked_search":  # 50 documents at most for each item
        items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
        assert items <= rows <= 50 * items
    else:
        assert rows >= there if name in ("op1_line_dedup", "op9_packing") else rows == there


def test_queries_equal_their_sql(spark):
    from tools.parity import compare
    found = compare(spark, "/root/testdata/sf0.001", list(registry.ORACLE), verbose=False)
    assert {k: v[0] for k, v in found.items()} == dict.fromkeys(registry.ORACLE, "OK")
