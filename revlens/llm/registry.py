"""Queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import (bpe, embed_dedup, langid, line_dedup, packing, periodic, quality, ranked_search, sharding, simhash,
                         substring, token_count, url_filter)
from revlens.llm.common import let, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("mark").withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=24)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeated(docs).select(F.col("c0").alias("doc_id"), "n_words", "n_removed",
                                                  F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (
  SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM split),
windows AS (
  SELECT doc_id, i, word, count(*) OVER w AS size, md5(string_agg(word, ' ') OVER w) AS h FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
first AS (SELECT h, min(doc_id) AS first_id FROM windows WHERE size = 50 GROUP BY h),
judged AS (
  SELECT doc_id, i, word, CASE WHEN size = 50 AND first_id < doc_id THEN 1 ELSE 0 END AS repeats
  FROM windows LEFT JOIN first USING (h)),
covered AS (
  SELECT doc_id, i, word, max(repeats) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM judged),
kept AS (
  SELECT doc_id, cast(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS text
  FROM covered GROUP BY doc_id)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP8_SQL = """
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule FROM cut),
said AS (
  SELECT *, CASE WHEN rule IN ('com/fr/', 'org/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM ruled),
listed AS (
  SELECT host, count(*) FILTER (ruled = 'block') > count(*) FILTER (ruled = 'allow') AS listed FROM said GROUP BY host)
SELECT page_id, said.host AS host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM said JOIN listed ON said.host = listed.host
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "score")


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) ends in 0, the words from one place
    on repeat a period, as the contract of op11 lays down."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(ws):
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted_repeats(_table(spark, sf_dir, "documents")))
    # a longer one replaces the best so far, so of equals the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


TOKEN_LIMIT = 2048


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"), k=50)


_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13_SQL = f"""
WITH wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term FROM benchmark),
found AS (
  SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS terms FROM sizes),
tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
  SELECT term, cast(floor(1000 * ln((2 * docs + 2) / cast(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, corpus GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)) AS c
  FROM tfs JOIN sizes USING (doc_id), corpus),
scores AS (
  SELECT item_id, doc_id, cast(sum(w * c) AS BIGINT) AS score
  FROM wanted JOIN impacts USING (term) JOIN weights USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_substring": op4_substring,
    "op5_bpe": op5_bpe,
    "op6_embed_dedup": op6_embed_dedup,
    "op7_langid": op7_langid,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_periodic": op11_periodic,
    "op12_token_count": op12_token_count,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE: dict[str, str] = {"op4_substring": OP4_SQL, "op8_url_filter": OP8_SQL, "op13_ranked_search": OP13_SQL}
