import zlib

import numpy as np
import pytest
import xxhash

from revlens.llm import registry, sharding

from .helpers import docs


@pytest.mark.parametrize("total", [1, 2, 3, 24, 1000, 4097])
def test_permutation_is_one_to_one_and_inverts(total):
    made = sharding.permute(np.arange(total), total)
    assert sorted(made.tolist()) == list(range(total))
    assert (sharding.permute(made, total, back=True) == np.arange(total)).all()


def test_laws_and_locations(spark):
    rows = [(i, f"text {i} é") for i in range(500)] + [(7, "same")] * 300 + [(None, None), (3, None), (4, "")]
    got = sharding.shard_rows(docs(spark, rows), shards=24).collect()
    assert len(got) == len(rows)
    counts = np.bincount([r.shard for r in got], minlength=24)
    assert counts.max() - counts.min() <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    for r in got[::50]:
        assert sharding.locate(r.row_number, len(rows), 24) == (r.shard, r.slot)
        assert sharding.row_at(r.shard, r.slot, len(rows), 24) == r.row_number
    raw = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert raw == sorted((str(r.id), r["size"], r.text_crc32) for r in got)
    again = sharding.shard_rows(docs(spark, rows, parts=7), shards=24).collect()
    key = lambda r: (str(r.id), r["size"], r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_and_clashing_names(spark):
    assert sharding.shard_rows(docs(spark, [])).count() == 0
    odd = docs(spark, [(1, "a")]).selectExpr("*", "1 as id", "2 as shard", "3 as _part", "'x' as size")
    assert [(r.id, r["size"], r.shard) for r in sharding.shard_rows(odd, shards=1).collect()] == [(1, 9, 0)]


def restated(number, total, seed):
    """The Feistel walk for one row number, in plain integers."""
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    word = 2**64 - 1
    while True:
        left, right = number >> half, number & (2**half - 1)
        for r in range(6):
            key = (seed * 2 + 1) * (2 * r + 3) * 0x2545F4914F6CDD1D & word
            x = (right + key) * 0x9E3779B97F4A7C15 & word
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & word
            left, right = right, left ^ ((x ^ x >> 29) & (2**half - 1))
        number = left << half | right
        if number < total:
            return number


def test_query_against_restatement(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    facts = []
    for i, t in rows:
        raw = (t or "").encode()
        h = xxhash.xxh64_intdigest(raw, 42)
        facts.append((i, zlib.crc32(raw), h - 2**64 if h >= 2**63 else h, len(raw) + 8))
    want = {}
    for number, (i, crc, _, size) in enumerate(sorted(facts)):
        p = restated(number, len(rows), sharding.SEED)
        want[i] = (size, crc, "rows", p % 24, p // 24, None)
    got = registry.op3_sharding(spark, folder)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
