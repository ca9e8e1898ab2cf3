import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import periodic, registry

from .helpers import docs, words


def brute(ws, most=None):
    """(start, length, period) of every run, by trying each period (up to ``most``)."""
    n, least = len(ws), {}
    for q in range(1, (most or n // 4) + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                least.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(ws, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def some_words(rng, size):
    out, target = [], rng.randint(0, size)
    while len(out) < target:
        unit = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 3, 26])]) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.4:  # a period that is itself almost periodic
            unit = unit * rng.randint(1, 6) + [rng.choice("abc")]
        out += (unit * 9)[:rng.randint(1, 8 * len(unit))]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [some_words(rng, 150) for _ in range(rng.randint(1, 5))]
        flat = [w for t in texts for w in t]
        number = {w: k for k, w in enumerate(sorted(set(flat)))}
        owner = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        start, end, period = periodic.runs(np.array([number[w] for w in flat], np.int64), owner)
        want, at = [], 0
        for t in texts:
            want += [(at + s, length, q) for s, length, q in brute(t)]
            at += len(t)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)
    tree = periodic.WaveletTree(values)
    for _ in range(200):
        lo, hi = sorted(rng.integers(0, 1001, 2).tolist())
        v = int(rng.integers(0, 1001))
        one = lambda x: np.array([x])
        assert tree.below(one(lo), one(hi), one(v))[0] == (values[lo:hi] < v).sum()
        if hi > lo:
            k = int(rng.integers(0, hi - lo))
            assert tree.kth(one(lo), one(hi), one(k))[0] == np.sort(values[lo:hi])[k]


def test_documents(spark):
    rng = random.Random(9)
    rows = [(i, " \n".join(some_words(rng, 80))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t"), (None, "a " * 9), (53, "a " * 9), (53, "a " * 9), (54, "é é é é é é")]
    want = sorted((i, len(ws), brute(ws), collapsed(ws, brute(ws))) for i, ws in ((i or -1, words(t)) for i, t in rows))
    for size in (1, 100, 1 << 17):
        found = periodic.find_runs(docs(spark, rows), batch_words=size).collect()
        assert sorted((r.id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found) == want


def test_long_text(spark):
    rng = random.Random(2)
    ws = [rng.choice("abcdefgh") for _ in range(40_000)]
    ws += (ws[:9_000] * 5)[:40_000]
    found = periodic.find_runs(docs(spark, [(1, " ".join(ws))])).first()
    runs = {tuple(r) for r in found.runs}
    assert any(s <= 40_000 and s + n >= 80_000 and q == 9_000 for s, n, q in runs)
    assert set(brute(ws, 5)) == {r for r in runs if r[2] <= 5}
    assert found.collapsed == collapsed(ws, runs)


def test_empty_table_and_clashing_names(spark):
    assert periodic.find_runs(docs(spark, [(1, "a")]).where("false")).count() == 0
    odd = docs(spark, [(1, "x x x x x x y")]).select("*", F.lit(7).alias("id"), F.lit("q").alias("runs"), F.lit(0).alias("n_words"))
    row = periodic.find_runs(odd).first()
    assert (row.id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (1, 7, [(0, 6, 1)], "x y")


def test_query(spark):
    """The planted repeats and the digests, said again in plain Python."""
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in registry.op11_periodic(spark, folder).collect()}
    planted = 0
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ws, h = words(row.text), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and ws:
            g = h // 10
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
            planted += 1
        runs = brute(ws)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        r = got[row.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(ws, runs).encode()).hexdigest()
    assert planted
