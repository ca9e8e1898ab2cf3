import numpy as np
import pytest

from revlens.llm import embed_dedup as e

from .helpers import groups

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    good = []
    for k, (i, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good.append((k, i, x / np.linalg.norm(x)))
    links = [(a, b) for n, (a, _, x) in enumerate(good) for b, _, y in good[n + 1:] if len(x) == len(y) and x @ y >= 0.95]
    comp = groups(range(len(rows)), links)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[comp[k]] = min(low.get(comp[k], i), i)
    count = np.zeros(len(rows), int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted(((i, int(count[k]), low[comp[k]] if i is not None else None, i is None or low[comp[k]] == i)
                   for k, (i, _) in enumerate(rows)), key=str)


def near(rng, base, spread):
    x = base + rng.normal(size=len(base)) * spread * np.linalg.norm(base) / np.sqrt(len(base))
    return x.astype(np.float32).tolist()


@pytest.mark.parametrize("block", [e.BLOCK, 20])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(200)]
    hub = rng.normal(size=64)
    rows += [(1000 + i, near(rng, hub, 0.1)) for i in range(80)] + [(2000 + i, near(rng, hub, 0.28)) for i in range(60)]
    rows += [(3000 + i, rows[0][1]) for i in range(30)] + [(rows[1][0], rows[1][1]), (None, rows[2][1])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 64), (4003, [None, 1.0]), (4004, [float("nan"), 1.0]), (4005, [float("inf"), 1.0]),
             (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (4008, [3.0]), (4009, [5.0]), (4010, [1e30, 2e30, 0.0]), (4011, [1e-30, 2e-30, 0.0])]
    got = e.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_and_clashing_names(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [1.0, 0.0], 5, 6)], SCHEMA + ", id int, raw int")
    assert {tuple(r) for r in e.near_duplicates(odd).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(e.hadamard(e.hadamard(x)) / 16, x)
