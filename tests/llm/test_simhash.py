import itertools
import random
from collections import Counter

import numpy as np
import xxhash

from revlens.llm import components as cc
from revlens.llm import simhash

from .helpers import docs, groups, words


def brute_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    ws = words(low)
    if not ws:
        return 0
    parts = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    known = [(i, f) for i, f in fps if i is not None]
    comp = groups({i for i, _ in known}, [(a, b) for (a, x), (b, y) in itertools.combinations(known, 2)
                                           if (x ^ y).bit_count() <= 3 or a == b])
    return sorted(((i, format(f, "016x"), comp.get(i)) for i, f in fps), key=str)


def test_masks_cover_every_triple():
    for turn in (0, 1):
        made = simhash.masks(3, turn)
        assert len(made) == 15
        for at in itertools.combinations(range(64), 3):
            diff = sum(1 << i for i in at)
            assert any(m & diff == 0 for m in made)


def test_free_bits_of_two_masks_bound_a_bucket():
    a, b = simhash.masks(3), simhash.masks(3, 1)
    assert max(64 - (x | y).bit_count() for x in a for y in b) <= 22


def test_against_brute_force_with_odd_rows(spark):
    rng = random.Random(4)
    vocab = ["un", "Deux", "TROIS", "É", "vier\u00a0x", "cinco", "six", "#7"]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "one two"), (6, "ONE\ttwo\n"), (None, "x y z"),
            (7, "x y z"), (7, "totally other words here"), (8, "x y z"), (8, "x y z"), (9, "a " * 5000)]
    base = [rng.choice(vocab) + str(rng.randrange(30)) for _ in range(300)]
    for i in range(10, 60):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((i, " ".join(t)))
    got = simhash.near_duplicates(docs(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_hot_buckets_are_refined(spark):
    """Thousands of close fingerprints: buckets over the limit go the second way."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.int64)
    fps = sorted({int(b) ^ sum(1 << int(p) for p in rng.choice(63, rng.integers(0, 6), replace=False))
                  for b in base for _ in range(150)})
    rows = [(f, i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, rep long")
    want = groups(range(len(rows)), [(i, j) for (x, i), (y, j) in itertools.combinations(rows, 2)
                                     if (x ^ y).bit_count() <= 3])
    for limit in (1024, 5):
        found = {r.node: r.component for r in cc.components(simhash.links(df, bucket=limit)).collect()}
        assert {i: found.get(i, i) for i in range(len(rows))} == want


def test_empty_table_and_clashing_columns(spark):
    none = docs(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    odd = docs(spark, [(1, "a b c"), (2, "a b c")]).selectExpr("*", "1 as component_id", "2 as fp", "3 as id", "4 as rep")
    assert {tuple(r)[::2] for r in simhash.near_duplicates(odd).collect()} == {(1, 1), (2, 1)}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [1]


def test_deduplicate_keeps_one_row_of_each_group(spark):
    """By brute force over (id, text) with repeated and null ids: what goes is
    near a row that stays, and of each group one row stays."""
    rng = random.Random(11)
    base = [f"word{rng.randrange(40)}" for _ in range(250)]
    rows = [(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (5, "q r s t"), (1, "quite another text"),
            (None, "only without an id"), (None, "only without an id"), (None, None), (7, None), (8, "")]
    for i in range(20, 50):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"word{rng.randrange(40)}"
        rows.append((rng.choice([i, 20, None]), " ".join(t)))
    prints = [simhash.fingerprint(t) for _, t in rows]
    class_of = groups(range(len(rows)), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
                                         if (prints[a] ^ prints[b]).bit_count() <= 3])
    stays = Counter(tuple(r)[:2] for r in simhash.deduplicate(docs(spark, rows)).collect())
    where = {}
    for k, row in enumerate(rows):
        where.setdefault(class_of[k], []).append(row)
    assert stays.total() == len(where)
    for members in where.values():
        smallest = min((i is None, i or 0) for i, _ in members)
        assert sum(stays[m] for m in set(members)) == 1
        assert [m for m in set(members) if stays[m] and (m[0] is None, m[0] or 0) == smallest]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups({x for e in real for x in e}, real)
    assert {r.node: r.component for r in cc.components(df).collect()} == {k: v for k, v in want.items() if k != v}


def test_stars_need_no_round(spark, monkeypatch):
    wrote, durable = [], cc.durable
    monkeypatch.setattr(cc, "durable", lambda *given: wrote.append(1) or durable(*given))
    stars = spark.createDataFrame([(k, k % 5) for k in range(5, 400)], "a long, b long").repartition(4)
    assert {r.node: r.component for r in cc.components(stars).collect()} == {k: k % 5 for k in range(5, 400)}
    assert len(wrote) == 1
    assert cc.components(stars.where("a < 0")).count() == 0
