import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from revlens.llm import line_dedup as ld

from .helpers import docs, groups


def normal(line):
    return b" ".join(line.encode().split()).decode()


def brute(rows):
    """{(id, text, line_no): (kept, component as a set of lines)}"""
    lines = sorted({normal(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    sets = {x: ld.shingles(x) for x in lines}
    pairs = [(a, b) for a, b in itertools.combinations(lines, 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return groups(lines, pairs)


def sample():
    rng = random.Random(12)
    vocab = ["alpha", "Beta", "gamma", "délta", "epsilon", "zeta", "eta", "theta", "日本", "iota"]
    line = lambda n: " ".join(f"{rng.choice(vocab)}{rng.randrange(99)}" for _ in range(n))
    rows, base = [], [line(n) for n in (3, 8, 12, 14, 16, 40, 200)]
    for i in range(60):
        out = []
        for b in base:
            ws = b.split(" ")
            for _ in range(rng.randrange(3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            out.append(" ".join(ws) + rng.choice(["", " ", "\t", "!"]))
        out += [line(rng.randrange(1, 30)), "", "short", "ab"]
        rng.shuffle(out)
        rows.append((i, "\n".join(out)))
    return rows + [(100, None), (101, ""), (102, "\n \n"), (None, base[3]), (103, base[2]), (103, base[2]), (103, "other " * 30)]


def test_recall_and_exact_verification(spark):
    rows = sample()
    want = brute(rows)
    got = ld.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == sum(len(t.split("\n")) for _, t in rows if t is not None)
    found, kept = {}, {}
    text = {(i, ld.line_id((t or "").encode())): t for i, t in rows}
    for r in got:
        x = normal(text[r.id, r.mark].split("\n")[r.line_no])
        if not x:
            assert r.kept and r.component_id is None
            continue
        found.setdefault(r.component_id, set()).add(x)
        kept.setdefault(r.component_id, set()).update([(str(r.id), r.mark, r.line_no)] if r.kept else [])
    assert all(len(v) == 1 for v in kept.values())
    parts = {}
    for x, c in want.items():
        parts.setdefault(c, set()).add(x)
    assert all(any(s <= p for p in parts.values()) for s in found.values())  # no link that is not there
    missed = len(found) - len(parts)
    assert missed <= 1  # high recall


def test_band_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    for n in (30, 70, 90, 300):
        hit = total = 0
        for _ in range(60):
            a = "".join(map(chr, rng.integers(97, 123, n)))
            b = a[:len(a) - max(1, int(n * 0.085))] + "".join(map(chr, rng.integers(97, 123, max(1, int(n * 0.085)))))
            x, y = ld.shingles(a), ld.shingles(b)
            if len(x & y) >= 0.8 * len(x | y):
                at, keys = ld.band_keys([a, b])
                total += 1
                hit += bool(set(keys[at == 0].tolist()) & set(keys[at == 1].tolist()))
        assert total > 20 and hit >= 0.97 * total


def repeated():
    """Lines of few distinct shingles in many lengths."""
    units = ["-", "ha ", "=-", "Buy now! ", ". ", "The best price of the whole wide web, today only. "]
    rng = random.Random(8)
    phrase = "".join(rng.choice("abcdefghijklmnop ") for _ in range(72)).strip() + ". "
    return [(u * n)[:m].strip() for u in [*units, phrase] for n, m in ((400, 40), (400, 60), (400, 66), (400, 81), (400, 100),
                                                                      (400, 190), (400, 4000))]


def test_repeated_shingles_share_a_band():
    lines = repeated()
    at, keys = ld.band_keys(lines)
    bands = [set(keys[at == i].tolist()) for i in range(len(lines))]
    sets = [ld.shingles(x) for x in lines]
    alike = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2)
             if len(sets[i] & sets[j]) == len(sets[i] | sets[j])]
    assert any(len(lines[i]) < 64 and len(lines[j]) > 100 for i, j in alike)
    assert [(lines[i], lines[j]) for i, j in alike if not bands[i] & bands[j]] == []


def test_repeated_shingles_against_brute_force(spark):
    # no line in between that has both kinds by its positions
    rows = [(i, x) for i, x in enumerate(repeated()) if not 63 <= len(x) - ld.SHINGLE <= 80]
    want = brute(rows)
    got = {r.id: r.component_id for r in ld.near_duplicates(docs(spark, rows)).collect()}
    parts, found = {}, {}
    for i, x in rows:
        parts.setdefault(want[normal(x)], set()).add(i)
        found.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, parts.values()))


def templates():
    """Lines of one long template that differ in some letters, and close variants of a few."""
    rng = random.Random(9)
    base = "the quick brown fox jumps over the lazy dog while seven wizards boxed a jovial king at noon "
    lines = []
    for k in range(90):
        x = list(base)
        for at in rng.sample(range(len(x)), rng.choice([1, 2, 3, 4])):
            x[at] = rng.choice("0123456789")
        lines.append("".join(x).strip())
    return sorted(set(lines))


def test_blocks_of_a_bucket_miss_no_link(spark):
    lines = templates()
    sets = [ld.shingles(x) for x in lines]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 30 < len(pairs) < len(lines) * (len(lines) - 1) / 3
    left = spark.createDataFrame([(7, i, i, len(lines)) for i in range(len(lines))], "bucket long, id long, component long, n long")
    texts = spark.createDataFrame([(i, x.encode()) for i, x in enumerate(lines)], "id long, line binary")
    want = groups(range(len(lines)), pairs)
    for block in (512, 13):
        got = [tuple(r) for r in ld._across(left, texts, 0.8, block).collect()]
        assert all((min(p), max(p)) in set(pairs) for p in got)
        assert groups(range(len(lines)), got) == want
        if block == 512:  # a star or tree for each component, not its pairs
            assert len(got) == len(lines) - len(set(want.values()))


def test_clean(spark):
    same = "This line stands in every one of these documents, as it is."
    near = "This line stands in every one of those documents, as it is."
    odd = docs(spark, [(1, f"{same}\nfirst"), (2, f"second own words\n{near}\n\nmore"), (3, f"{same}\n"), (4, None), (5, "")]).selectExpr(
        "*", "1 as id", "2 as mark", "3 as row", "4 as gone", "5 as left", "6 as component_id")
    got = ld.clean(odd)
    assert got.columns == odd.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"{same}\nfirst", 2: "second own words\n\nmore", 4: None, 5: ""}
    assert ld.clean(docs(spark, [])).count() == 0
    assert ld.near_duplicates(docs(spark, [])).count() == 0


def test_band_tasks_hold_little():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)).encode() for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    tracemalloc.start()
    for _ in ld._bands(8)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 4 MB of text; 139 MB in runs of 2,097,152 characters


def test_buckets_of_some_dozens_meet_at_once(spark, monkeypatch):
    """Variants of a line that share its buckets but are not similar to each
    other need no further rounds: their buckets meet whole."""
    rng, verified = random.Random(8), []
    base = [f"{rng.randrange(10**8):08d}" for _ in range(60)]
    lines = [" ".join(f"{rng.randrange(10**8):08d}" if rng.random() < 0.13 else w for w in base) for _ in range(120)]
    linked = ld._linked
    monkeypatch.setattr(ld, "_linked", lambda *given: verified.append(1) or linked(*given))
    found = {r.node: r.component for r in ld.line_components(
        spark.createDataFrame([(x.encode(),) for x in lines], "text binary")).collect()}
    assert len(verified) == 1
    want = groups(lines, [(a, b) for a, b in itertools.combinations(lines, 2)
                          if len(ld.shingles(a) & ld.shingles(b)) >= 0.8 * len(ld.shingles(a) | ld.shingles(b))])
    name = {x: ld.line_id(x.encode()) for x in lines}
    same = {frozenset(x for x in lines if want[x] == c) for c in want.values()}
    assert {frozenset(x for x in lines if found.get(name[x], name[x]) == c) for c in
            {found.get(v, v) for v in name.values()}} == same


def test_groups_that_meet_together_stay_apart():
    rng = random.Random(9)
    words = [f"{rng.randrange(10**6):06d}" for _ in range(30)]
    vary = lambda: " ".join(rng.choice(words) if rng.random() < 0.02 else w for w in words).encode()
    groups_of = []
    for two in (False, True, False, True, False):
        groups_of.append([(k % 2 if two else 0, rng.randrange(2**60), k, vary()) for k in range(rng.randrange(2, 12))])
    sets = {r[1]: ld.shingles(r[3].decode()) for rows in groups_of for r in rows}

    def alike(a, b):
        return len(sets[a[1]] & sets[b[1]]) >= 0.8 * len(sets[a[1]] | sets[b[1]])

    for dense in (0, ld.DENSE):
        old, ld.DENSE = ld.DENSE, dense
        try:
            found = list(ld._meet(groups_of, 0.8))
        finally:
            ld.DENSE = old
        for rows in groups_of:
            ids = [r[1] for r in rows]
            pairs = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2)
                     if alike(a, b) and (a[0] != b[0] or len({r[0] for r in rows}) == 1)]
            assert groups(ids, [x for x in found if x[0] in ids]) == groups(ids, pairs)


def test_kinds_go_by_distinct_shingles():
    rng = random.Random(10)
    lines = [("ab" * rng.randrange(1, 120))[:rng.randrange(1, 240)] + "".join(rng.choices("abcdefgh ", k=rng.randrange(0, 160)))
             for _ in range(300)]
    at, _ = ld.band_keys(lines)
    kinds = [(n <= ld.SHORT) + (n >= ld.LONG) for n in (len(ld.shingles(x)) for x in lines)]
    assert np.bincount(at, minlength=len(lines)).tolist() == [ld.BANDS * k for k in kinds]


def test_large_groups_meet_without_further_rounds(spark, monkeypatch):
    """Buckets of hundreds of lines, few of them similar, meet whole after one
    round: a join of lines and buckets for each round added up."""
    rng, verified = random.Random(18), []
    base = [f"{rng.randrange(10**8):08d}" for _ in range(60)]
    lines = [" ".join(f"{rng.randrange(10**8):08d}" if rng.random() < 0.1 else w for w in base) for _ in range(400)]
    linked = ld._linked
    monkeypatch.setattr(ld, "_linked", lambda *given: verified.append(1) or linked(*given))
    found = {r.node: r.component for r in ld.line_components(
        spark.createDataFrame([(x.encode(),) for x in lines], "text binary")).collect()}
    assert len(verified) == 1
    sets = [ld.shingles(x) for x in lines]
    want = groups(range(len(lines)), [(i, j) for i, j in itertools.combinations(range(len(lines)), 2)
                                      if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    names = [ld.line_id(x.encode()) for x in lines]
    parts = {}
    for i, name in enumerate(names):
        parts.setdefault(want[i], set()).add(name)
    assert {name: found.get(name, name) for name in names} == {x: min(s) for s in parts.values() for x in s}


def test_pairs_are_verified_as_by_their_shingles():
    rng = random.Random(20)
    xs = ["".join(rng.choices("abcdef ", k=rng.randrange(1, 300))) for _ in range(600)]
    ys = [x[:int(len(x) * rng.uniform(0.6, 1.1))] + "".join(rng.choices("abcdef日", k=int(len(x) * rng.uniform(0, 0.15)) + 1)) for x in xs]
    ys[::5] = xs[::5]
    sets = [(ld.shingles(x), ld.shingles(y)) for x, y in zip(xs, ys)]
    want = [len(x & y) >= 0.8 * len(x | y) for x, y in sets]
    assert 100 < sum(want) < 500
    assert ld._alike(xs, ys, 0.8).tolist() == want
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(range(600)), *(
        pa.array([x.encode() for x in side], pa.binary()) for side in (xs, ys))], list("abxy"))
    got = pa.Table.from_batches(list(ld._verify(0.8)(iter([batch, batch.slice(0, 0)]))))
    assert got["a"].to_pylist() == got["b"].to_pylist() == [k for k in range(600) if want[k]]


def test_clear_pairs_need_no_sets(monkeypatch):
    """Only pairs near the threshold are compared by sets of strings."""
    rng, built = random.Random(21), []
    line = lambda: " ".join(f"{rng.randrange(10**6):06d}" for _ in range(40))
    lines = [line() for _ in range(20)]
    sets = ld.shingles
    monkeypatch.setattr(ld, "shingles", lambda x: built.append(x) or sets(x))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), *(
        pa.array([x.encode() for x in side], pa.binary()) for side in (lines * 2, [x + "!" for x in lines] + lines[::-1]))], list("abxy"))
    got = pa.Table.from_batches(list(ld._verify(0.8)(iter([batch]))))
    assert got["a"].to_pylist() == list(range(20))
    rows = [(0, k, k, x.encode()) for k, x in enumerate(lines + [x + "!" for x in lines])]
    assert sorted(ld._meet([rows, [rows[0], rows[20]], [rows[0], rows[1]]], 0.8)) == sorted([(0, 20), *((k, 20 + k) for k in range(20))])
    assert not built
