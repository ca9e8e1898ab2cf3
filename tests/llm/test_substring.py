import random

import numpy as np
import pytest

from revlens.llm import substring

from .helpers import docs, words


def brute(rows, window):
    first = {}
    for i, t in rows:
        ws = words(t)
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k:k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        ws = words(t)
        gone = set()
        for k in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def sample(window):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)] + ["É", "x y", "#"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, other = text(window + 20), text(window)
    rows = [(i, f"{text(rng.randrange(30))}\n{passage} {text(rng.randrange(30))}") for i in range(25)]
    rows += [(100 + i, f"{text(5)} {other}\t{text(5)}") for i in range(4)] + [(200, passage), (200, text(90)), (200, other)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a b"), (None, passage), (304, "z " * 900), (305, "z " * 700), (305, "z " * 700),
             (306, text(window - 1)), (307, text(20000)), (50, rows[0][1]), (-4, rows[1][1])]
    return rows


@pytest.mark.parametrize("bucket", [substring.BUCKET, 2])
@pytest.mark.parametrize("window,gram", [(50, 8), (10, 3), (4, 8)])
def test_against_brute_force(spark, window, gram, bucket):
    rows = sample(window)
    got = substring.remove_repeated(docs(spark, rows), window, gram, bucket)
    assert sorted(((r.c0, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == brute(rows, window)


def test_super_kmers_hold_every_window_once(monkeypatch):
    rng = random.Random(1)
    ws = [rng.choice("abcdef").encode() * rng.randrange(1, 4) for _ in range(3000)] + [b"q"] * 1500
    whole = substring.word_hashes(ws)
    monkeypatch.setattr(substring, "SLICE", 7)
    assert np.array_equal(whole, substring.word_hashes(ws))
    mini, start, n = substring.super_kmers(ws)
    assert n.max() <= substring.RUN and start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all()
    assert start[-1] + n[-1] == len(ws) - 49


def test_clean_keeps_columns_and_untouched_texts(spark):
    p = " ".join(f"p{i}" for i in range(60))
    odd = docs(spark, [(1, f"a\n{p}"), (2, f"b\n {p}  c"), (3, "one \n two")]).selectExpr(
        "*", "1 as kept", "2 as c0", "3 as n_words", "4 as id", "5 as mark", "6 as spans")
    got = substring.clean(odd)
    assert got.columns == odd.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"a\n{p}", 2: "b c", 3: "one \n two"}
    assert substring.clean(docs(spark, [])).count() == 0
