import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import langid

from .helpers import docs


def brute_profile(text, dimensions):
    points = langid.letters(text)
    out = np.zeros(dimensions)
    for a, b, c in zip(points, points[1:], points[2:]):
        va, vb, vc = (langid._letter_vectors(np.array([x]), dimensions)[0] for x in (a, b, c))
        out += np.roll(va, 2) * np.roll(vb, 1) * vc
    return out


def test_profiles_against_brute_force(monkeypatch):
    texts = ["Hello, World", "", "a", "été été", "日本 x", "abc" * 50, "12 !! 34"]
    made = [langid.letters(t) for t in texts]
    for part in (langid.RUN_GRAMS, 3):
        monkeypatch.setattr(langid, "RUN_GRAMS", part)
        got = langid.profiles(made, np.arange(len(texts)), len(texts), 64)
        for g, t in zip(got, texts):
            assert np.array_equal(g, brute_profile(t, 64))


def test_prediction_against_brute_force(spark):
    rows = [(i, f"the cat and the dog number {i} went home", "en") for i in range(20)]
    rows += [(100 + i, f"der hund und die katze nummer {i} gingen heim", "de") for i in range(20)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!", "en"), (203, "the dog", None), (None, "der hund", "de"), (None, "x", None)]
    got = langid.identify(docs(spark, rows), dimensions=256).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    proto = {}
    for i, t, lang in rows:
        if lang and t and not out(i):
            proto[lang] = proto.get(lang, 0) + brute_profile(t, 256)
    want = []
    for i, t, _ in rows:
        p = brute_profile(t or "", 256)
        if not len(langid.letters(t or "")):
            want.append((i, "und", 0.0, out(i)))
            continue
        cos = {k: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for k, v in sorted(proto.items())}
        best = max(cos, key=cos.get)
        want.append((i, best, round(max(0, cos[best]), 9), out(i)))
    assert sorted(((r.id, r.lang_pred, round(r.score, 9), r.held_out) for r in got), key=str) == sorted(want, key=str)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.identify(d).where("held_out").join(d.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert got.where("lang = lang_pred").count() > 0.99 * got.count()


def test_nothing_learned_too_many_empty_and_clashing(spark):
    got = langid.identify(docs(spark, [(1, "abc"), (2, None)])).collect()
    assert {(r.id, r.lang_pred, r.score) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.identify(docs(spark, [])).count() == 0
    odd = docs(spark, [(1, "abc def", "en"), (4, "abc", "en")]).selectExpr("*", "1 as id", "'q' as profile", "2 as score")
    assert {r.lang_pred for r in langid.identify(odd).collect()} <= {"en", "und"}
    with pytest.raises(ValueError):
        langid.learn(docs(spark, [(i, "abc def", f"l{i}") for i in range(9)]), max_languages=5)
