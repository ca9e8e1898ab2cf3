import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from revlens.llm import quality

from .helpers import docs, words


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def base(text):
    ws, text = words(text), text or ""
    count = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i in range(len(ws) - 2) if count[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def grams(text, buckets):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
    pair = [xxhash_pair(a, b) for a, b in zip(h, h[1:])]
    return [signed(x) % buckets for x in h + pair]


def xxhash_pair(a, b):
    """Spark's xxhash64 of two longs: the first one's hash is the second's seed."""
    return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))


def in_model(i):
    """Whether a trusted document makes the model (else the threshold)."""
    return xxhash.xxh64_intdigest(b"half", xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)) % 2 == 0


def verdicts(rows, target, buckets, share):
    """((counts..., base_failed, kept), score) of each row by plain counting."""
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t, buckets))
        if i in target and in_model(i):
            good.update(grams(t, buckets))
    p_raw = [(raw[k] + 1) / (raw.total() + buckets) for k in range(buckets)]
    ratio = [math.log((good[k] + buckets * p_raw[k]) / (good.total() + buckets)) - math.log(p_raw[k]) for k in range(buckets)]
    scored = []
    for i, t in rows:
        g = grams(t, buckets)
        scored.append((i, base(t), sum(ratio[k] for k in g) / len(g) if g else 0.0))
    own = sorted(score for i, x, score in scored if i in target and not in_model(i) and not x[5])
    threshold = -math.inf
    if own:
        threshold = own[max(0, math.ceil(share * len(own)) - 1)] - 1e-12  # sums in another order
    return [((*x[:5], x[5], not x[5] and score >= threshold), score) for _, x, score in scored]


def sample():
    rng = random.Random(3)
    good = [f"wort{k}" for k in range(60)]
    rows = [(i, "\n".join(" ".join(rng.choices(good, k=rng.randrange(5, 30))) for _ in range(5))) for i in range(40)]
    rows += [(100 + i, " | ".join(f"x{rng.randrange(9)}#{rng.randrange(9)}" for _ in range(80))) for i in range(15)]
    rows += [(200, None), (201, ""), (202, "a b c " * 40), (203, "A\u00a0B c\x0bd\n\n \nA\u00a0B c\x0bd"), (204, "ab cd ef gh " * 3),
             (None, "n n n"), (205, "x" * 70000), (206, "q w e " * 9000)]
    return rows


def test_against_restatement(spark):
    rows, b = sample(), 500
    labels = [(i, 1, 0) for i in range(30)] + [(5, 1, 0), (None, 1, 0), (3, 1, 1), (100, 0, 0), (31, 1, None)]
    L = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(docs(spark, rows), L, buckets=b, trusted_share=0.1).collect()
    want = dict(zip((i for i, _ in rows), verdicts(rows, set(range(30)) | {31}, b, 0.1)))
    assert len(got) == len(rows) and 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got)
    for r in got:
        w, score = want[r.id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == w
        assert math.isclose(r.score, score, abs_tol=1e-9)
    kept = quality.judge(docs(spark, rows), L, buckets=b, trusted_share=0.1, keep_columns=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {i for i, (w, _) in want.items() if w[6]}


def test_no_labels_no_rows_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    text = " ".join(f"w{i}" for i in range(60))
    odd = docs(spark, [(1, text), (2, "short")]).selectExpr("*", "1 as id", "2 as words", "'z' as row", "3 as score", "4 as kept")
    assert {(r.id, r.kept, r.score) for r in quality.judge(odd, none).collect()} == {(1, True, 0.0), (2, False, 0.0)}
    assert quality.judge(docs(spark, []), none).count() == 0
    assert [r.doc_id for r in quality.judge(odd, none, keep_columns=True).collect()] == [1]


def test_plan_has_no_python(spark):
    L = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality.judge(docs(spark, [(1, "a b")]), L)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [50, 5000])
def test_clean_documents_stay_whatever_the_corpus(spark, n):
    """Trusted documents stay, and so do others as clean (of which a few score
    below the lowest of a dozen trusted ones); junk of other words goes."""
    rng = random.Random(n)
    vocab = [f"wort{k}" for k in range(400)]
    clean = [(i, " ".join(rng.choices(vocab, k=rng.randrange(60, 200)))) for i in range(n)]
    junk = [(n + i, " ".join(f"x{rng.randrange(40)}#{rng.randrange(40)}" for _ in range(120))) for i in range(n // 10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs(spark, clean + junk), labels, keep_columns=True).collect()}
    assert len([i for i in range(0, n, 2) if i in kept]) >= 0.99 * n / 2
    assert len([i for i, _ in clean if i in kept]) >= (0.9 if n == 50 else 0.97) * n
    assert not [i for i, _ in junk if i in kept]


def test_good_and_bad_labels_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    L = spark.read.parquet(f"{d}/labels.parquet")
    j = quality.judge(spark.read.parquet(f"{d}/documents.parquet"), L)
    rate = {r.quality: r.kept for r in j.where("not base_failed").join(L, j.id == L.doc_id).groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.995 and rate[0] < 0.1


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_trusted_document_counts(spark, monkeypatch, broadcast):
    """More trusted documents than 20,000: the model counts its whole half and
    the threshold is a quantile of the whole other half."""
    if not broadcast:
        monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    monkeypatch.setattr(quality, "NTH_ROWS", 100)
    n, b, share = 24_000, 50, 0.3
    rng = random.Random(8)
    kinds = [" ".join(f"w{rng.randrange(60 * (k + 1))}" for _ in range(60)) for k in range(40)]
    of = [rng.randrange(40) for _ in range(n)]
    rows = [(i, kinds[k]) for i, k in enumerate(of)] + [(n + k, t) for k, t in enumerate(kinds)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    counts, own = Counter(of), Counter(k for i, k in enumerate(of) if in_model(i))
    held = [k for i, k in enumerate(of) if not in_model(i)]
    raw, good = Counter(), Counter()
    for k, t in enumerate(kinds):
        for g in grams(t, b):
            raw[g] += counts[k] + 1
            good[g] += own[k]
    p_raw = [(raw[x] + 1) / (raw.total() + b) for x in range(b)]
    ratio = [math.log((good[x] + b * p_raw[x]) / (good.total() + b)) - math.log(p_raw[x]) for x in range(b)]
    scores = [sum(ratio[x] for x in grams(t, b)) / len(grams(t, b)) for t in kinds]
    threshold = sorted(scores[k] for k in held)[math.ceil(share * len(held)) - 1]
    judged = quality.judge(docs(spark, rows), labels, buckets=b, trusted_share=share).where(F.col("id") >= n).collect()
    for r in judged:
        assert math.isclose(r.score, scores[r.id - n], abs_tol=1e-12)
        assert r.kept == (scores[r.id - n] >= threshold - 1e-13)
    assert 0 < sum(r.kept for r in judged) < 40


def test_nth_smallest(spark):
    rng = random.Random(4)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [0.5] * 900 + [rng.random() for _ in range(900)], [1.0], [2.0] * 500):
        scores = spark.createDataFrame([(v,) for v in values], "score double").repartition(5).cache()
        for share in (0.002, 0.3, 0.5, 1.0):
            want = sorted(values)[max(1, math.ceil(share * len(values))) - 1]
            assert quality.nth_smallest(scores, share, rows=20) == want
    assert quality.nth_smallest(scores.where("false"), 0.5) is None


def test_words_are_hashed_and_sorted_by_generated_code(spark):
    """Windows were sorted by a comparing lambda, and the hashes of words and
    pairs for the model made in lambdas, before they were exploded."""
    judged = quality._scored(docs(spark, [(1, "a b")]), [0.0] * 5, 5).select("n_repeat_words")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "lambda left" not in plan
    L = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.judge(docs(spark, [(1, "a b")]), L, buckets=5, keep_columns=True)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("sort_array(transform(") == 1  # not once more in the filter
    seen = []
    rows = docs(spark, [(1, "a b a b"), (2, None), (3, "a")]).selectExpr("1 as raw", "cast(null as int) as model", "text")
    before = type(rows).groupBy
    type(rows).groupBy = lambda self, *by: seen.append(self) or before(self, *by)
    try:
        assert len(quality.fit(rows, 7)) == 7
    finally:
        type(rows).groupBy = before
    assert "lambda" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_windows_over_each_other(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randrange(0, 40)))) for i in range(300)]
    got = quality._scored(docs(spark, rows), [0.0] * 5, 5).select("doc_id", "n_repeat_words").collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: base(t)[4] for i, t in rows}
