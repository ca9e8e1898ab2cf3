import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from revlens.llm import line_dedup, quality

from .helpers import docs, groups, words
from .test_line_dedup import brute as line_classes
from .test_line_dedup import normal
from .test_packing import check_packed, plain
from .test_quality import verdicts
from .test_simhash import brute_fingerprint
from .test_substring import brute as without_passages


def corpus():
    rng = random.Random(21)
    vocab = [f"wort{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, shared = line(70), line(12)
    rows = []
    for i in range(30):
        rows.append((i, "\n".join([line(25), f"{line(9)} {passage} {line(9)}" if i % 3 == 0 else line(30), shared, line(15)])))
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(200 + i, rows[10 + i][1].replace("wort7", "other7")) for i in range(5)]  # near copies
    rows += [(300 + i, " | ".join(f"x{rng.randrange(50)}#" for _ in range(90))) for i in range(4)]  # junk
    rows += [(400, None), (401, ""), (402, "too short"), (403, (line(20) + "\n") * 8)]
    rows += [(i, "\n".join([line(30), line(40), shared])) for i in (3, 3, 102)]  # several texts under an id
    rows += [(4, rows[4][1])]  # and the same row twice
    return rows


def document_key(i, text):
    """Spark's xxhash64 of an id and a text, signed."""
    h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
    return h - 2**64 if h >= 2**63 else h


def expected(rows, target):
    rows = [r for r, (x, _) in zip(rows, verdicts(rows, target, quality.BUCKETS, quality.TRUSTED_SHARE)) if x[-1]]
    # lines: the first of each class by (id, text hash, line)
    classes, first = line_classes(rows), {}
    spots = [(i, line_dedup.line_id(t.encode()), k, x) for i, t in rows for k, x in enumerate(t.split("\n"))]
    for i, mark, k, x in spots:
        if normal(x):
            first[classes[normal(x)]] = min(first.get(classes[normal(x)], (i, mark, k)), (i, mark, k))
    out = []
    for i, t in rows:
        mark = line_dedup.line_id(t.encode())
        left = [x for k, x in enumerate(t.split("\n")) if not normal(x) or first[classes[normal(x)]] == (i, mark, k)]
        if len(left) == len(t.split("\n")) or words("\n".join(left)):
            out.append((i, "\n".join(left)))
    # of each group of near texts the one of the smallest id, then key
    prints = [brute_fingerprint(t) for _, t in out]
    near = groups(range(len(out)), [(a, b) for a, b in itertools.combinations(range(len(out)), 2)
                                    if (prints[a] ^ prints[b]).bit_count() <= 3])
    stays = {}
    for k, (i, t) in enumerate(out):
        stays[near[k]] = min(stays.get(near[k], (i, document_key(i, t), t)), (i, document_key(i, t), t))
    out = [(i, t) for i, _, t in stays.values()]
    texts = {(i, " ".join(words(t))): t for i, t in out}
    return [(i, kept if gone else texts[i, kept]) for i, _, gone, kept in without_passages(out, 50)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs(spark, corpus()).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "substring_dedup",
                                                      "best_fit_packing"]


def test_whole_pipeline_against_brute_force(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    want = expected(corpus(), set(range(25)))
    pieces = []
    for i, t in want:
        ids = np.array([*plain(t), 1], "<u4")
        pieces += [(i, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
                   for k, at in enumerate(range(0, len(ids), 4096))]
    assert 25 <= len(want) < 45 and len({t for i, t in want if i in (3, 102)}) > 2
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    check_packed(got, 4096)


def test_stages_keep_the_columns_and_take_empty_input(spark, folder):
    for rows in (corpus(), []):
        now = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() >= bool(rows)
