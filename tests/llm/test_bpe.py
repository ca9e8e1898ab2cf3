import random
import tracemalloc
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from revlens.llm import bpe

from .helpers import docs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(5)
    rows = [None, "", " ", "   ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a \nb", "a \n \n b", "\n\n", "x   y",
            "don't I'll 's 're", "naïve café ÜBER ß 123 4567", "日本語テスト", "😀😀 ok", "x" * 200, "ab" * 400, "é" * 300, "\x1c a\x1fb",
            "word " * 3000, "<|endoftext|> end", "tab\tsep \t x", "　wide space "]
    alphabet = "ab'sé \n\t .,1😀  $日"
    rows += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400)]
    return list(enumerate(rows))


def test_equals_the_library_and_decodes(spark):
    enc, rows = library(), texts() + [(None, "null id"), (3, "same id")]
    want = sorted(((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows), key=str)
    for given in ({}, {"block": 500}, {"block": 2000, "sample": 100, "usual": 40}, {"block": 500, "chunks": 100, "usual": 0}):
        table = docs(spark, rows).repartition(2)
        made = [bpe.encode(table, PATH, public_tokenizers.PATTERN, decoded=True, **given)]
        if not given:
            made.append(bpe.decode(bpe.encode(table, PATH, public_tokenizers.PATTERN), PATH))
        for df in made:
            assert sorted(((r.id, bytes(r.ids), bytes(r.raw)) for r in df.collect()), key=str) == want


def test_long_words_merge_like_the_fold():
    ranks, enc, rng = bpe.read_ranks(PATH), library(), random.Random(6)
    for alphabet in ("ab", "the quick".replace(" ", ""), "xyzé"):
        for n in (1, 2, 5, 300, 3000):
            w = "".join(rng.choices(alphabet, k=n))
            assert bpe.merge_long(w.encode(), ranks) == enc.encode_ordinary(w)


def test_empty_and_clashing_names(spark):
    assert bpe.encode(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    odd = docs(spark, [(1, "a b")]).selectExpr("*", "1 as id", "2 as ids", "3 as words", "4 as merged")
    assert [(r.id, len(r.ids)) for r in bpe.encode(odd, PATH, public_tokenizers.PATTERN).collect()] == [(1, 8)]


def test_rank_table_finds_each_pair_and_no_other():
    ranks = bpe.read_ranks(PATH)
    starts, table = bpe.rank_table(ranks)
    by_id, rng = {r: p for p, r in ranks.items()}, random.Random(1)
    pairs = [(ranks[p[:k]], ranks[p[k:]]) for p in rng.sample(sorted(ranks), 5000) for k in range(1, len(p))
             if p[:k] in ranks and p[k:] in ranks]
    pairs += [(rng.randrange(len(ranks)), rng.randrange(len(ranks))) for _ in range(20000)]
    for a, b in pairs:
        entry, rank = int(table[starts[a] + b]), ranks.get(by_id[a] + by_id[b])
        assert (entry >> 32 if entry >= 0 and entry & bpe.ID == a else None) == rank


def test_ids_are_written_some_codes_at_a_time():
    n, usual = 240_000, (np.arange(8, dtype=np.int32), np.array([8]))
    numbers = dict(doc_chunks=[100] * (n // 100), codes=[0] * n, chunk_words=[1], words_of_chunk=[0], given=[], given_sizes=[])
    row = pa.RecordBatch.from_arrays(
        [pa.array([0], pa.int32()), pa.array([list(range(n // 100))], pa.list_(pa.int64())),
         *(pa.array([np.array(v, np.int32).tobytes()]) for v in numbers.values())], ["turn", "ids", *numbers])
    tracemalloc.start()
    rows = sum(len(b) for b in bpe._encoded(iter([row]), usual))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n // 100 and peak < 30e6


def test_a_table_holds_no_known_words():
    import regex
    table = bpe._Table(regex.compile(public_tokenizers.PATTERN).findall, bpe.read_ranks(PATH), {"a": 64, " b": 65}, 100)
    table.add(1, "a b b new")
    assert list(table.words) == [" new"] and table.words_of_chunk == [64, 65, 100] and table.codes[0].tolist()[:2] == [0, 1]


def test_fold_takes_few_passes_over_a_word(spark):
    """Each step found its pair by a lambda over all parts and cut the array at two places."""
    from pyspark.sql import functions as F
    plan = str(bpe.merger(bpe.read_ranks(PATH))(F.col("words")))
    assert "slice(" not in plan and "array_position(" in plan


def test_letters_between_spaces_need_no_search():
    import regex
    searched = []
    pattern = regex.compile(public_tokenizers.PATTERN)

    class Watched:
        __self__ = pattern

        def __call__(self, text):
            searched.append(text)
            return pattern.findall(text)

    table = bpe._Table(Watched(), bpe.read_ranks(PATH), {}, 100)
    table.add(1, "naïve new new, words")
    assert searched == [" new,"] and list(table.words) == ["naïve", " new", ",", " words"]
    letter = regex.compile(r"\p{L}").fullmatch
    assert all(letter(c) for c in map(chr, range(0x110000)) if c.isalpha())


def test_usual_words_fill_their_room(spark):
    """Words of the first frequency without room for all of it were all left out."""
    letters = ["".join(x) for x in product("qzxvjkwy", repeat=4)][:1000]
    rows = docs(spark, [(i, f"{a}{b}") for i, (a, b) in enumerate(zip(letters, reversed(letters)))]).select("text")
    ranks = bpe.read_ranks(PATH)
    known = [len(bpe._usual(rows, public_tokenizers.PATTERN, ranks, bpe.merger(ranks), 10**6, most)[0]) for most in (0, 400, 2000)]
    assert known[0] == 0 and 300 <= known[1] <= 400 and known[2] > 800


def test_fold_compares_passing_parts_least():
    """Each part was compared with three places, two of them reckoned anew."""
    from pyspark.sql import functions as F
    plan = str(bpe.merger(bpe.read_ranks(PATH))(F.col("words")))
    assert plan.split("array_remove(")[1].split("CASE WHEN ")[1].startswith(">(")
