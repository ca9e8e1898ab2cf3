import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revlens.llm import registry, token_count
from revlens.llm.common import slices

from .helpers import docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    if not hasattr(library, "tokenizer"):
        library.tokenizer = Tokenizer.from_file(PATH)
    return len(library.tokenizer.encode(text or "", add_special_tokens=False).ids)


def random_word(rng):
    letters = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "éßİΣΊ日本語", "0123456789", "'stllre", "!?#<|>", "🙂a"])
    return "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))


TEXTS = ["", None, " \t\n ", "one two", "end <|endoftext|> x", "a<|endoftext|><|startoftext|>b <|endoftext|", "Don't WE'LL 've",
         "aaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3, "ha" * 500, "nb sp 　x\x1cy", "é ́ é́", "ΣΊΣΥΦΟΣ", "x\x00y"]


def test_equal_to_the_library(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(random_word(rng) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, "one two"), (3, "one two")]
    got = sorted(map(tuple, token_count.count_tokens(docs(spark, rows), PATH).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), library(t)) for i, t in rows], key=str)


def test_long_texts_are_read_in_slices(spark):
    rng = random.Random(6)
    text = " ".join(random_word(rng) for _ in range(60_000))
    word = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    rows = [(1, text), (2, word + " " + text[:5000]), (3, text + "\n" + word)]
    got = {r[0]: (r[1], r[2]) for r in token_count.count_tokens(docs(spark, rows, 1), PATH).collect()}
    assert got == {i: (len(t.encode()), library(t)) for i, t in rows}
    assert b"".join(slices(text.encode(), token_count.WHITE, 1000)) == text.encode()


def test_joining_the_leftmost_pair_only_gives_the_same():
    rng = random.Random(7)
    words = [random_word(rng) for _ in range(300)] + ["ab" * 50, "a" * 41]
    merger = token_count.Merger(PATH)
    assert merger.ordered
    want = [library(w) for w in words]
    for ordered in (True, False):
        merger.ordered = ordered
        assert merger.count([w.encode() for w in words]).tolist() == want


def test_empty_table_and_clashing_names(spark):
    assert token_count.count_tokens(docs(spark, [(1, "a")]).where("false"), PATH).count() == 0
    odd = docs(spark, [(1, "two words")]).select("*", F.lit(7).alias("id"), F.lit("x").alias("n_tokens"), F.lit(1).alias("n_bytes"))
    assert [tuple(r) for r in token_count.count_tokens(odd, PATH).collect()] == [(1, 9, 2)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in registry.QUERIES["op12_token_count"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n = library(r.text)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (
            len((r.text or "").encode()), n, n > 2048)
