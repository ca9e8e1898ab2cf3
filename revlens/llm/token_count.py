"""Token counts of texts, by rank-synchronous merging in arrays.

The tokenizer file gives an ordered list of merges.  Words between ASCII
white space never share a token, so the words of a run of documents are
gathered, and the pre-tokens of those not met before are held as one ragged
array of symbols.  In each round every sequence finds its lowest-ranked pair
and joins it, all sequences at the same time, until no pair has a rank; what
counts is how many symbols survive.  All occurrences of the pair in a sequence
are joined at once (from the left, without overlap) if every merge only uses
symbols that earlier merges made, which is checked when the file is read; then
the result is that of joining them one by one.  Otherwise a round joins the
leftmost occurrence only.

The normaliser and the splitter are the file's own; special strings inside a
text count as one token each, as the library does by default.  Texts are read
in slices cut at white space, so memory is bounded by ``SLICE``, ``RUN`` and
``CACHE_WORDS`` and not by a text's length, but for a single longer word.

Defined cases: a null or empty text has no bytes and no tokens; an empty table
gives no rows; null and repeated ids are counted each on its own; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import slices

NONE = np.int64(2**62)
#: Bytes of text gathered before its unseen words are merged, bytes of a text
#: split at a time, words kept with their counts, and bytes of a word to be kept.
RUN, SLICE, CACHE_WORDS, CACHE_BYTES = 1 << 22, 1 << 20, 1 << 20, 256
WHITE = re.compile(rb"[\x20\x09-\x0D]")


class Merger:
    """The merges of a tokenizer file, and counts of what they leave."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        kept_out = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False,
                    "ignore_merges": False}
        if model.get("type") != "BPE" or any(model.get(k) not in (v, "", None) for k, v in kept_out.items()):
            raise ValueError(f"{path}: not a plain BPE model")
        added = told.get("added_tokens") or []
        if any(t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens that depend on their surroundings")
        whole = Tokenizer.from_file(path)
        self.normalise = whole.normalizer.normalize_str if whole.normalizer else str
        self.split = whole.pre_tokenizer.pre_tokenize_str
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = [c for c in vocab if len(c) == 1]
        self.symbol = np.full(max(map(ord, chars)) + 2, -1, np.int64)  # the last place: all other characters
        self.last = self.symbol.copy()
        for c in chars:
            self.symbol[ord(c)], self.last[ord(c)] = vocab[c], vocab.get(c + suffix, -1)
        self.width = max(vocab.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = np.array(list(pairs.values()), np.int64)[order].T
        made_by = {made: rank for rank, made in pairs.values()}
        base = {*self.symbol.tolist(), *self.last.tolist()}
        self.ordered = (len(made_by) == len(pairs) and base.isdisjoint(made_by)
                        and all(made_by.get(x, -1) < rank for pair, (rank, _) in pairs.items() for x in pair))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ranks[at], NONE), self.made[at]

    def survivors(self, pieces: list[str]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        codes = np.minimum(codes, len(self.symbol) - 1)
        ends = np.cumsum(lengths)
        symbols = self.symbol[codes]
        symbols[ends - 1] = self.last[codes[ends - 1]]
        known = symbols >= 0
        left = np.zeros(len(pieces), np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)[known]  # characters without a symbol give none
        symbols = symbols[known]
        rank, made = self._pairs(symbols, owner)
        while len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(owner)])
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            left[owner[first[done]]] = size[done]
            if done.any():  # only sequences with a pair to join go on
                on = np.repeat(~done, size)
                owner, symbols, rank, made = owner[on], symbols[on], rank[on], made[on]
                size, least = size[~done], least[~done]
                if not len(owner):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, size))
            new = np.r_[True, (np.diff(hits) > 1) | (owner[hits[1:]] != owner[hits[:-1]])]
            if self.ordered:
                # of overlapping pairs (a run of one symbol) every second one, from the left
                begin = np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
            else:
                hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            symbols[hits] = made[hits]
            keep = np.ones(len(owner), bool)
            keep[hits + 1] = False
            stale = np.zeros(len(owner), bool)
            stale[hits] = True
            stale[hits[hits > 0] - 1] = True  # the pair before it
            owner, symbols, rank, made, stale = owner[keep], symbols[keep], rank[keep], made[keep], stale[keep]
            at = np.flatnonzero(stale)
            rank[at], made[at] = self._pairs_at(symbols, owner, at)
        return left

    def _pairs_at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(owner) - 1)
        rank, made = self._rank(symbols[at], symbols[after])
        rank[(after == at) | (owner[at] != owner[after])] = NONE
        return rank, made

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(owner):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._pairs_at(symbols, owner, np.arange(len(owner)))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (no white space within)."""
        tokens = np.zeros(len(words), np.int64)
        pieces, owner = [], []
        for k, raw in enumerate(words):
            word = raw.decode("utf-8", "replace")
            parts = [word]
            if self.special and self.special.search(word):
                tokens[k] = len(self.special.findall(word))
                parts = self.special.split(word)
            for part in parts:
                if part:
                    found = [x for x, _ in self.split(self.normalise(part)) if x]
                    pieces += found
                    owner += [k] * len(found)
        if pieces:
            np.add.at(tokens, np.array(owner), self.survivors(pieces))
        return tokens


def _merger(path: str) -> tuple[Merger, dict[bytes, int]]:
    """One merger and one cache of counts per worker process."""
    held = sys.modules.setdefault("_revlens_llm_counts", types.ModuleType("_revlens_llm_counts")).__dict__
    if path not in held:
        held[path] = Merger(path), {}
    return held[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, by the tokenizer file ``path``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, cache = _merger(path)
        for batch in batches:
            total = np.zeros(len(batch), np.int64)
            held: list[tuple[int, list[bytes]]] = []
            size = 0

            def flush() -> None:
                seen = set().union(*(ws for _, ws in held))
                if len(cache) + len(seen) > CACHE_WORDS:
                    cache.clear()
                new = list(seen.difference(cache))
                cache.update(zip(new, merger.count(new).tolist()))
                for row, ws in held:
                    total[row] += sum(map(cache.__getitem__, ws))
                for w in new:
                    if len(w) > CACHE_BYTES:
                        del cache[w]
                held.clear()

            for row, text in enumerate(batch.column(1)):
                for part in slices(text.as_py() or b"", WHITE, SLICE):
                    held.append((row, part.split()))
                    size += len(part)
                    if size >= RUN:
                        flush()
                        size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total)], ["id", "n_bytes", "n_tokens"])

    text = docs[text_col].cast("binary")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(of, "id long, n_bytes long, n_tokens long")
