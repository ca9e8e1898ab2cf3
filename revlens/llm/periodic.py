"""Detection of periodic runs by internal pattern matching.

A run is a longest stretch of consecutive words with smallest period q, at
least ``max(MIN_WORDS, MIN_REPEATS * q)`` words long, that no neighbouring word
extends keeping the period.

A run of period q holds a dyadic block (2**k words from a multiple of 2**k on)
with ``(2**(k+1) - 1) / 3 <= q < (2**(k+2) - 1) / 3`` together with its copy q
words later.  So each block asks for its occurrences in the window of those
distances: they are the values of one interval of the suffix array, and a
wavelet tree over it counts those in the window and finds the first ones
(range successor).  Up to two occurrences are candidate periods.  More form
an arithmetic progression, whose step p is the block's own period: a run
around it must end the stretch of period p at the block and at its copy alike,
so only the distances between the ends, and between the starts, of the two
stretches are candidates.  The longest stretch of each candidate comes from
longest common extensions over the names of dyadic factors, which the sorting
of the suffix array leaves behind.

Documents are read in batches of ``BATCH`` words; words of different documents
count as different, so the arrays of a batch are its documents' arrays side by
side.  A longer document is a batch of its own and takes memory in proportion
to its words times their logarithm.

Defined cases: a null or empty text has no words and no runs; an empty table
gives no rows; null and repeated ids stand each on its own; extra columns are
ignored, whatever their names.  Of equal stretches only the one with the
smallest period is a run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_REPEATS = 6, 4
BATCH = 1 << 17


class Suffixes:
    """The suffix array of a batch (one alphabet per document), and for each
    k the names of all factors of 2**k words: equal factors have equal names,
    a name being the first place of their interval in the suffix array."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = self.n = len(words)
        key = owner * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        ranks = self._named(key[self.order], np.arange(n), np.empty(n, np.int64), self.order)
        self.names = [ranks.astype(np.int32)]
        step = 1
        while True:
            size = np.bincount(ranks, minlength=n)
            open_places = np.flatnonzero(size[ranks[self.order]] > 1)
            if not len(open_places):
                break
            at = self.order[open_places]
            after = np.minimum(at + step, n - 1)
            second = np.where((at + step < n) & (owner[after] == owner[at]), ranks[after], -1)
            key = ranks[at] * (n + 1) + second + 1
            sort = np.argsort(key, kind="stable")
            self.order[open_places] = at[sort]
            ranks = self._named(key[sort], open_places, ranks.copy(), at[sort])
            self.names.append(ranks.astype(np.int32))
            step *= 2

    @staticmethod
    def _named(keys: np.ndarray, places: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks in which those of the sorted keys are renewed."""
        first = np.r_[True, keys[1:] != keys[:-1]][:len(keys)]
        ranks[at] = places[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        return ranks

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j (> i) on."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            same = (j < self.n) & (names[np.minimum(i, self.n - 1)] == names[np.minimum(j, self.n - 1)])
            i, j = i + (same << k), j + (same << k)
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and before j (> i)."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, back = self.names[k], 1 << k
            same = (i >= back) & (names[np.maximum(i - back, 0)] == names[np.maximum(j - back, 0)])
            i, j = i - (same << k), j - (same << k)
        return start - i


class WaveletTree:
    """Range queries over an array, a level for each bit of its values."""

    def __init__(self, values: np.ndarray):
        self.bits = range(len(values).bit_length() - 1, -1, -1)
        self.zeros = []
        for b in self.bits:
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            values = np.r_[values[~one], values[one]]

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the places lo..hi-1 hold less than the value."""
        found = np.zeros(len(lo), np.int64)
        for b, zeros in zip(self.bits, self.zeros):
            left, right = zeros[lo], zeros[hi]
            one = (value >> b & 1).astype(bool)
            found += np.where(one, right - left, 0)
            lo, hi = (np.where(one, zeros[-1] + x - z, z) for x, z in ((lo, left), (hi, right)))
        return found

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) at the places lo..hi-1."""
        value = np.zeros(len(lo), np.int64)
        for b, zeros in zip(self.bits, self.zeros):
            left, right = zeros[lo], zeros[hi]
            one = k >= right - left
            k = np.where(one, k - (right - left), k)
            value |= one.astype(np.int64) << b
            lo, hi = (np.where(one, zeros[-1] + x - z, z) for x, z in ((lo, left), (hi, right)))
        return value


def _candidates(suffixes: Suffixes, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) that the blocks of 2**k words propose."""
    block = 1 << k
    least, most = -(-(2 * block - 1) // 3), -(-(4 * block - 1) // 3) - 1
    names = suffixes.names[k]
    size = np.bincount(names, minlength=suffixes.n)
    at = np.arange(0, suffixes.n, block)
    at = at[size[names[at]] > 1]
    lo = names[at].astype(np.int64)
    hi = lo + size[lo]
    before = tree.below(lo, hi, np.minimum(at + least, suffixes.n))
    found = tree.below(lo, hi, np.minimum(at + most + 1, suffixes.n)) - before
    some = found > 0
    at, lo, hi, before, found = (x[some] for x in (at, lo, hi, before, found))
    first = tree.kth(lo, hi, before)
    more = found > 1
    second = tree.kth(lo[more], hi[more], before[more] + 1)
    places, distances = [at[found <= 2], at[found == 2]], [(first - at)[found <= 2], (second - at[more])[found[more] == 2]]
    many = found > 2
    if many.any():
        x, y, p = at[many], first[many], (second - first[more])[found[more] > 2]
        for ends in (lambda i: i + suffixes.ahead(i, i + p), lambda i: i - suffixes.behind(i, i + p)):
            places.append(x)
            distances.append(ends(y) - ends(x))
    at, distance = np.concatenate(places), np.concatenate(distances)
    fits = (distance >= least) & (distance <= most)
    return at[fits], distance[fits]


def runs(words: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS,
         repeats: int = MIN_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start, then period.  ``words``:
    numbers of the words of documents one after another, ``owner``: rising
    numbers of their documents.  Needs ``repeats >= 4`` and ``min_words >= 4``."""
    empty = (np.zeros(0, np.int64),) * 3
    if not len(words):
        return empty
    suffixes = Suffixes(words, owner)
    if len(suffixes.names) < 2:
        return empty
    tree = WaveletTree(suffixes.order)
    found = [_candidates(suffixes, tree, k) for k in range(1, len(suffixes.names))]
    at, period = (np.concatenate([f[c] for f in found]) for c in (0, 1))
    end = at + period + suffixes.ahead(at, at + period)
    start = at - suffixes.behind(at, at + period)
    whole = end - start >= np.maximum(min_words, repeats * period)
    start, end, period = start[whole], end[whole], period[whole]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def _batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    """Rows of the documents with these words."""
    number = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    start, end, period = runs(np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, len(owner)), owner)
    begins = np.cumsum(sizes) - sizes
    of = owner[start]
    held = pa.StructArray.from_arrays([pa.array(start - begins[of]), pa.array(end - start), pa.array(period)],
                                      ["start", "length", "period"])
    offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    # words inside a run after its first period
    depth = np.zeros(len(owner) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    stays = np.cumsum(depth[:-1]) == 0
    collapsed = []
    for k, ws in enumerate(texts):
        if offsets[k] < offsets[k + 1]:
            at = begins[k]
            ws = [w for w, stay in zip(ws, stays[at:at + len(ws)].tolist()) if stay]
        collapsed.append(b" ".join(ws))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), held),
         pa.array(collapsed, pa.binary())], ["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_words: int = BATCH) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start, then
    period, and its words, joined by one space, without those that any run
    contains after its first period."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                texts.append((text.as_py() or b"").split())
                size += len(texts[-1])
                if size >= batch_words:
                    yield _batch(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _batch(ids, texts)

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(of, SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))
