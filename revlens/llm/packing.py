"""Packing of tokenised documents into sequences, by swap-based local search.

A document's ids are cut into pieces of ``capacity`` tokens; full pieces are
sequences of their own.  The rest is dealt evenly into groups of at most
``GROUP`` pieces, packed best-fit with the longest first.  While a group has
more bins than its tokens need, a local search moves a document into a
fuller bin, or exchanges one for one, two for one or one for two, wherever
that fills the fuller bin further (the sum of squared fills grows), until no
two underfull bins have such an exchange; bins that empty are dropped.  Then the pieces of each group's loosest bins are dealt
into fewer groups and packed again, until one group is left.

Tokenising: words between ASCII white space never share a token, so each
distinct word is encoded once per process (the cache is bounded) and a
document is the concatenation of its words' ids.  Latin letters alone are one
piece to the tokenizer's model, whatever is before and after: they go to the
model itself, all other words through the whole tokenizer.

Defined cases: a null text is empty and has the end id alone; null ids and
repeated rows are packed like any other; no rows give no rows.  Extra columns
are ignored, whatever their names.  A very long text is many pieces.  Pieces of
equal length are packed by their place.  Text that spells a special token, such
as ``<|endoftext|>``, is that token, as in the tokenizer's plain call.

Over ``RETURN`` underfull bins the search makes whole rounds instead of going
back to the loosest after each move: another order, so maybe other bins, but
the same end: no two underfull bins with an exchange left.
"""

from __future__ import annotations

import math
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import durable

CAPACITY = 4096
END_ID = 1
GROUP = 50_000
CACHE_WORDS = 1 << 20
#: Bins filled less than this are packed again with those of other groups.
LOOSE = 0.9
#: Underfull bins up to which a search returns to the loosest after a move.
RETURN = 512
#: ASCII marks that never share a token with a letter or digit before them.
MARKS = b".,!?;:$%&*#@^~+=()/\"-_"
#: Letters of ASCII and Latin-1, in UTF-8, and marks after them.
LETTERS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([" + re.escape(MARKS) + rb"]*)")
#: How the tokenizer's model spells bytes: printable ones as in Latin-1, the
#: others by the characters from 256 on.
SPELLED = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 512)))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = tuple(t.content.lower().encode() for t in added)

    def plain(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def letters(self, core: bytes) -> bytes:
        """Ids of letters of one case, which the tokenizer lower-cases."""
        spelled = core.decode("latin-1") if core.isascii() else core.decode("latin-1").translate(SPELLED)
        made = array("I", [t.id for t in self.model.tokenize(spelled)])
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if found := LETTERS.fullmatch(word):  # words alike but for case and marks share an entry
            core, tail = found.groups()
            low = core.lower() if core.isascii() else core.decode("utf-8").lower().encode("utf-8")
            if tail:
                made = self[low] + self[tail]
            else:
                made = self[low] if low != word else self.letters(word)
        else:
            core = word.rstrip(MARKS)
            tail = word[len(core):]
            low = core.lower() if core.isascii() else core  # as the tokenizer does
            if any(x in word.lower() for x in self.special):  # such strings are tokens in their own case only
                made = self.plain(word)
            elif core and tail and core[-1:].isalnum():
                made = self[low] + self[tail]
            elif low != word and not tail:
                made = self[low]
            else:
                made = self.plain(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = made
        return made


def _word_ids(path: str) -> WordIds:
    """One cache per worker process."""
    held = sys.modules.setdefault("_revlens_llm_words", types.ModuleType("_revlens_llm_words")).__dict__
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
             id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece; ids
    are little-endian unsigned 32-bit integers."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(path).__getitem__
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(encode, (text.as_py() or b"").split())) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kinds[k]) for k in range(5 + with_ids)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(of, PIECES + (", ids binary" if with_ids else ""))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _exchange(full: list[int], loose: list[int], room: int, sizes: list[int]):
    """The positions to swap between two bins that fill the first the most,
    by at most ``room``: (out of the first, out of the second), or None."""
    def sets(of: list[int]) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
        one = list({sizes[i]: (i,) for i in of}.values())  # positions of a size are alike
        two = {sizes[a] + sizes[b]: (a, b) for n, (a,) in enumerate(one) for (b,) in one[n + 1:]}
        seen: dict[int, int] = {}
        for i in of:
            if seen.setdefault(sizes[i], i) != i:
                two[2 * sizes[i]] = (seen[sizes[i]], i)
        return one, list(two.values())

    def total(of: list[tuple[int, ...]]) -> np.ndarray:
        return np.array([sum(sizes[i] for i in x) for x in of], np.int64)

    best, found = 0, None
    (outs, out_pairs), (ins, in_pairs) = sets(full), sets(loose)
    for out, into in (([(), *outs, *out_pairs], ins), (outs, in_pairs)):
        if out and into:
            gain = total(into)[:, None] - total(out)
            gain[gain > room] = 0
            at = int(gain.argmax())
            if gain.flat[at] > best:
                best = int(gain.flat[at])
                found = list(out[at % len(out)]), list(into[at // len(out)])
    return found


def _sums(of: list[int], sizes: list[int]) -> tuple[int, int]:
    """Bit sets of the sizes in a bin, and of the sums of two of them."""
    one = two = 0
    for i in of:
        two |= one << sizes[i]
        one |= 1 << sizes[i]
    return one, two


def _wanted(outs: int, room: int) -> int:
    """Bit t: some sum s of ``outs`` has s < t <= s + room."""
    made, width = outs << 1, 1
    while width < room:
        step = min(width, room - width)
        made |= made << step
        width += step
    return made if room else 0


class _Partners:
    """Bins by place (loosest first): what each offers and takes in an
    exchange, as bit sets, and the union of what a block of bins takes."""

    BLOCK = 128

    def __init__(self, order: list[int], bins: list[list[int]], fill: list[int], sizes: list[int], capacity: int):
        self.order, self.bins, self.fill, self.sizes, self.capacity = order, bins, fill, sizes, capacity
        self.has, self.takes = [(0, 0)] * len(order), [(0, 0)] * len(order)
        self.blocks = [(0, 0)] * -(-len(order) // self.BLOCK)
        for place in range(len(order)):
            self._set(place)
        for k in range(len(self.blocks)):
            self._join(k)

    def _set(self, place: int) -> None:
        b = self.order[place]
        one, two = self.has[place] = _sums(self.bins[b], self.sizes)
        room = self.capacity - self.fill[b]
        self.takes[place] = (_wanted(1 | one | two, room), _wanted(one, room)) if one else (0, 0)

    def _join(self, k: int) -> None:
        one = two = 0
        for x, y in self.takes[k * self.BLOCK:(k + 1) * self.BLOCK]:
            one, two = one | x, two | y
        self.blocks[k] = one, two

    def changed(self, *places: int) -> None:
        for place in places:
            self._set(place)
            self._join(place // self.BLOCK)

    def fullest(self, loose: int) -> int | None:
        """The last place after ``loose`` with a bin as full or fuller that
        has an exchange with it."""
        one, two = self.has[loose]
        least = self.fill[self.order[loose]]
        for k in range(len(self.blocks) - 1, loose // self.BLOCK - 1, -1):
            x, y = self.blocks[k]
            if one & x or two & y:
                for place in range(min(len(self.order), (k + 1) * self.BLOCK) - 1, max(loose, k * self.BLOCK - 1), -1):
                    x, y = self.takes[place]
                    if (one & x or two & y) and self.fill[self.order[place]] >= least:
                        return place
        return None


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins until no more bins can be emptied, or
    no two underfull bins have an exchange left.  Each round goes over the
    bins from the loosest on, and among up to ``RETURN`` bins returns to the
    loosest after one that moved; every exchange adds to the sum of squared
    fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    needed = -(-sum(fill) // capacity)
    n, moved = len(bins), True
    while n > needed and moved:
        order = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        partners, moved = _Partners(order, bins, fill, sizes, capacity), False
        for place, loose in enumerate(order):
            while (other := partners.fullest(place)) is not None:
                full = order[other]
                out, into = _exchange(bins[full], bins[loose], capacity - fill[full], sizes)
                bins[full] = [i for i in bins[full] if i not in out] + into
                bins[loose] = [i for i in bins[loose] if i not in into] + out
                gain = sum(sizes[i] for i in into) - sum(sizes[i] for i in out)
                fill[full], fill[loose], moved = fill[full] + gain, fill[loose] - gain, True
                partners.changed(other, place)
            if not bins[loose]:
                n -= 1
                if n <= needed:
                    break
            if moved and len(order) <= RETURN:
                break
    return [b for b in bins if b]


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _packed(names: list[str], capacity: int, turn: int, last: bool):
    """Places the pieces of one group."""
    def of(table: pa.Table) -> pa.Table:
        base = (turn * 2**26 + table["_group"][0].as_py()) * 2**32
        sizes = table["length"].to_pylist()
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        loose = np.zeros(len(sizes), bool)
        for b, at in enumerate(pack_group(sizes, capacity)):
            place = 0
            for i in at:
                sequence[i], offset[i] = base + b, place
                place += sizes[i]
            loose[at] = not last and place < LOOSE * capacity
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column(
            "offset", pa.array(offset)).append_column("loose", pa.array(loose)).select(names)
    return of


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (written, with a length of at most ``capacity`` each) with
    sequence_id and offset."""
    columns = pieces.columns
    full = pieces.where(F.col("length") >= capacity).select(
        *columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    schema = rest.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"),
                               "loose": F.lit(True)}).schema
    done, turn, n = full, 0, rest.count()
    while n:
        groups = math.ceil(n / group)

        # dealt by place, so that equal rows do not meet in one group
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)))
        made = durable(dealt.groupBy("_group").applyInArrow(
            _packed(schema.names, capacity, turn, groups == 1), schema), f"packed{turn}")
        done = done.unionByName(made.where("not loose").drop("loose"))
        rest, turn = made.where("loose").select(*columns), turn + 1
        left = rest.count()
        if left >= n:  # no denser in fewer groups
            done = done.unionByName(made.where("loose").drop("loose"))
            break
        n = left
    return done


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset."""
    pieces = durable(tokenise(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity)
