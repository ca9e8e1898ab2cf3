"""Byte-level BPE encoding and decoding.

A task reads documents in blocks.  A block is written as codes: numbers of its
chunks (what stands between single spaces), which are numbers of words
(matches of the split pattern).  A row of words that the task meets for the
first time goes before the block that needs them.  The merges run in Spark's
higher-order functions on the words' byte arrays: a fold joins, again and
again, the leftmost pair of neighbours with the lowest rank, looked up in a
literal map from two parts' ids to the rank of both together.  The map is fixed
by the vocabulary; it is laid out in literal arrays, since a lookup in a map
value scans it.  The next step of the same task keeps the ids of its words and
chunks and replaces the blocks' codes.  Decoding concatenates the ids' binary
pieces.  Nothing of the documents is shuffled or written in between.

Each task merges its distinct words once, but for the usual ones: the most
frequent words, at most ``USUAL``, of a sample of some ``SAMPLE`` documents are
merged beforehand and sent to all tasks.  That only spares work, as every other
word is merged where it is met, with the same ids.  A task begins its tables of
words and chunks anew when they are full, so they are bounded.

Words that are pieces themselves need no merge.  The fold's steps each copy
the word's array, so words of over ``LONG_WORD`` bytes are merged by a heap in
the reading step instead, with equal results.

Defined cases: a null text is empty and has no ids; an empty table gives no
rows; null and repeated ids and repeated rows are encoded each on its own; a
text longer than a block is a block of its own.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import durable, let, short_plans, shuffle_partitions, small_batches

LONG_WORD = 256
#: Characters of text in a block, but for a longer single text; words in a row
#: for the fold; codes replaced at a time.
BLOCK, IN_ROW, CODES = 1_000_000, 1024, 50_000
#: Chunks, and bytes of words, after which a task begins its tables anew.
CHUNKS, HELD = 250_000, 8 << 20
#: Bytes of an Arrow batch, of which two workers and the executor hold several.
BATCH = 2 << 20
#: Documents, about, in which usual words are counted, and how many at most are kept.
SAMPLE, USUAL = 32_000, 400_000
#: With this in the pattern, letters alone between spaces are one match, which needs no search.
LETTERS = r"| ?\p{L}+|"

#: New words, or a block: its documents, the chunks and long words new in it,
#: and 32-bit numbers.  ``turn`` counts the tables.
ROW_SCHEMA = ("turn int, words array<array<int>>, ids array<long>, doc_chunks binary, codes binary, chunk_words binary, "
              "words_of_chunk binary, given binary, given_sizes binary")
NUMBERS = ("doc_chunks", "codes", "chunk_words", "words_of_chunk", "given", "given_sizes")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each piece, base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: ranked merges by a heap over linked parts."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and (b := after[a]) < n and (rank := ranks.get(word[a:end[b]])) is not None:
            heapq.heappush(heap, (rank, a, end[b]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, to = heapq.heappop(heap)
        if end[a] < 0 or after[a] >= n or end[after[a]] != to:
            continue  # one of the two has been joined to another part
        b = after[a]
        end[a], after[a], end[b] = to, after[b], -1
        if after[b] < n:
            before[after[b]] = a
        offer(before[a])
        offer(a)
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a:end[a]]])
        a = after[a]
    return out


class _Codes(dict):
    """Parts between spaces -> numbers of chunks."""

    def __init__(self, table: "_Table", lead: str):
        super().__init__()
        self.find, self.chunk, self.one, self.lead = table.find, table.chunk, table.one, lead
        self.letters = LETTERS in table.find.__self__.pattern

    def __missing__(self, part: str) -> int:
        """-1 where white space touches the space beside the part, so that a
        match may reach over it."""
        if self.letters and part.isalpha():
            made = self.one(self.lead + part)
        elif not part or part[0].isspace() or part[-1].isspace():
            made = -1
        else:
            made = self.chunk(self.find(self.lead + part))
        self[part] = made
        return made


class _Matches(dict):
    """Words -> numbers of chunks of one word."""

    def __init__(self, table: "_Table"):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> int:
        made = self[word] = self.table.one(word)
        return made


class _Table:
    """Words and chunks that a task has met, by number, and the block that
    waits to be sent.  Pieces and usual words have the first numbers, then new
    words follow; long words count down from -1."""

    def __init__(self, find, ranks: dict[bytes, int], known: dict[str, int], n_known: int):
        self.find, self.ranks, self.known, self.n_words, self.n_long = find, ranks, known, n_known, 0
        self.first, self.later, self.single = _Codes(self, ""), _Codes(self, " "), _Matches(self)
        self.words: dict[str, int] = {}  # words that are not known -> their numbers
        self.chunks = self.held = 0
        self._open()

    def _open(self) -> None:
        self.size, self.new, self.given = 0, [], []
        self.ids, self.doc_chunks, self.codes = [], [], []
        self.chunk_words, self.words_of_chunk = [], []

    def full(self, most: int) -> bool:
        return self.chunks >= most or self.held >= HELD

    def clear(self) -> None:
        """Its dictionaries refer to the table, so they would outlive it."""
        for held in (self.first, self.later, self.single, self.words):
            held.clear()

    def word(self, text: str) -> int:
        raw = text.encode("utf-8")
        self.held += len(raw)
        if len(raw) > LONG_WORD:
            self.given.append(merge_long(raw, self.ranks))
            self.n_long += 1
            return -self.n_long
        self.new.append(raw)
        self.n_words += 1
        return self.n_words - 1

    def one(self, text: str) -> int:
        """The number of a chunk of one word."""
        if (number := self.known.get(text)) is None and (number := self.words.get(text)) is None:
            number = self.words[text] = self.word(text)  # the table holds other words only
        self.words_of_chunk.append(number)
        self.chunk_words.append(1)
        self.chunks = made = self.chunks + 1
        return made - 1

    def chunk(self, texts: list[str]) -> int:
        known, words, put = self.known, self.words, self.words_of_chunk.append
        for text in texts:
            if (number := known.get(text)) is None and (number := words.get(text)) is None:
                number = words[text] = self.word(text)
            put(number)
        self.chunk_words.append(len(texts))
        self.chunks = made = self.chunks + 1
        return made - 1

    def add(self, doc, text: str) -> None:
        codes = np.zeros(0, np.int32)
        if text:
            head, *parts = text.split(" ")
            codes = np.empty(len(parts) + 1, np.int32)
            codes[0] = self.first[head]
            codes[1:] = np.fromiter(map(self.later.__getitem__, parts), np.int32, len(parts))
            if codes.min() < 0:
                found = self.find(text)
                codes = np.fromiter(map(self.single.__getitem__, found), np.int32, len(found))
        self.ids.append(doc)
        self.doc_chunks.append(len(codes))
        self.codes.append(codes)
        self.size += len(text)

    def rows(self, turn: int) -> Iterator[pa.RecordBatch]:
        """The new words, then the block."""
        def row(**given: pa.Array) -> pa.RecordBatch:
            kinds = {"words": pa.list_(pa.list_(pa.int32())), "ids": pa.list_(pa.int64())}
            names = ("words", "ids", *NUMBERS)
            return pa.RecordBatch.from_arrays(
                [pa.array([turn], pa.int32()), *(given.get(n, pa.nulls(1, kinds.get(n, pa.binary()))) for n in names)],
                ["turn", *names])

        for k in range(0, len(self.new), IN_ROW):
            yield row(words=_spelled(self.new[k:k + IN_ROW]))
        numbers = (self.doc_chunks, np.concatenate(self.codes), self.chunk_words, self.words_of_chunk,
                   [x for ids in self.given for x in ids], list(map(len, self.given)))
        yield row(ids=pa.array([self.ids], pa.list_(pa.int64())),
                  **{n: pa.array([np.asarray(v, np.int32).tobytes()]) for n, v in zip(NUMBERS, numbers)})
        self._open()


def _spelled(words: list[bytes]) -> pa.Array:
    """One row: the words as arrays of bytes."""
    ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
    spelled = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), spelled)


def _merged(column: pa.Array, r: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of one row of merged words, and how many each has."""
    words = column.slice(r, 1).flatten()
    return (np.asarray(words.flatten()).astype(np.int32),  # the entries' low bits
            np.asarray(words.value_lengths()).astype(np.int64))


def _joined(*tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([t[k] for t in tables]) for k in (0, 1))


def _encoded(batches: Iterator[pa.RecordBatch], usual: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(id, ids) of the documents, from the rows of a task in order; ``usual``:
    ids of the words with the first numbers."""
    none = np.zeros(0, np.int32), np.zeros(0, np.int64)
    turn, new = None, []
    for batch in batches:
        for r in range(len(batch)):
            if (now := batch.column("turn")[r].as_py()) != turn:
                turn, words, long, chunks = now, usual, none, none
            if not batch.column("ids")[r].is_valid:
                new.append(_merged(batch.column("merged"), r))
                continue
            doc_chunks, codes, chunk_words, at, given, given_sizes = (
                np.frombuffer(batch.column(n)[r].as_buffer(), np.int32).astype(np.int64) for n in NUMBERS)
            words, new = _joined(words, *new), []
            long = _joined(long, (given.astype(np.int32), given_sizes))
            tokens, lengths = _joined(words, long)
            at[at < 0] = len(words[1]) - 1 - at[at < 0]
            made, taken = _ragged(tokens, lengths, at)
            chunks = _joined(chunks, (made, _sums(taken, chunk_words)))
            # some documents at a time: their ids take more room than their codes
            ids, ends = batch.column("ids").slice(r, 1).flatten(), np.cumsum(doc_chunks)
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(CODES, len(codes), CODES)), len(doc_chunks)]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                made, taken = _ragged(*chunks, codes[ends[a] - doc_chunks[a]:ends[b - 1]])
                stops, raw = (4 * np.cumsum(_sums(taken, doc_chunks[a:b]))).tolist(), made.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([raw[x:y] for x, y in zip([0, *stops], stops)], pa.binary())], ["id", "ids"])


#: A pair without a rank, shifted; the mask of an id; and the entry of a part that has been joined to another.
NONE, ID, GONE = (2**31 - 1) << 32, 2**32 - 1, 2**63 - 1


def rank_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The map from a pair of ids to the rank of both together, as (starts,
    table): the pair (a, b) with a rank stands at ``starts[a] + b`` of the
    table as ``rank << 32 | a``; what stands there for a pair without one ends
    in another id.  Rows of the table, one for each a, lie over each other
    where they leave gaps: the fullest first, each at the first of some random
    starts that fits."""
    top, rows = max(ranks.values()) + 1, {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    size = top + 4 * sum(map(len, rows.values()))
    table, free = np.full(size + top + 1, -1, np.int64), np.ones(size, bool)
    starts = np.full(top + 1, size, np.int64)  # past the end: no pair
    rng = np.random.default_rng(1)
    for a, held in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b, rank = np.array(held, np.int64).T
        while not (fits := free[(tried := rng.integers(0, size - top, 64))[:, None] + b].all(axis=1)).any():
            pass
        starts[a] = tried[fits.argmax()]
        free[starts[a] + b] = False
        table[starts[a] + b] = rank << 32 | a
    return starts, table


def _literal(values, kind: str = "int") -> Column:
    """A literal array: one string that the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def merger(ranks: dict[bytes, int]):
    """The expression that merges words, given as an array of arrays of bytes:
    for each an array of ``rank << 32 | id``, the id of each part and the rank
    of the pair it makes with the next one.  Since an id is a rank, the
    smallest entry tells the pair to join and what it becomes.  Each literal
    array stands once in the plan."""
    starts, table = rank_table(ranks)
    starts, table = _literal(starts), _literal(table, "long")
    byte = [ranks[bytes([x])] for x in range(256)]
    first = _literal((ranks.get(bytes([x, y]), NONE >> 32) << 32 | byte[x] for x in range(256) for y in range(256)), "long")
    of_byte = _literal((NONE | x for x in byte), "long")
    return lambda words: let(starts, lambda s: let(table, lambda t: let(first, lambda f: let(
        of_byte, lambda o: F.transform(words, _fold(s, t, f, o))))))


def _fold(starts: Column, table: Column, first: Column, of_byte: Column):
    """The expression that merges one word by the literal arrays."""
    none = F.lit(NONE)

    def pair(a: Column, b: Column) -> Column:
        """The entry of part a before part b."""
        return let(F.get(table, F.get(starts, a) + b),
                   lambda x: F.when(x.bitwiseAND(F.lit(ID)) == a, x).otherwise(none + a))

    def part(state: Column, i: Column) -> Column:
        return F.get(state, i).bitwiseAND(F.lit(ID)).cast("int")

    def join(state: Column, made: Column, at: Column, before: Column) -> Column:
        """The part before the place ``at`` (from 0) and the one there become
        one.  Most parts stand to the right of both, or to the left of the one
        at ``before``: they pass with the fewest comparisons."""
        after = F.when(at + 1 < F.size(state), pair(made, part(state, at + 1))).otherwise(none + made)
        return F.array_remove(F.transform(state, lambda x, k: F.when(k > at, x).when(k == at, F.lit(GONE)).when(
            k < before, x).when(k == before, pair(part(state, before), made)).otherwise(after)), GONE)

    def step(state: Column) -> Column:
        return let(F.array_min(state), lambda least: F.when(least >= none, state).otherwise(
            let(F.array_position(state, least).cast("int"),
                lambda at: let(at - 2, lambda before: let(
                    F.shiftright(least, 32).cast("int"), lambda made: join(state, made, at, before))))))

    def merged(word: Column) -> Column:
        start = F.transform(word, lambda x, i: F.when(
            i + 1 < F.size(word), F.get(first, x * 256 + F.get(word, i + 1))).otherwise(F.get(of_byte, x)))
        return F.aggregate(F.array_repeat(F.lit(0), F.size(word) - 1), start, lambda s, _: step(s))

    return merged


def _ragged(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` numbered by ``at``, one after another, and their
    lengths."""
    starts = np.cumsum(lengths) - lengths
    taken = lengths[at]
    before = np.cumsum(taken) - taken
    where = np.repeat(starts[at] - before, taken) + np.arange(int(taken.sum()))
    return flat[where], taken


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(lengths)
    return ends[stops] - ends[stops - lengths]


def _usual(texts: DataFrame, pattern: str, ranks, merged, sample: int, most: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """Usual words with their numbers, which follow the pieces' (their ranks);
    ids of the words of all these numbers, and how many each has."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(ranks)  # the vocabulary: fixed in size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        find, ranks, parts = regex.compile(pattern).findall, sent.value, Counter()

        def flush() -> pa.RecordBatch:
            found = Counter()
            for part, n in parts.items():
                for w in find(" " + part):
                    found[w] += n
            raws = {raw: n for w, n in found.items() if len(raw := w.encode("utf-8")) <= LONG_WORD and raw not in ranks}
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(raws), pa.binary()), pa.array(list(raws.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                parts.update((text.as_py() or "").split(" "))
                if len(parts) >= CHUNKS:
                    yield flush()
        yield flush()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for k in range(0, len(words), IN_ROW):
                part = words[k:k + IN_ROW]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.list_(pa.binary())), _spelled(part)], ["raw", "words"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_merged(batch.column("merged"), r) for r in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("raw"), *(pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1))], ["raw", "ids", "sizes"])

    share = min(1.0, sample / max(1, texts.count()))
    counted = durable(texts.sample(share, seed=7).mapInArrow(count, "word binary, n long")
                      .groupBy("word").agg(F.sum("n").alias("n")), "counted")
    held, chosen = 0, None
    for n, n_words in counted.groupBy("n").count().orderBy(F.desc("n")).collect():  # a row for each frequency of the sample
        chosen = F.col("n") >= n
        if held + n_words > most:  # of this frequency, by hash, as many as there is room for (and not the last hundredth)
            room = int(990 * (most - held) / n_words)
            chosen = (F.col("n") > n) | ((F.col("n") == n) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < room))
            break
        held += n_words
    top = max(ranks.values()) + 1
    words, ids, sizes = {}, [np.arange(top, dtype=np.int32)], [np.ones(top, np.int64)]
    if chosen is not None:
        # laid out first, so that the plan with the literal arrays has one stage and is described once
        spelled = durable(counted.where(chosen).select("word").repartition(shuffle_partitions(spark))
                          .mapInArrow(spell, "raw array<binary>, words array<array<int>>"), "spelled")
        rows = (spelled.select("raw", merged(F.col("words")).alias("merged"))
                .mapInArrow(told, "raw array<binary>, ids binary, sizes binary"))
        for raw, made, lengths in rows.collect():  # at most ``most`` words
            words.update((w.decode("utf-8"), top + k) for k, w in enumerate(raw, len(words)))
            ids.append(np.frombuffer(made, np.int32))
            sizes.append(np.frombuffer(lengths, np.int64))
    return words, np.concatenate(ids), np.concatenate(sizes)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False,
           block: int = BLOCK, chunks: int = CHUNKS, sample: int = SAMPLE, usual: int = USUAL) -> DataFrame:
    """(id, ids) of every row: ids are little-endian unsigned 32-bit integers.
    With ``decoded`` also what ``decode`` adds, by the same task."""
    spark, ranks = docs.sparkSession, read_ranks(path)
    small_batches(spark, BATCH)
    short_plans(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    merged = merger(ranks)
    known, ids, sizes = _usual(rows.select("text"), pattern, ranks, merged, sample, usual)
    # the vocabulary and at most ``usual`` words of at most LONG_WORD bytes
    for piece, rank in ranks.items():
        if (word := piece.decode("utf-8", "ignore")).encode("utf-8") == piece:
            known[word] = rank
    sent, told = spark.sparkContext.broadcast((ranks, known)), spark.sparkContext.broadcast((ids, sizes, _pieces(ranks)))
    n_known = len(sizes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        find = regex.compile(pattern).findall
        turn, now = 0, _Table(find, *sent.value, n_known)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                now.add(doc, text.as_py() or "")
                if now.size >= block:
                    yield from now.rows(turn)
                    if now.full(chunks):
                        now.clear()
                        turn, now = turn + 1, _Table(find, *sent.value, n_known)
        if now.ids:
            yield from now.rows(turn)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, pieces = told.value
        made = _encoded(batches, (ids, sizes))
        return _decoded(made, pieces) if decoded else made

    return (rows.mapInArrow(read, ROW_SCHEMA).withColumn("merged", merged(F.col("words"))).drop("words")
            .mapInArrow(write, "id long, ids binary, raw binary" if decoded else "id long, ids binary"))


def _pieces(ranks: dict[bytes, int]) -> np.ndarray:
    pieces = np.full(max(ranks.values()) + 1, b"", object)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def _decoded(batches: Iterator[pa.RecordBatch], pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches (id, ids) with the bytes that the ids stand for."""
    for batch in batches:
        made = [b"".join(pieces[np.frombuffer(x.as_py() or b"", "<u4")].tolist()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "ids", "raw"])


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, raw): the bytes that the ids stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(_pieces(read_ranks(path)))
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(
        lambda batches: _decoded(batches, sent.value), "id long, ids binary, raw binary")
