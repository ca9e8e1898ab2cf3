"""Fuzzy line dedup by MinHash.

A line's shingles are the runs of ``SHINGLE`` characters of its words joined
by single spaces (a shorter line is one shingle).  Signatures have
``BANDS * ROWS`` values; lines that agree on all values of a band share a
bucket.  Lines that share a bucket are linked if the exact Jaccard similarity
of their shingle sets is ``SIMILARITY`` or more.  Linked lines form
components (distributed union-find), each of which keeps its first line by
(id, text hash, line number).

Equal lines are one line throughout.  Long lines get one-permutation
signatures (one hash per shingle, empty values filled from others), short
ones classic signatures, lines of a middling length both.  Length here is the
number of distinct shingles, as in the similarity: sets of similarity 0.8 have
sizes in that ratio or closer, so any two similar lines share a kind, repeated
shingles or not.

Band entries travel as packed blocks (4 bytes of key and 8 of line each), one
block for each task and part of the key space.  Only lines in a bucket with
another line are looked at again.  Their texts are fetched by a scan with a
Bloom filter of fixed size, which only spares work.  First each line is
verified against the centre of its buckets; then, in further rounds, only
lines of different components that share a bucket.  So a bucket of thousands
of copies costs about one comparison for each, not all pairs.  What is left
is dealt by bucket into blocks of ``BLOCK`` lines; every two blocks of a bucket
meet in a task, which counts common shingles through an index of them and
gives a star for each component, so no pair is ever a row.

Defined cases: null texts have no lines; lines without a word are kept and
in no component; a null id comes first; rows with equal id and text are
treated alike; a 64-bit hash stands for a line's text.  Extra columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import WORD, durable, let, shuffle_partitions, small_batches
from revlens.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 18, 6
#: Distinct shingles up to which a line gets a classic signature, and from
#: which a one-permutation signature.
SHORT, LONG = 80, 64
#: Characters of lines, and band entries, that a task handles at a time, and
#: the lines it remembers as met.
RUN_CHARS, RUN_ENTRIES, SEEN = 1 << 18, 1 << 19, 1 << 18
#: Parts of the key space for each shuffle partition: a part is sorted at a time.
PARTS = 8
BLOOM_BITS = 1 << 26
STAR_ROUNDS = 3
#: Lines of a bucket that meet at a time, in the last step.
BLOCK = 512
#: Lines in the bucket of a line, on average, up to which buckets meet whole;
#: and entries of a table of lines by shingles.
FEW, DENSE = 1024, 1 << 21
#: How far counts of hashed shingles may be from a similarity that is checked by the shingles themselves.
UNSURE = 4
EMPTY = np.uint32(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes the bits in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def line_id(line: bytes) -> int:
    """The signed hash that stands for a line (its words, single-spaced)."""
    h = xxhash.xxh64_intdigest(line, 42)
    return h - 2**64 if h >= 2**63 else h


def lines_of(text: bytes) -> list[bytes]:
    """Every line's words joined by single spaces."""
    return [b" ".join(x.split()) for x in text.split(b"\n")]


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """The factors and summands of the classic signatures' hash functions."""
    rng = np.random.default_rng(5)
    made = np.array([rng.integers(1, 2**63, 2) for _ in range(BANDS * ROWS)]).astype(np.uint64)
    return made[:, :1] | np.uint64(1), made[:, 1:]


FACTORS, SUMMANDS = _functions()


def _classic(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((BANDS * ROWS, len(starts)), np.uint32)
    for k in range(0, BANDS * ROWS, ROWS):  # some functions at a time
        made = FACTORS[k:k + ROWS] * hashes
        made += SUMMANDS[k:k + ROWS]
        made >>= np.uint64(32)
        out[k:k + ROWS] = np.minimum.reduceat(made, starts, axis=1)
    return out.T


def _one_permutation(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures, and how many values of each were filled by hashes."""
    k, n = BANDS * ROWS, len(starts)
    sizes = np.diff(np.append(starts, len(hashes)))
    place = hashes >> np.uint64(32)
    place *= np.uint64(k)
    place >>= np.uint64(32)
    place = place.view(np.int64)
    place += np.repeat(np.arange(n) * k, sizes)
    out = np.full(n * k, EMPTY, np.uint32)
    np.minimum.at(out, place, hashes.astype(np.uint32))  # the low bits
    out = out.reshape(n, k)
    given = out != EMPTY
    row, col = np.nonzero(~given)
    rng = np.random.default_rng(6)
    while len(row):  # an empty value takes that of a random filled one
        donor = rng.integers(0, k, k)[col]
        has = given[row, donor]
        out[row[has], col[has]] = out[row[has], donor[has]]
        row, col = row[~has], col[~has]
    return out, given.sum(axis=1)


def _new(values: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values differs from the one before."""
    return np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many distinct hashes each line has."""
    room = np.uint64(len(counts).bit_length())
    packed = np.sort((np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << (np.uint64(64) - room)) | (hashes >> room))
    line = (packed[_new(packed)] >> (np.uint64(64) - room)).astype(np.int64)
    return np.bincount(line, minlength=len(counts))


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' shingles, hashed, line after line with repeats, and how many
    each line has."""
    lengths = np.array([len(x) for x in lines])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.maximum(1, lengths - SHINGLE + 1)
    # short lines are filled up, so that every shingle has SHINGLE characters
    padded = np.maximum(lengths, SHINGLE)
    ends = np.cumsum(padded)
    if (padded != lengths).any():
        wide = np.zeros(int(ends[-1]), np.uint64)
        wide[np.arange(len(points)) + np.repeat(ends - padded - (np.cumsum(lengths) - lengths), lengths)] = points + np.uint64(1)
        points = wide
    else:
        points += np.uint64(1)
    h = points[:max(0, len(points) - SHINGLE + 1)].copy()
    for j in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[j:j + len(h)]
    inside = np.ones(len(h), bool)
    for j in range(1, SHINGLE):  # shingles that reach into the next line
        inside[ends[:-1] - j] = False
    return _mix(h[inside]), counts


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``lines``, band key) of every band of every line."""
    h, counts = _hashes(lines)
    short, signed = counts < LONG, []
    if not short.all():
        rows = np.flatnonzero(~short)
        mine, sizes = h[np.repeat(~short, counts)], counts[rows]
        values, filled = _one_permutation(mine, np.cumsum(sizes) - sizes)
        # a line has as many distinct shingles as filled values, or more: only few need a count
        if (few := filled <= SHORT).any():
            distinct = _distinct(mine[np.repeat(few, sizes)], sizes[few])
            short[rows[few]] = distinct <= SHORT
            long = ~few
            long[few] = distinct >= LONG
            rows, values = rows[long], values[long]
        signed.append((1, rows, values))
    if short.any():
        rows = np.flatnonzero(short)
        sizes = counts[rows]
        signed.append((0, rows, _classic(h[np.repeat(short, counts)], np.cumsum(sizes) - sizes)))
    at, keys = [], []
    for kind, rows, values in signed:
        values = values.T.reshape(BANDS, ROWS, len(rows)).astype(np.uint64)
        key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(kind * BANDS + 1), len(rows), axis=1)
        for r in range(ROWS):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += values[:, r]
            _mix(key)
        at.append(np.tile(rows, BANDS))
        keys.append(key.ravel())
    return np.concatenate(at), np.concatenate(keys)


def _bands(parts: int):
    """Packed band entries: rows (part, keys and line ids)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            keys.clear()
            ids.clear()
            part = (k >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            k, i, part = k[order].astype("<u4"), i[order].astype("<i8"), part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            stops = np.append(cuts[1:], len(part))
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cuts].astype(np.int32)),
                 pa.array([k[a:b].tobytes() + i[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary())], ["part", "block"])

        def take(found: dict[bytes, int]) -> None:
            at, made = band_keys([x.decode("utf-8", "replace") for x in found])
            keys.append(made)
            ids.append(np.fromiter(found.values(), np.int64, len(found))[at])

        seen: set[int] = set()  # lines of this task so far, as far as they are held
        run: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            for text in batch.column(0):
                for line in lines_of(text.as_py() or b""):
                    if line and (name := line_id(line)) not in seen:
                        seen.add(name)
                        run[line] = name
                        size += len(line)
                if size >= RUN_CHARS:
                    take(run)
                    run, size = {}, 0
                    if len(seen) > SEEN:
                        seen.clear()
                    if sum(map(len, keys)) >= RUN_ENTRIES:
                        yield flush()
        if run:
            take(run)
        if keys:
            yield flush()
    return of


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads band entries sorted by part; gives (bucket, id, centre) of every
    line in a bucket of two or more, the centre being its smallest line."""
    open_part, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        sizes = [len(b) // 12 for b in held]
        keys = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(held, sizes)])
        ids = np.concatenate([np.frombuffer(b, "<i8", n, 4 * n) for b, n in zip(held, sizes)])
        # most keys have one line: only the others are sorted by line
        packed = np.sort((keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64))
        first = _new(packed >> np.uint64(32))
        order = packed[~(first & np.append(first[1:], True))] & np.uint64(0xFFFFFFFF)
        keys, ids = keys[order], ids[order]
        if not len(keys):
            return
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[new], ids[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        full = np.repeat(counts > 1, counts)
        centre = np.repeat(ids[starts], counts)[full]
        bucket = (np.int64(open_part) << np.int64(32)) | keys[full].astype(np.int64)
        for k in range(0, len(centre), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[k:k + (1 << 17)]) for x in (bucket, ids[full], centre)],
                                             ["bucket", "id", "centre"])

    for batch in batches:
        for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != open_part:
                if held:
                    yield from close()
                open_part, held = part, []
            held.append(block)
    if held:
        yield from close()


def _bloom(ids: DataFrame):
    """A bit string of BLOOM_BITS bits with a bit for each id: fixed in size."""
    at = F.pmod("id", F.lit(BLOOM_BITS))
    words = ids.groupBy(F.shiftright(at, 5).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(id, {BLOOM_BITS}) & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(out)


def _texts(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the lines in ``ids``."""
    filled = _bloom(ids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = filled.value, set()
        for batch in batches:
            found = {}
            for text in batch.column(0):
                for line in lines_of(text.as_py() or b""):
                    if line and (name := line_id(line)) not in seen:
                        seen.add(name)
                        at = name % BLOOM_BITS
                        if int(bits[at >> 5]) >> (at & 31) & 1:
                            found[name] = line
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())],
                                             ["id", "line"])

    return raw.mapInArrow(of, "id long, line binary").dropDuplicates(["id"])


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _alike(xs: list[str], ys: list[str], similarity: float) -> np.ndarray:
    """Whether each x is similar to its y: by hashed shingles in common, and by
    the shingles themselves where a few more or less would change the answer."""
    n = len(xs)
    if not n:
        return np.zeros(0, bool)
    h, counts = _hashes(xs + ys)
    # pair, hash and side, sorted: a shingle of both sides has both next to each other
    room = np.uint64(n.bit_length())
    h >>= room
    h &= ~np.uint64(1)
    h |= np.repeat(np.arange(2 * n, dtype=np.uint64) % np.uint64(n), counts) << (np.uint64(64) - room)
    h[int(counts[:n].sum()):] |= np.uint64(1)
    h.sort()
    h = h[_new(h)]
    pair, common = (h >> (np.uint64(64) - room)).astype(np.int64), (h[1:] ^ h[:-1]) == 1
    total = np.bincount(pair, minlength=n)
    both = np.bincount(pair[1:][common], minlength=n)
    over = both - similarity * (total - both)
    near = over >= 0
    for k in np.flatnonzero(np.abs(over) <= UNSURE).tolist():
        x, y = shingles(xs[k]), shingles(ys[k])
        near[k] = len(x & y) >= similarity * len(x | y)
    return near


def _verify(similarity: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = ([x.decode("utf-8", "replace") for x in batch.column(k).to_pylist()] for k in (2, 3))
            ends = np.cumsum([len(x) + len(y) for x, y in zip(xs, ys)])
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(RUN_CHARS, ends[-1] if len(ends) else 0, RUN_CHARS)),
                                   len(xs)]).tolist()
            near = np.concatenate([np.zeros(0, bool), *(_alike(xs[a:b], ys[a:b], similarity) for a, b in zip(cuts, cuts[1:]))])
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])
    return of


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar."""
    rows = (pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y"))
    return durable(rows.mapInArrow(_verify(similarity), "a long, b long"), "linked")


def _meet(groups: list[list[tuple]], similarity: float) -> Iterator[tuple[int, int]]:
    """Links (id, id) that join the components of each group's lines, or of
    its two sides (0 and 1), as far as these pairs do.  A group is a block of
    lines, or two blocks."""
    pairs = [rows for rows in groups if len(rows) == 2]
    if pairs:
        xs, ys = ([rows[k][3].decode("utf-8", "replace") for rows in pairs] for k in (0, 1))
        for k in np.flatnonzero(_alike(xs, ys, similarity)).tolist():
            yield pairs[k][0][1], pairs[k][1][1]
    groups = [rows for rows in groups if len(rows) > 2]
    if not groups:
        return
    sides, ids, names, lines = zip(*(r for rows in groups for r in rows))
    lines = [x.decode("utf-8", "replace") for x in lines]
    h, counts = _hashes(lines)
    ends = np.cumsum([len(rows) for rows in groups])
    of_group = np.repeat(np.arange(len(groups)), [len(rows) for rows in groups])
    # an index: each shingle's lines in a group, one after the other
    above, below = (np.uint64(n.bit_length()) for n in (len(groups), max(map(len, groups))))
    first = ends - np.bincount(of_group)
    h >>= above + below
    h <<= below
    h |= np.repeat((of_group.astype(np.uint64) << (np.uint64(64) - above))
                   | (np.arange(len(lines)) - first[of_group]).astype(np.uint64), counts)
    h.sort()
    h = h[_new(h)]
    group = (h >> (np.uint64(64) - above)).astype(np.int64)
    owner = first[group] + (h & ((np.uint64(1) << below) - np.uint64(1))).astype(np.int64)
    size = np.bincount(owner, minlength=len(lines))
    starts = np.flatnonzero(_new(h >> below))
    lengths = np.diff(np.append(starts, len(h)))
    shared = lengths > 1  # a shingle of one line is in no pair
    spots, lengths = owner[np.repeat(shared, lengths)], lengths[shared]
    term = np.repeat(np.arange(len(lengths)), lengths)
    side, label = np.array(sides), np.unique(np.array(names), return_inverse=True)[1]
    bounds = np.searchsorted(of_group[spots], np.arange(len(groups) + 1))
    for k, end in enumerate(ends.tolist()):
        first, two = end - len(groups[k]), len({r[0] for r in groups[k]}) == 2
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            mine, at = label[first:end], side[first:end]
            for i, j, over in _near(spots[a:b] - first, term[a:b] - term[a], size[first:end], mine, at if two else None, similarity):
                if mine[j] != mine[i]:  # not joined by an earlier one
                    if over <= UNSURE:
                        x, y = shingles(lines[first + i]), shingles(lines[first + j])
                        if len(x & y) < similarity * len(x | y):
                            continue
                    mine[mine == mine[j]] = mine[i]
                    yield ids[first + i], ids[first + j]


def _near(spots: np.ndarray, term: np.ndarray, size: np.ndarray, label: np.ndarray, side: np.ndarray | None,
          similarity: float) -> Iterator[tuple[int, int, float]]:
    """Pairs (i, j) of lines with different labels, of side 0 and side 1 if
    there are sides, that are similar by the shingles they share, and how many
    more these are than they must be: ``term`` k is in line ``spots`` k."""
    n, width = len(size), int(term[-1]) + 1

    def chosen(both: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        over = both - similarity * (size + size[i][:, None] - both)
        near = (over >= 0) & (label != label[i][:, None])
        near &= (side == 1) if side is not None else (np.arange(n) > i[:, None])
        at, j = np.nonzero(near)
        return i[at], j, over[at, j]

    rows = np.arange(n) if side is None else np.flatnonzero(side == 0)
    if n * width <= DENSE:
        held = np.zeros((n, width), np.float32)
        held[spots, term] = 1
        yield from zip(*(x.tolist() for x in chosen((held[rows] @ held.T).astype(np.int64), rows)))
        return
    starts = np.searchsorted(term, np.arange(width + 1))
    by_line = np.argsort(spots, kind="stable")
    bounds = np.searchsorted(spots[by_line], np.arange(n + 1))
    for i in rows.tolist():
        both = np.zeros(n, np.int64)
        mine = term[by_line[bounds[i]:bounds[i + 1]]].tolist()
        for k in range(0, len(mine), 1024):
            both += np.bincount(np.concatenate([spots[starts[t]:starts[t + 1]] for t in mine[k:k + 1024]]), minlength=n)
        yield from zip(*(x.tolist() for x in chosen(both[None], np.array([i]))))


def _blocks(similarity: float):
    """Reads rows (bucket, low, high, side, id, component, line) sorted by
    bucket and blocks."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, groups, size = None, [], [], 0

        def close(last: bool = False) -> list[tuple[int, int]]:
            """The group ends; groups meet when they are enough."""
            nonlocal held, size
            if len({r[2] for r in held}) > 1:
                groups.append(held)
                size += sum(len(r[3]) for r in held)
            held, made = [], []
            if groups and (last or size >= RUN_CHARS):
                made = list(_meet(groups, similarity))
                groups.clear()
                size = 0
            return made

        def given(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            out = []
            for *key, side, name, component, line in zip(*(c.to_pylist() for c in batch.columns)):
                if key != open_key:
                    out += close()
                    open_key = key
                held.append((side, name, component, line))
            yield given(out)
        yield given(close(last=True))
    return of


def _across(left: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between lines of different components that share a
    bucket; ``left``: rows (bucket, id, component, n), n lines a bucket."""
    # each line of a large bucket meets every block, its own included
    dealt = left.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.join(texts, "id").select(
        "bucket", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), "id", "component", "line")
    order = ["bucket", "low", "high"]
    met = dealt.repartition(shuffle_partitions(left.sparkSession), *order).sortWithinPartitions(*order)
    return durable(met.mapInArrow(_blocks(similarity), "a long, b long"), "across")


def line_components(raw: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component): lines linked to another, with the smallest line of
    their component.  ``raw``: one binary column of texts."""
    small_batches(raw.sparkSession)
    n = shuffle_partitions(raw.sparkSession)
    members = durable(raw.mapInArrow(_bands(PARTS * n), "part int, block binary").repartition(n, "part")
                      .sortWithinPartitions("part").mapInArrow(_members, "bucket long, id long, centre long"), "members")
    texts = durable(_texts(raw, members.select("id")), "texts")
    stars = members.where("id <> centre")
    found = None
    for turn in range(STAR_ROUNDS + 1):
        # the centre that a line shares the most buckets with
        shared = stars.groupBy("id", "centre").count()
        best = shared.groupBy("id").agg(F.max_by("centre", F.struct("count", "centre")).alias("centre"))
        new = _linked(best.toDF("a", "b"), texts, similarity)
        found = components(new if found is None else new.union(found))
        named = members.select("bucket", "id").join(found.toDF("id", "component"), "id", "left").withColumn(
            "component", F.coalesce("component", "id"))
        named = durable(named, "named")
        mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                            F.count("*").alias("n")).where("low < high")
        left = durable(named.join(mixed, "bucket"), "mixed")
        size, pairs = left.agg(F.count("*"), F.sum("n")).first()
        if not size:
            return found
        if pairs <= FEW * size or turn == STAR_ROUNDS:
            break
        order = F.xxhash64("id", F.lit(turn))
        centres = left.groupBy("bucket").agg(F.min_by(F.struct("id", "component"), order).alias("c"))
        stars = left.join(centres, "bucket").where(F.col("component") != F.col("c.component")).select(
            "id", F.col("c.id").alias("centre"))
    return components(_across(left.select("bucket", "id", "component", "n"), texts, similarity).union(found))


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks, texts = (batch.column(k) for k in range(3))
        made = [lines_of(t.as_py()) for t in texts]
        take = pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made]), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(take), marks.take(take), pa.array([k for x in made for k in range(len(x))], pa.int64()),
             pa.array([line_id(y) if y else None for x in made for y in x], pa.int64())], ["id", "mark", "line_no", "line"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, mark, line_no, component_id, kept) of every line; ``mark`` is the
    text's XXH64, a component's id its smallest line hash."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text")).where(
        "text is not null")
    found = line_components(rows.select("text"), similarity)
    lines = durable(rows.select("id", F.xxhash64("text").alias("mark"), "text").mapInArrow(
        _line_rows, "id long, mark long, line_no long, line long"), "lines")
    named = lines.join(found.toDF("line", "component_id"), "line", "left").withColumn(
        "component_id", F.coalesce("component_id", "line"))
    named = durable(named.drop("line"), "named")
    spot = F.struct("id", "mark", "line_no")
    first = named.where("component_id is not null").groupBy("component_id").agg(F.min(spot).alias("first"))
    return named.join(first, "component_id", "left").select(
        "id", "mark", "line_no", "component_id", F.coalesce(spot.eqNullSafe(F.col("first")) | F.col("component_id").isNull(),
                                                            F.lit(True)).alias("kept"))


def clean(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that are not kept.  A document all of whose
    words stand in lines kept elsewhere is dropped."""
    gone = near_duplicates(docs, similarity, id_col, text_col).where("not kept").groupBy("id", "mark").agg(
        F.collect_set("line_no").alias("gone"))
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs[id_col].cast("long").alias("id"),
                       F.xxhash64(docs[text_col].cast("binary")).alias("mark"))
    joined = rows.join(gone.withColumnRenamed("id", "gone_id").withColumnRenamed("mark", "gone_mark"),
                       F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    left = let(F.split(F.col("row")[text_col], "\n"), lambda x: F.transform(
        F.array_except(F.sequence(F.lit(0).cast("long"), F.size(x).cast("long") - 1), F.col("gone")),
        lambda i: F.get(x, i.cast("int"))))
    joined = joined.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_join(left, "\n")))
    kept = joined.where(F.col("gone").isNull() | F.col("left").rlike(WORD))
    return kept.select(*(F.when(F.col("gone").isNotNull(), F.col("left")).otherwise(F.col("row")[c]).alias(c)
                         if c == text_col else F.col("row")[c].alias(c) for c in names))
