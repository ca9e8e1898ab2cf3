"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1/-1.  A letter n-gram is bound from
its letters' vectors, each rotated by its place, multiplied together; a
text's profile is the sum of its n-grams' vectors; a language's prototype is
the sum over its training texts.  A document gets the language whose
prototype has the highest cosine with its profile.

N-grams are counted first, so each distinct one is bound once for a run of
documents and the sums are matrix products.  Training sums are integers, so
they do not depend on the order of rows; only one vector per language leaves
the executors, and ``max_languages`` bounds their number.

Defined cases: a null text or one without a letter is ``und`` with score 0,
and so is every text if nothing was learned; case is ignored; other
characters separate words; equal cosines go to the first language by name; a
null id is not held out.  Extra columns are ignored.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
SEED = 7
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: Documents and characters to a matrix product, and n-grams to a part of it.
RUN_DOCS, RUN_CHARS, RUN_GRAMS = 256, 1 << 22, 4096
SPACE = 32


def _process() -> dict:
    """Letter tables kept for a worker process."""
    held = sys.modules.setdefault("_revlens_llm_letters", types.ModuleType("_revlens_llm_letters")).__dict__
    if "is_letter" not in held:
        held["is_letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        held["vectors"] = {}
    return held


def _letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    known = _process()["vectors"]
    for c in letters.tolist():
        if (c, dimensions) not in known:
            bits = np.random.default_rng([SEED, c]).integers(0, 2, dimensions, dtype=np.int8)
            known[c, dimensions] = (bits * 2 - 1).astype(np.float32)
    return np.stack([known[c, dimensions] for c in letters.tolist()])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; every run of other characters
    is one space, and the text has one at each end.  Empty without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_process()["is_letter"][points], points, SPACE)
    points = points[np.concatenate([[True], (points[1:] != SPACE) | (points[:-1] != SPACE)])]
    return points if len(points) > 2 else points[:0]


def profiles(docs: list[np.ndarray], groups: np.ndarray, n_groups: int, dimensions: int) -> np.ndarray:
    """Sums of n-gram vectors of documents (``letters`` of each), by group."""
    out = np.zeros((n_groups, dimensions), np.float32)
    points = np.concatenate([*docs, np.zeros(0, np.uint32)])
    if len(points) < GRAM:
        return out
    alphabet = np.flatnonzero(np.bincount(points))
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    symbols, size = place[points], len(alphabet)
    grams = symbols[:-2] * size * size + symbols[1:-1] * size + symbols[2:]
    lengths = np.array([len(d) for d in docs])
    owner = np.repeat(groups, lengths)[:-2]
    whole = np.ones(len(grams), dtype=bool)  # n-grams within one document
    ends = np.cumsum(lengths)
    for back in (1, 2):
        at = ends - back
        whole[at[(at >= 0) & (at < len(grams))]] = False
    grams, owner = grams[whole], owner[whole]
    if size ** GRAM <= 1 << 24:
        distinct = np.flatnonzero(np.bincount(grams, minlength=1))
        index = np.zeros(int(distinct[-1]) + 1 if len(distinct) else 1, np.int64)
        index[distinct] = np.arange(len(distinct))
        index = index[grams]
    else:
        distinct, index = np.unique(grams, return_inverse=True)
    vectors = _letter_vectors(alphabet, dimensions)
    turned = [np.roll(vectors, GRAM - 1 - k, axis=1) for k in range(GRAM)]
    for lo in range(0, len(distinct), RUN_GRAMS):
        part = distinct[lo:lo + RUN_GRAMS]
        bound = turned[0][part // (size * size)] * turned[1][part // size % size] * turned[2][part % size]
        mine = (index >= lo) & (index < lo + len(part)) if len(distinct) > RUN_GRAMS else slice(None)
        counts = np.bincount(owner[mine] * len(part) + (index[mine] - lo), minlength=n_groups * len(part))
        out += counts.reshape(n_groups, len(part)).astype(np.float32) @ bound
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows, a bounded number of documents and characters at a time."""
    run, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
            text = row[-1].as_py() or ""
            run.append((*(x.as_py() for x in row[:-1]), letters(text)))
            size += len(text)
            if len(run) >= RUN_DOCS or size >= RUN_CHARS:
                yield run
                run, size = [], 0
    if run:
        yield run


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS,
          max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """The prototype of each non-null language."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))],
                ["lang", "profile"])
            total.clear()
            return made

        for run in _runs(batches):
            names = sorted({lang for lang, _ in run})
            groups = np.array([names.index(lang) for lang, _ in run], np.int64)
            made = profiles([x for _, x in run], groups, len(names), dimensions)
            for name, profile in zip(names, np.rint(made).astype(np.int64)):
                total[name] = total[name] + profile if name in total else profile
            if len(total) > max_languages:
                yield given()
        yield given()

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    parts = rows.where("lang is not null and text is not null").mapInArrow(sums, "lang string, profile array<long>")
    each = (parts.select("lang", F.posexplode("profile").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("profile")))  # `dimensions` rows each
    found = each.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    made = {r["lang"]: np.array([x["x"] for x in r["profile"]], np.float64) for r in found}
    return {k: made[k] for k in sorted(made) if made[k].any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the score is the cosine, not
    under 0."""
    names = list(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    table = np.stack([v / np.linalg.norm(v) for v in prototypes.values()]) if names else None
    sent = docs.sparkSession.sparkContext.broadcast((names, table))  # a vector for each of the languages

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for run in _runs(batches):
            langs, scores = [UNKNOWN] * len(run), np.zeros(len(run))
            if names:
                made = profiles([x for _, x in run], np.arange(len(run)), len(run), dimensions).astype(np.float64)
                norms = np.linalg.norm(made, axis=1)
                cosines = made @ table.T / np.maximum(norms, 1e-300)[:, None]
                best = cosines.argmax(1)
                for i, (_, x) in enumerate(run):
                    if len(x):
                        langs[i], scores[i] = names[best[i]], min(1.0, max(0.0, cosines[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in run], pa.int64()), pa.array(langs), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, lang_pred string, score double")


def held_out(id_col):
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learned from the rows
    that are not held out."""
    learned = learn(docs.where(~held_out(docs[id_col])), lang_col, text_col, dimensions)
    return predict(docs, learned, id_col, text_col).withColumn("held_out", held_out(F.col("id")))
