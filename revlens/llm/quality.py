"""Quality rules with a hashed n-gram likelihood ratio (DataFrame functions only).

Two multinomials over ``buckets`` hashed word 1- and 2-grams: the raw corpus,
counted over all documents, and the trusted target, counted over documents
labelled good and not toxic.  By hash of their ids, one half of them makes the
model and the other half the threshold; all of them take part.  Their ids are
broadcast, or, from ``BROADCAST_IDS`` on, joined once by a shuffle that the
trusted documents are written from.  A document's score is the mean over its n-grams of
``ln p_target - ln p_raw``.  The raw model is add-one smoothed and the target
is smoothed towards it, by ``buckets`` counts spread as the raw model's: an
n-gram of which the target tells nothing adds nothing, whatever the sizes of
the two.  A document passes if its score is at least the threshold: the
``trusted_share`` quantile of the scores of trusted documents that the model
has not seen, so it stands where other clean documents' scores begin, and moves
with the model.  A tie with it passes.  Base rules look at length and
repetition.

The two models are ``buckets`` numbers each, whatever the corpus: they and
``NTH_ROWS`` scores at most, among which the threshold is, are all that is
collected.

Defined cases: a null text has no words (and fails the base rule); documents
without n-grams score 0; labels with null or repeated ids count once; without
any target document every score is 0 and only the base rules judge; an empty
table gives no rows.  A very long text is read whole, in one row.  Repeated
rows and null ids are judged each on its own.  Extra columns are ignored, or
kept with ``keep_columns``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import WORD, durable, let, words

BUCKETS = 10_000
#: Trusted ids up to which they are broadcast (a half at a time).
BROADCAST_IDS = 6_000_000
#: Scores up to which the threshold is looked up on the driver.
NTH_ROWS = 100_000
#: Share of the trusted documents (that pass the base rules) below the threshold.
TRUSTED_SHARE = 0.002
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _but_one(values: Column) -> Column:
    return F.greatest(F.size(values) - 1, F.lit(0))


def _joined(left: Column, right: Column) -> Column:
    """A hash of each of ``left``, but the last, with the one at its place in ``right``."""
    return F.zip_with(F.slice(left, 1, _but_one(left)), right, lambda x, y: F.xxhash64(x, y))


def _ordered() -> Column:
    """The 3-word windows, one 64-bit hash each, with their places, in order
    of hash; none if all differ."""
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))


def _places() -> Column:
    """Places of the windows that occur twice or more."""
    count = _but_one(F.col("ordered"))
    twice = F.zip_with(F.slice("ordered", 1, count), F.slice("ordered", 2, count),
                       lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(twice))))


def _repeated_words() -> Column:
    """Words covered by these windows: three, or those before the next window."""
    # `least` passes over the null after the last
    reach = F.zip_with("places", F.slice("places", 2, _but_one(F.col("places"))), lambda x, y: F.least(y - x, F.lit(3)))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)


def trusted(labels: DataFrame) -> DataFrame:
    """(id, model) of the trusted documents: model is 1 for the half that the
    target model counts, else null."""
    return (labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
            .select(F.col("doc_id").alias("id")).distinct()
            .withColumn("model", F.when(F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0, 1)))


def _split(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(raw, model, text) that the models count: raw is 1 for every document,
    model for those of the target; and (text) of the threshold's half."""
    texts, ids = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), trusted(labels)
    model, rest = ids.where("model = 1"), ids.where("model is null").select("id")
    if ids.count() <= BROADCAST_IDS:
        counted = texts.join(F.broadcast(model), "id", "left").select(F.lit(1).alias("raw"), "model", "text")
        return counted, texts.join(F.broadcast(rest), "id", "left_semi").select("text")
    own = durable(texts.join(ids, "id").select("model", "text"), "trusted")
    none = F.lit(None).cast("int")
    counted = texts.select(F.lit(1).alias("raw"), none.alias("model"), "text").union(
        own.where("model = 1").select(none.alias("raw"), "model", "text"))
    return counted, own.where("model is null").select("text")


def fit(counted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """ln p_target - ln p_raw of each bucket, from (raw, model, text)."""
    # a row for each word and its next one: their hashes are made by generated code, not in a lambda
    after = F.slice("words", 2, _but_one(F.col("words")))
    pairs = (counted.select("raw", "model", words(F.col("text")).alias("words"))
             .select("raw", "model", F.explode(F.arrays_zip(F.col("words").alias("word"), after.alias("next"))).alias("at")))
    first, then = F.xxhash64("at.word"), F.when(F.col("at.next").isNotNull(), F.xxhash64("at.next"))
    grams = pairs.select("raw", "model", F.explode(F.array(first, F.when(then.isNotNull(), F.xxhash64(first, then)))).alias("gram"))
    counts = (grams.where("gram is not null").groupBy(_bucket(F.col("gram"), buckets).alias("bucket"))
              .agg(F.count("raw").alias("raw"), F.count("model").alias("target")))
    found = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}  # `buckets` rows at most
    raw, target = (sum(x[k] for x in found.values()) for k in (0, 1))
    ratios = []
    for b in range(buckets):
        seen, wanted = found.get(b, (0, 0))
        p_raw = (seen + 1) / (raw + buckets)
        ratios.append(math.log((wanted + buckets * p_raw) / (target + buckets)) - math.log(p_raw))
    return ratios


def _scored(rows: DataFrame, ratios: list[float], buckets: int) -> DataFrame:
    """``rows`` (with a column ``text``) with counts, score and base_failed."""
    # one literal, folded into an array by the optimizer
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")

    def of(h: Column) -> Column:
        return F.get(table, _bucket(h, buckets))

    # the last word begins no pair
    each = F.zip_with("hashes", "pairs", lambda x, y: of(x) + F.coalesce(of(y), F.lit(0.0)))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    score = F.when(F.size("hashes") > 0, total / F.greatest(F.size("hashes") * 2 - 1, F.lit(1))).otherwise(0.0)

    solid = F.concat_ws("", F.col("words"))
    plain = solid
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD))
    # a column for each step, as steps within a lambda are not compiled; the explode of one row
    # keeps filters above it, which would else repeat the steps
    return (rows.withColumn("words", words(F.col("text")))
            .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
            .withColumn("pairs", _joined(F.col("hashes"), F.slice("hashes", 2, _but_one(F.col("hashes")))))
            .withColumn("windows", _joined(F.col("pairs"), F.slice("hashes", 3, _but_one(F.col("pairs")))))
            .withColumn("ordered", _ordered()).withColumn("places", _places())
            .withColumn("of_words", F.explode(F.array(F.struct(
                F.size("words").cast("long").alias("n"), _repeated_words().alias("repeats"), score.alias("score")))))
            .withColumns({
                "n_words": F.col("of_words.n"),
                "word_chars": F.char_length(solid).cast("long"),
                "n_symbols": (F.char_length(solid) - F.char_length(plain)).cast("long"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_repeat_words": F.col("of_words.repeats"), "score": F.col("of_words.score")})
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))


def nth_smallest(scores: DataFrame, share: float, rows: int = NTH_ROWS) -> float | None:
    """The least of the column ``score`` that a ``share`` of them do not exceed
    (``percentile_disc``, in bounded memory): approximate quantiles on both
    sides of it leave a few hundredths of the scores, until ``rows`` at most
    are left."""
    n = scores.count()
    k = max(1, math.ceil(share * n))
    while n > rows:
        sides = [max(0.0, k / n - 0.01), min(1.0, k / n + 0.01)]
        low, high = scores.agg(F.percentile_approx("score", sides, 1000)).first()[0]
        to_low, below_low, below_high = scores.agg(*(F.count_if(x) for x in (
            F.col("score") <= low, F.col("score") < low, F.col("score") < high))).first()
        if below_low < k <= to_low:
            return low
        if k <= below_low:  # no approximation is that far off; whatever it gives, the search goes on
            scores, n = scores.where(F.col("score") < low), below_low
        elif k <= below_high:
            scores, n, k = scores.where((F.col("score") > low) & (F.col("score") < high)), below_high - to_low, k - to_low
        else:
            to_high = scores.where(F.col("score") <= high).count()
            if k <= to_high:
                return high
            scores, n, k = scores.where(F.col("score") > high), n - to_high, k - to_high
    return sorted(r[0] for r in scores.collect())[k - 1] if n else None


def trusted_threshold(texts: DataFrame, ratios: list[float], share: float = TRUSTED_SHARE) -> float:
    """The ``share`` quantile of the scores of ``texts``, the trusted documents
    that are not in the model, as far as they pass the base rules; without any,
    nothing is below it."""
    # the base rules are no filter here: it would be moved below the join, to all documents
    of = F.when(~F.col("base_failed"), F.col("score")).alias("score")
    found = nth_smallest(durable(_scored(texts, ratios, len(ratios)).select(of), "scores").where("score is not null"), share)
    return -math.inf if found is None else found


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_share: float = TRUSTED_SHARE,
          id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """One row per document: (id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, base_failed, kept); with ``keep_columns`` the rows
    of ``docs`` that are kept, unchanged."""
    counted, held_out = _split(docs, labels, id_col, text_col)
    ratios = fit(counted, buckets)
    threshold = trusted_threshold(held_out, ratios, trusted_share)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")) if keep_columns else None
    rows = rows.select("row", F.col("row")[text_col].alias("text")) if keep_columns else docs.select(
        docs[id_col].alias("id"), docs[text_col].alias("text"))
    judged = _scored(rows, ratios, buckets).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    if keep_columns:
        return judged.where("kept").select("row.*")
    return judged.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score",
                         "base_failed", "kept")
