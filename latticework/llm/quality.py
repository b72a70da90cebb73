"""Quality rules: plain text statistics and a hashed n-gram log-likelihood ratio.

The corpus and its trusted part (documents labelled good and not toxic) are each reduced to one multinomial over
hashed word unigrams and bigrams. A document scores the mean over its n-grams of log(trusted / raw): text made of
n-grams that trusted documents do not use scores far below zero. Documents below a fixed threshold are rejected.
Everything is DataFrame code.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16_384
# The target is fitted on at most this many trusted documents (those whose hashed ids are smallest), so that their ids
# can be broadcast and no text is shuffled; the raw counts come from all documents.
TRUSTED = 100_000
# Mean log-ratio per n-gram below which a document is rejected, and the pseudo-count given to every bucket.
THRESHOLD, SMOOTHING = -0.15, 1.0
BLANK = " \t\n\u000b\f\r"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; none for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK_RUN))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), body)[0]


def _windows(hashes: Column) -> Column:
    """Hash of every 5-word window."""
    return F.when(F.size(hashes) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)])))


def _covered(windows: Column) -> Column:
    """Words inside the windows found more than once, each word once.

    Sorting (hash, place) puts equal windows side by side; the places kept are then walked in text order.
    """
    def places(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, j: (p["h"] == F.get(pairs, j + 1)["h"])
                         | ((j > 0) & (p["h"] == F.get(pairs, F.greatest(j - 1, F.lit(0)))["h"])))
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        let(pairs, places), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")))["n"]


def grams(hashes: Column) -> Column:
    """Buckets of unigrams and bigrams of hashed words."""
    def bucket(h: Column) -> Column:
        return F.pmod(h, F.lit(BUCKETS)).cast("int")

    pairs = F.transform(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
                        lambda h, i: bucket(F.xxhash64(F.get(hashes, i), h)))
    return F.concat(F.transform(hashes, bucket), pairs)


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _grams.

    `_grams` are the buckets of the hashed unigrams and bigrams. Repeated windows are only located in texts that
    have any.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    solid = body
    for c in BLANK:
        solid = F.replace(solid, F.lit(c), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    def measured(hashes: Column) -> Column:
        repeated = let(_windows(hashes), lambda w: F.when(
            F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0).cast("long")))
        return F.struct(F.size(hashes).cast("long").alias("n_words"), repeated.alias("n_repeat_words"),
                        grams(hashes).alias("_grams"))

    df = docs.withColumns({
        "_m": let(word_hashes(F.col(text)), measured),
        "word_chars": F.length(solid).cast("long"), "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))})
    return df.withColumns({c: F.col("_m")[c] for c in ("n_words", "n_repeat_words", "_grams")}).drop("_m")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the trusted target, TRUSTED at most: labelled good and not toxic in every label they have."""
    return (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
                  .agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)).alias("ok"))
                  .where("ok").select(F.col("doc_id").alias("trusted_id"))
                  .orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(TRUSTED))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", ident: str = "doc_id") -> list[float]:
    """log(trusted / raw) of each of the BUCKETS buckets, from all documents; zeros where nothing is trusted."""
    marked = docs.select(F.col(ident).alias("_id"), let(word_hashes(F.col(text)), grams).alias("_g")).join(
        F.broadcast(trusted), F.col("_id") == F.col("trusted_id"), "left")
    counts = (marked.select(F.explode("_g").alias("b"), F.col("trusted_id").isNotNull().cast("long").alias("t"))
                    .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good")))
    rows = {r.b: (r.raw, r.good) for r in counts.collect()}  # at most BUCKETS rows
    raw, good = (sum(v[i] for v in rows.values()) for i in (0, 1))
    if not good:
        return [0.0] * BUCKETS
    return [math.log((rows.get(b, (0, 0))[1] + SMOOTHING) / (good + SMOOTHING * BUCKETS))
            - math.log((rows.get(b, (0, 0))[0] + SMOOTHING) / (raw + SMOOTHING * BUCKETS)) for b in range(BUCKETS)]


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id",
           threshold: float = THRESHOLD) -> DataFrame:
    """The rows with the statistics, log_ratio (mean over n-grams), base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept: not base_failed and
    log_ratio at or above the threshold. Null and empty texts have no words and fail; without trusted documents
    every log_ratio is 0; null ids are never trusted; repeated rows are judged alike; no rows give no rows. Input
    columns named like an output column are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio", "base_failed", "kept")
    kept = [c for c in docs.columns if c not in names]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("_text"))
    table = F.from_json(F.lit(json.dumps(log_ratios(docs, trusted_ids(labels), text, ident))), "array<double>")
    df = statistics(packed, "_text")
    ratio = let(F.col("_grams"), lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(table, b))
                / F.nullif(F.size(g), F.lit(0)))
    df = df.withColumn("log_ratio", F.coalesce(ratio, F.lit(0.0)))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(threshold)))
    return df.select(*[F.col("row")[c].alias(c) for c in kept], *names)
