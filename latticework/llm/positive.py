"""Quality classifier by positive-unlabelled learning.

A linear model over text features minimises the non-negative risk of trusted positives and unlabelled web text. With
squared loss l(z) = (1 - z)^2 / 4 that risk depends on the data only through first and second moments of the features:

    risk(w) = prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]),    f = w . features

so one pass over all documents gathers them, and the minimum is found on matrices whose size is the number of features.
The bracket may not fall below zero: max(0, b) is the greatest t * b for t from 0 to 1, the sum is convex in w for each t,
so the minimum lies at the t where the bracket is zero, or at t = 1 where it stays positive.

The class prior is estimated from the labels of training rows, as the share of trusted documents among labelled ones.
The score is the posterior share of positives at a value of f: prior times the density of f among positives over that
among all documents, made monotone; densities are counted over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .words import Words, mix64, shingles, slices, text_bytes

# Trusted documents that the fit reads (those with the smallest hashes); unlabelled text is all documents.
TRUSTED = 200_000
# Buckets of hashed words, and knots of each scalar feature.
BUCKETS, KNOTS = 128, (0.02, 0.1, 0.3, 1.0)
RIDGE = 1e-5
# Bins of f, from -LIMIT to LIMIT, for the densities behind the score.
BINS, LIMIT = 400, 2.0
THRESHOLD = 0.3

_CLASSES = 8  # of bytes: lower, upper, digit, blank, line end, sentence mark, other ASCII, beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a"): ord("z") + 1] = 0
_CLASS[ord("A"): ord("Z") + 1] = 1
_CLASS[ord("0"): ord("9") + 1] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:] = 7
_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True
_BLOCK = 1 << 20
_SCALARS = 7
WIDTH = 2 + _CLASSES ** 2 + BUCKETS + _SCALARS * len(KNOTS) + 3


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    return counts / np.maximum(total, 1)


def _repeats(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, told apart by 40 bits, and the count of the most frequent one."""
    key = (doc.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24))
    key.sort()
    at = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    owner = (key[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, np.diff(np.append(at, len(key))))
    return np.bincount(owner, minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers per text, all between 0 and about 2; null texts are empty."""
    n = len(texts)
    raw, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    pairs, text_of = np.zeros(n * _CLASSES ** 2, np.int64), np.repeat(np.arange(n, dtype=np.int32), sizes)
    for start in range(0, len(raw), _BLOCK):
        stop = min(start + _BLOCK, len(raw) - 1)  # the last byte begins no pair
        kind = _CLASS[raw[start: stop + 1]]
        code = text_of[start: stop] * _CLASSES ** 2 + kind[:-1] * np.uint8(_CLASSES) + kind[1:]
        np.add.at(pairs, code[text_of[start: stop] == text_of[start + 1: stop + 1]], 1)
    pairs = np.sqrt(_shares(pairs.reshape(n, -1), (sizes - 1)[:, None]))

    words = Words(texts)
    doc, count = words.doc(), words.counts
    bucket = (mix64(words.hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)
    hashed = np.sqrt(_shares(np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, -1), count[:, None]))
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    different, most = _repeats(doc, words.hashes, n)
    run_doc, run = shingles(words, 5)
    runs = np.bincount(run_doc, minlength=n)
    lines = Words(texts, blank=_LINES)
    line_doc, n_lines = lines.doc(), lines.counts
    letters = np.bincount(doc, words.ends - words.starts, minlength=n)
    scalars = np.stack([
        _shares(np.bincount(doc[again], minlength=n), count), _shares(most, count), 1 - _shares(different, count) * (count > 0),
        1 - _shares(_repeats(run_doc, run, n)[0], runs) * (runs > 0), 1 - _shares(_repeats(line_doc, lines.hashes, n)[0], n_lines) * (n_lines > 0),
        np.minimum(_shares(letters, count) / 40, 1), np.minimum(_shares(count, n_lines) / 500, 1)], axis=1)
    bent = np.concatenate([np.minimum(scalars, k) / k for k in KNOTS], axis=1)
    logs = np.stack([np.log1p(count) / 10, np.log1p(sizes) / 15, np.log1p(n_lines) / 8], axis=1)
    return np.concatenate([np.ones((n, 1)), (count == 0)[:, None].astype(float), pairs, hashed, bent, logs], axis=1)


def _matrix(rows: list) -> np.ndarray:
    return np.stack([np.frombuffer(r.total) for r in sorted(rows, key=lambda r: r.i)])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of features over all texts and over trusted ones, a row of the matrices at a time."""
    total = np.zeros((2, WIDTH, WIDTH))
    for batch in batches:
        for part in slices(batch, "_text"):
            x = features(part.column("_text"))
            total[0] += x.T @ x
            x = x[part.column("_trusted").to_numpy(zero_copy_only=False)]
            total[1] += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], WIDTH)), pa.array(np.tile(np.arange(WIDTH), 2)),
                                      pa.array([r.tobytes() for r in total.reshape(-1, WIDTH)], pa.binary())], ["kind", "i", "total"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, i, total in zip(*(c.to_pylist() for c in batch.columns)):
            sums[kind, i] = sums.get((kind, i), 0.0) + np.frombuffer(total)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int64()), pa.array([i for _, i in sums], pa.int64()),
                                      pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["kind", "i", "total"])


def least_risk(unlabelled: np.ndarray, trusted: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the least non-negative risk from the mean products of features (feature 0 is constant)."""
    m_u, m_p = unlabelled[0], trusted[0]
    ridge = RIDGE * np.eye(len(m_u))
    ridge[0, 0] = 0.0

    def best(t: float) -> tuple[np.ndarray, float]:
        w = np.linalg.lstsq(prior * (1 - t) * trusted + t * unlabelled + ridge, prior * (1 + t) * m_p - t * m_u, rcond=None)[0]
        bracket = (1 + 2 * m_u @ w + w @ unlabelled @ w) - prior * (1 + 2 * m_p @ w + w @ trusted @ w)
        return w, bracket

    w, bracket = best(1.0)
    low, high = 0.0, 1.0
    if bracket < 0:
        for _ in range(60):
            t = (low + high) / 2
            w, bracket = best(t)
            low, high = (low, t) if bracket < 0 else (t, high)
    return w


def posterior(trusted: np.ndarray, everything: np.ndarray, prior: float) -> np.ndarray:
    """Share of positives at each bin of f, never falling: prior times a ratio of densities, pooled where it would fall."""
    n_p, n_u = max(trusted.sum(), 1.0), max(everything.sum(), 1.0)
    pools: list[list[float]] = []  # positives expected, documents, bins
    for p, u in zip(prior * n_u * trusted / n_p, everything):
        pools.append([p, u, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.concatenate([np.full(int(bins), min(p / u, 1.0) if u else 0.0) for p, u, bins in pools])


@dataclass
class Classifier:
    prior: float
    weights: np.ndarray
    shares: np.ndarray = field(default_factory=lambda: np.linspace(0, 1, BINS))


def _held_out(ident: str) -> Column:
    """Null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trusted_ids(labels: DataFrame, ident: str = "doc_id", label: str = "quality") -> tuple[DataFrame, float]:
    """(trusted ids, estimated prior) of labels on rows that are not held out.

    Trusted are ids whose labels all say 1; about TRUSTED of them at most, chosen by a hash of the id. The prior is the share
    of trusted ids among all labelled ones, 1/2 without labels.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & ~_held_out(ident)).groupBy(ident).agg(F.min(label).alias("_q"))
    n, good = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("_q") == 1, 1))).first()
    part, steps = min(1.0, TRUSTED / max(good, 1)), 1 << 30
    chosen = F.pmod(F.xxhash64(F.lit("trusted"), ident), F.lit(steps)) < int(part * steps)
    return known.where((F.col("_q") == 1) & chosen).select(F.col(ident).alias("_id")), good / n if n else 0.5


def _marked(docs: DataFrame, trusted: DataFrame, text: str, ident: str) -> DataFrame:
    """(_text, _trusted, other columns); the trusted ids are about TRUSTED at most, hence the broadcast."""
    listed = F.broadcast(trusted.withColumn("_t", F.lit(True)))
    rest = [c for c in docs.columns if c != text]
    return docs.join(listed, F.col(ident) == F.col("_id"), "left").select(
        F.col(text).alias("_text"), F.coalesce("_t", F.lit(False)).alias("_trusted"), *rest)


def train(docs: DataFrame, trusted: DataFrame, prior: float, text: str = "text", ident: str = "doc_id") -> Classifier:
    """The model of least risk over all documents. Without documents or trusted ones all texts are alike to it."""
    marked = _marked(docs.select(text, ident), trusted, text, ident).select("_text", "_trusted")
    sums = marked.mapInArrow(_moments, "kind long, i long, total binary").repartition(16, "i").mapInArrow(_add, "kind long, i long, total binary")
    rows = sums.collect()  # as many as there are features, twice
    everything, positive = (_matrix([r for r in rows if r.kind == k]) if rows else np.zeros((1, 1)) for k in (0, 1))
    if not positive[0, 0]:
        return Classifier(prior, np.zeros(WIDTH))
    return Classifier(prior, least_risk(everything / everything[0, 0], positive / positive[0, 0], prior))


def evaluate(docs: DataFrame, trusted: DataFrame, model: Classifier, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Every document with `_f`, the value of the model, and `_trusted`; the text is left out."""
    marked = _marked(docs, trusted, text, ident)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema[1:])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                f = np.clip(features(part.column("_text")) @ model.weights, -LIMIT, LIMIT)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(f)], [*part.schema.names[1:], "_f"])

    return marked.mapInArrow(work, f"{fields}, _f double")


def calibrate(valued: DataFrame, model: Classifier) -> Classifier:
    """The model with the posterior shares that its values have over all evaluated documents."""
    bin_ = F.least(F.floor((F.col("_f") + LIMIT) / (2 * LIMIT) * BINS), F.lit(BINS - 1)).alias("bin")
    counts = np.zeros((2, BINS))
    for r in valued.groupBy(bin_, "_trusted").count().collect():  # two rows a bin at most
        counts[int(r["_trusted"]), r["bin"]] = r["count"]
    shares = posterior(counts[1], counts.sum(axis=0), model.prior) if counts[1].any() else model.shares
    return Classifier(model.prior, model.weights, shares)


def scores(model: Classifier) -> Column:
    """Score of `_f`: the posterior share between bin middles, with a hundredth of the value so that unlike ones keep their order."""
    shares = F.array(*[F.lit(float(v)) for v in model.shares])
    place = (F.col("_f") + LIMIT) / (2 * LIMIT) * BINS - 0.5
    low = F.greatest(F.lit(0), F.least(F.floor(place), F.lit(BINS - 2))).cast("int")
    beyond = F.greatest(F.lit(0.0), F.least(place - low, F.lit(1.0)))
    share = F.get(shares, low) + beyond * (F.get(shares, low + 1) - F.get(shares, low))
    return 0.99 * share + 0.01 * (F.col("_f") + LIMIT) / (2 * LIMIT)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Only the text enters a score. Null and blank texts are scored as empty ones, repeated rows alike, and a null doc_id is
    held out as its hash says but never trusted. Other columns are not read; no rows give no rows, and without trusted
    labels every text gets the same score.
    """
    rows = docs.select("doc_id", "text")
    trusted, prior = trusted_ids(labels)
    trusted = staged(trusted, "trusted")
    model = train(rows, trusted, prior)
    valued = staged(evaluate(rows, trusted, model), "values")
    scored = valued.withColumn("score", scores(calibrate(valued, model)))
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
