"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive words; positions marked 0 may hold any word, so a hit survives a substituted word
there. Windows of the benchmark are hashed under every mask and kept in a bounded table per block of items; each
task looks its own windows up in it, and every hit is verified at once by aligning the whole item with the text on
the hit's diagonal and scoring matches against substitutions. Documents are never shuffled and nothing about them
leaves the task but the verified overlaps.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, mix64, slices

# Masks of span 9 to 11 and weight 6: any run of 13 aligned words with one substitution holds a hit of one of them.
SEEDS = ("110101011", "1110010011", "11001000111")
# An overlap counts from this many matching words (short items: this share of the item) ...
MIN_WORDS, MIN_SHARE = 13, 0.8
# ... inside a stretch where a match scores 1 and a substitution costs this much.
PENALTY = 2
# Benchmark words in one block: the broadcast table of a block holds at most len(SEEDS) times as many windows.
BLOCK_WORDS = 1_000_000

# Letters and digits of ASCII and all other characters make words; everything else separates them.
# Beyond ASCII `plain` has made everything but letters, marks and digits blank.
_BLANK = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BLANK[_lo:_hi] = False

# Scripts written without spaces: each character is a word.
_UNSPACED = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))

SCHEMA = "_row long, item_id long, n_match long, start_word long, end_word long"


def plain(text: Column) -> Column:
    """Lower-cased text whose words are runs of ASCII letters and digits and of other bytes."""
    text = F.lower(text)
    apart = F.regexp_replace(F.regexp_replace(text, r"[^\p{ASCII}\p{L}\p{M}\p{N}]+", " "), f"([{_UNSPACED}])", " $1 ")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(apart)


def least_matches(n_item: int) -> int:
    return min(MIN_WORDS, max(1, int(np.ceil(MIN_SHARE * n_item))))


@functools.cache
def short_seeds(n_item: int) -> tuple[str, ...]:
    """Masks of which one fits between the changed words, whichever they are, while least_matches(n_item) are left.

    Greedy cover: the mask that fits most of the choices not yet served; wider masks hit less often by chance.
    """
    need = least_matches(n_item)
    weight = min(6, need)
    choices = {sum(1 << k for k in c) for c in combinations(range(n_item), n_item - need)}
    fits, out = {}, []
    for span in range(weight, n_item + 1):
        for inner in combinations(range(1, span - 1), max(0, weight - 2)):
            at = {0, *inner, span - 1}
            if len(at) == weight:
                mask = "".join("01"[k in at] for k in range(span))
                bits = sum(1 << k for k in at)
                fits[mask] = {c for c in choices if any(not (bits << k) & c for k in range(n_item - span + 1))}
    while choices:
        mask = max(fits, key=lambda m: (len(fits[m] & choices), m))
        choices = choices - fits[mask]
        out.append(mask)
    return tuple(out)


def _windows(words: Words, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of the seed inside one text."""
    span, h = len(seed), words.hashes
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(len(seed)))
    for k, bit in enumerate(seed):
        if bit == "1":
            total += h[k: k + n] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    at = np.arange(n)
    at = at[words.first[1:][words.doc()[:n]] >= at + span]
    return at, mix64(total[at])


class SeedIndex:
    """Hashes of all windows of a block of benchmark items, sorted, behind a bit table that dismisses most words."""

    def __init__(self, items: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()), blank=_BLANK)
        self.items, self.first, self.hashes = np.array(items, np.int64), words.first, words.hashes
        doc, sizes = words.doc(), words.counts
        # items of MIN_WORDS matches go by SEEDS, shorter ones also by the masks that serve their length
        short = {int(n): short_seeds(int(n)) for n in np.unique(sizes) if n and least_matches(int(n)) < MIN_WORDS}
        self.seeds = [*SEEDS, *sorted({m for masks in short.values() for m in masks} - set(SEEDS))]
        self.tables = []
        for seed in self.seeds:
            pos, key = _windows(words, seed)
            if seed not in SEEDS:
                mine = np.isin(sizes[doc[pos]], [n for n, masks in short.items() if seed in masks])
                pos, key = pos[mine], key[mine]
            order = np.argsort(key, kind="stable")
            key, pos = key[order], pos[order]
            bits = np.zeros(1 << 20, bool)
            bits[(key & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.tables.append((key, pos, doc[pos], bits))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text word at which the item would begin, item, text) of all seed hits."""
        doc, out = words.doc(), []
        for seed, (key, pos, item, bits) in zip(self.seeds, self.tables):
            at, h = _windows(words, seed)
            maybe = bits[(h & np.uint64(0xFFFFF)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            n = hi - lo
            which = np.repeat(np.arange(len(at)), n)
            entry = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            begin = at[which] - (pos[entry] - self.first[item[entry]])
            out.append(np.stack([doc[at[which]], item[entry], begin]))
        found = np.concatenate(out, axis=1)
        if not found.size:
            return tuple(found)
        found = np.unique(found, axis=1)
        # every hit of an item whose words must all match is a whole copy: the last one of a text stands for all
        more = (found[0, 1:] == found[0, :-1]) & (found[1, 1:] == found[1, :-1])
        size = self.first[found[1] + 1] - self.first[found[1]]
        keep = np.append(~more, True) | (size > 4)
        return tuple(found[:, keep])

    def verify(self, words: Words, doc: int, item: int, begin: int) -> tuple[int, int, int] | None:
        """(matching words, first, last + 1) of a stretch of the diagonal, positions in the text, or None.

        Of the stretches with enough matching words the one of the best score, the shortest of equals; it counts
        unless that score is negative.
        """
        n_item = int(self.first[item + 1] - self.first[item])
        lo, hi = max(begin, int(words.first[doc])), min(begin + n_item, int(words.first[doc + 1]))
        other = self.hashes[self.first[item] + lo - begin: self.first[item] + hi - begin]
        same = words.hashes[lo:hi] == other
        need = least_matches(n_item)
        match = np.flatnonzero(same)
        if len(match) < need:
            return None
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
        low = np.minimum.accumulate(score)
        latest = np.maximum.accumulate(np.where(score == low, np.arange(len(score)), 0))
        # for each end at a match: the best start that leaves enough matches inside, the latest of equals
        ends, starts = match[need - 1:] + 1, latest[match[: len(match) - need + 1]]
        worth = score[ends] - score[starts]
        best = int(np.lexsort((ends - starts, -worth))[0])
        if worth[best] < 0:
            return None
        start, end = int(starts[best]), int(ends[best])
        n_match = int(same[start:end].sum())
        base = int(words.first[doc])
        return n_match, lo + start - base, lo + end - base


def _scan(batches: Iterator[pa.RecordBatch], index: SeedIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            words = Words(part.column("_text"), blank=_BLANK)
            ids, best = part.column("_row"), {}
            for doc, item, begin in zip(*index.hits(words)):
                found = index.verify(words, int(doc), int(item), int(begin))
                if found and found > best.get((doc, item), (0,)):
                    best[doc, item] = found
            rows = [(ids[int(d)].as_py(), int(index.items[i]), *f) for (d, i), f in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                                             ["_row", "item_id", "n_match", "start_word", "end_word"])


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key as `_row`, item_id, n_match, start_word, end_word): the best verified overlap of each document and item.

    Words are runs of letters, marks and digits, case ignored, and single characters of scripts without spaces. The benchmark is read in blocks of BLOCK_WORDS words, so
    its table in a task is bounded; one pass over the documents per block.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("_row"), plain(F.col(text)).alias("_text"))
    out, items, texts, size = [], [], [], 0

    def close():
        index = SeedIndex(items[:], texts[:])
        out.append(source.mapInArrow(lambda batches: _scan(batches, index), SCHEMA))
        items.clear(), texts.clear()

    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", plain(F.col("text")).alias("text"))
    for r in rows.orderBy("item_id", "text").toLocalIterator():  # block by block, never whole
        items.append(-1 if r.item_id is None else r.item_id)
        texts.append(r.text)
        size += r.text.count(" ") + 1
        if size >= BLOCK_WORDS:
            close()
            size = 0
    if items:
        close()
    if not out:
        return spark.createDataFrame([], SCHEMA)
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, contaminated, n_items, best_item, n_match, start_word, end_word).

    best_item has the most matching words, the smallest item_id among equals, with the place of its overlap in
    words of letters and digits. An item of up to 15 words is found wherever its share of matching words is reached, one of
    up to four words only as a whole. Null or empty texts, and an empty benchmark, give contaminated = false and nulls
    in the last four; items without words match nothing; rows that share a doc_id (null included) give one row,
    contaminated if any of them is.
    """
    found = overlaps(docs, benchmark, ident, text)
    best = F.max_by(F.struct("item_id", "n_match", "start_word", "end_word"),
                    F.struct("n_match", -F.col("item_id"), -F.col("start_word")))
    hits = found.groupBy("_row").agg(F.countDistinct("item_id").alias("n_items"), best.alias("b"))
    every = docs.select(F.col(ident).cast("long").alias("doc_id")).distinct()
    return every.join(hits, F.col("doc_id").eqNullSafe(F.col("_row")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("b.item_id").alias("best_item"),
        F.col("b.n_match").alias("n_match"), F.col("b.start_word").alias("start_word"),
        F.col("b.end_word").alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without those that overlap a benchmark item; ids shared with one go too."""
    hit = overlaps(docs, benchmark, ident, text).select("_row").distinct()
    return docs.join(hit, docs[ident].cast("long").eqNullSafe(hit["_row"]), "left_anti")
