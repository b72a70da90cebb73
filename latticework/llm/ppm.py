"""Language-model scoring by prediction by partial matching over bytes.

Training documents give counts of byte 6-grams, which hold the trie of contexts of 5, 3, 2, 1 and 0 bytes. A symbol
seen after the longest context takes count / (total + distinct); anything else escapes with distinct / (total +
distinct) (method C) to the next shorter context, where symbols the longer one had seen are excluded from totals. Below
order 0 the remaining bytes are equally likely. The model is pretrained, so what follows a context is a fixed
distribution: contexts of up to three bytes are rows of 256 log-probabilities; a context of five bytes lists what it
has seen and what an escape adds to its suffix's row. A text's score is a sum of such entries. Frequent contexts are
resolved from tables of fixed size; the 6-grams of all others leave the task, added up by text, and are joined to the
counts of every context, so the sizes decide where a value comes from and never what it is.

The word baseline is exact: counts of words come from all training documents, frequent words are resolved from a
table of fixed size, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .words import Words, slices, text_bytes, _LOWER

# Size of the broadcast tables: contexts of three bytes with a row of their own and symbols listed after contexts of five
# bytes, the most frequent contexts first; rarer ones are joined. At most (CONTEXTS + 65,536 + 257) rows of 256 floats
# and LISTED entries. Words in the broadcast table of frequent words.
CONTEXTS, LISTED, FREQUENT = 1 << 15, 1 << 21, 1 << 20
ORDER = 5
_HELD = 2_000_000  # distinct keys a task keeps before it adds them up
_SCORED_BYTES = 1 << 19  # text scored at once: beside the model a task holds about 200 bytes for each


def held_out(ident: str) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(6-gram of each symbol, first symbol of each text): lower-cased bytes and an end symbol 0, padded with 0."""
    raw, offs = text_bytes(texts)
    n, pad = len(offs) - 1, ORDER + 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    body = np.zeros(len(raw) + pad * n, np.uint64)  # ORDER zeros, the bytes, the end
    body[np.arange(len(raw)) + pad * doc + ORDER] = np.maximum(_LOWER[raw], 1)
    keep = np.ones(len(body), bool)
    for k in range(ORDER):
        keep[offs[:-1] + pad * np.arange(n) + k] = False
    gram = body.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= body[:-k] << np.uint64(8 * k)
    return gram[keep], offs + np.arange(n + 1)


class _Sums:
    """Counts of keys, added up whenever many are held."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        key, n = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(n)
        self.held += len(key)
        if self.held > _HELD:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(self.counts), minlength=len(key)).astype(np.int64)
        self.keys, self.counts, self.held = [key], [n], len(key)
        return key, n

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        key, n = self.fold()
        for a in range(0, len(key), 100_000):
            part = key[a: a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), kind, np.int32)), pa.array(part.astype(np.uint64).view(np.int64)),
                 pa.array(n[a: a + 100_000])], ["kind", "key", "n"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 word hash, 1 byte 6-gram, 2 number of texts."""
    word, gram, texts = _Sums(), _Sums(), 0
    for batch in batches:
        texts += batch.num_rows
        for part in slices(batch, "_text"):
            column = part.column("_text")
            word.add(Words(column).hashes)
            gram.add(_symbols(column)[0])
        for kind, sums in ((0, word), (1, gram)):
            if sums.held > _HELD // 2:
                yield from sums.rows(kind)
                sums.__init__()
    yield from word.rows(0)
    yield from gram.rows(1)
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())],
                                     ["kind", "key", "n"])


def _threshold(sized: DataFrame, most: int, weight: Column | None = None) -> float:
    """Smallest log2 step of `n` such that the rows (or weights) that reach it come to `most` at most."""
    step = F.floor(F.log2("n") * 16)
    seen = 0
    per_step = sized.groupBy(step.alias("s")).agg(F.sum(F.lit(1) if weight is None else weight).alias("w"))
    for r in per_step.orderBy(F.desc("s")).collect():  # under 1,024 rows
        if seen + r.w > most:
            return 2.0 ** ((r.s + 1) / 16)
        seen += r.w
    return 0.0


class PpmModel:
    """Log10-probabilities after contexts of up to three bytes as rows, and the listed continuations of longer ones."""

    def __init__(self, gram4: np.ndarray, n4: np.ndarray, gram3: np.ndarray, n3: np.ndarray,
                 gram6: np.ndarray | None = None, n6: np.ndarray | None = None, whole: tuple[bool, bool] = (True, True)):
        """Sorted grams with counts: all 3-grams, the 4-grams of kept contexts, the 6-grams of kept long contexts.

        `whole` says whether all contexts of three and of five bytes are kept.
        """
        self.whole = whole
        self.keys: list[np.ndarray] = []  # contexts of order 0, 1, 2, 3
        rows, counts, rest = [], [], None
        for order in range(4):
            if order == 3:
                gram, n = gram4, n4
            else:
                gram, back = np.unique(gram3 & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
                n = np.bincount(back, weights=n3, minlength=len(gram))
            ctx, at = np.unique(gram >> np.uint32(8), return_inverse=True)
            if order == 0 and not len(ctx):
                ctx = np.zeros(1, np.uint32)
            seen = np.zeros((len(ctx), 256), np.float32)
            seen[at, gram & np.uint32(255)] = n
            total, kinds = seen.sum(axis=1, dtype=np.float64)[:, None], (seen > 0).sum(axis=1)[:, None]
            if order == 0:
                below = np.full((1, 256), 1.0 / max(1, 256 - int(kinds[0, 0])), np.float32)
            else:
                parent = np.searchsorted(self.keys[-1], ctx & np.uint32((1 << 8 * (order - 1)) - 1) if order > 1
                                         else np.zeros(len(ctx), np.uint32))
                lower = counts[-1][parent]
                free = np.where(seen > 0, np.float32(0), lower)
                t, d = free.sum(axis=1, dtype=np.float64)[:, None], (free > 0).sum(axis=1)[:, None]
                size = np.maximum(t + d, 1).astype(np.float32)
                below = np.where(lower > 0, free / size, np.where(t + d > 0, d / size, 1.0).astype(np.float32) * rest[parent])
            size = np.maximum(total + kinds, 1).astype(np.float32)
            row = np.where(seen > 0, seen / size, np.where(total > 0, kinds / size, 1.0).astype(np.float32) * below)
            self.keys.append(ctx.astype(np.uint32))
            rows.append(np.log10(np.maximum(row, 1e-38)).astype(np.float32))
            rest = below.astype(np.float32)
            counts.append(seen)
        self.first = np.cumsum([0, *[len(k) for k in self.keys[:-1]]])
        self.table = np.concatenate(rows)
        self._row: np.ndarray | None = None
        self._add_long(np.zeros(0, np.uint64) if gram6 is None else gram6, np.zeros(0) if n6 is None else n6, counts)

    def _add_long(self, gram: np.ndarray, n: np.ndarray, counts: list[np.ndarray]) -> None:
        """List the continuations of five-byte contexts and what their escapes add to their suffix's row."""
        seen = np.concatenate(counts)
        self.seen = np.packbits(seen > 0, axis=1)
        self.long, at = np.unique(gram >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(at, weights=n, minlength=len(self.long)), np.bincount(at, minlength=len(self.long))
        suffix = (self.long & np.uint64(0xFFFFFF)).astype(np.int64)
        row, kept = self.short_row()[suffix & 0xFFFF], np.searchsorted(self.keys[3], suffix)
        own = np.append(self.keys[3], np.uint32(1 << 31))[kept] == suffix  # 1 << 31 is no context
        row[own] = self.first[3] + kept[own]
        self.total, self.kinds = seen.sum(axis=1, dtype=np.float64), (seen > 0).sum(axis=1)
        all_t, all_d = self.total[row], self.kinds[row]
        barred = np.bincount(at, weights=seen[row[at], (gram & np.uint64(255)).astype(np.int64)], minlength=len(self.long))
        t, d = all_t - barred, all_d - kinds
        escape = kinds / np.maximum(total + kinds, 1)
        with np.errstate(divide="ignore"):
            self.known = np.log10(escape * (all_t + all_d) / np.maximum(t + d, 1)).astype(np.float32)  # seen by the suffix
            fresh = escape * (all_t + all_d) / np.maximum(all_d, 1) * np.where(t + d > 0, d / np.maximum(t + d, 1), 1.0)
            self.fresh = np.log10(np.maximum(fresh, 1e-38)).astype(np.float32)
        self.grams, self.logs = gram, np.log10(n / (total + kinds)[at]).astype(np.float32) if len(gram) else np.zeros(0, np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_row": None}

    def short_row(self) -> np.ndarray:
        """Row of the longest seen context of every 2-byte context."""
        one = np.zeros(256, np.int32)
        one[self.keys[1]] = self.first[1] + np.arange(len(self.keys[1]))
        two = np.tile(one, 256)
        two[self.keys[2]] = self.first[2] + np.arange(len(self.keys[2]))
        return two

    def row(self) -> np.ndarray:
        """Row of the longest kept context of every 3-byte context."""
        if self._row is None:
            self._row = np.tile(self.short_row(), 256)
            self._row[self.keys[3]] = self.first[3] + np.arange(len(self.keys[3]))
        return self._row

    def score(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10-probability of the last byte of each 6-gram after the others, and whether the tables settle it."""
        symbol = (grams & np.uint64(255)).astype(np.int64)
        out, todo = np.empty(len(grams), np.float32), np.arange(len(grams))
        settled = np.ones(len(grams), bool)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            found = self.grams[at] == grams
            out[found] = self.logs[at[found]]
            todo = np.flatnonzero(~found)
        row = self.row()[((grams[todo] >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.int64)]
        value, s = self.table[row, symbol[todo]], symbol[todo]
        own = np.zeros(len(todo), bool)
        if len(self.long):
            context = grams[todo] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.long, context), len(self.long) - 1)
            own = self.long[at] == context
            known = (self.seen[row, s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
            value = value + np.where(own, np.where(known, self.known[at], self.fresh[at]), np.float32(0))
        out[todo] = value
        settled[todo] = (self.whole[0] | (row >= self.first[3])) & (self.whole[1] | own)
        return out, settled

    def shorter(self) -> ShortRows:
        n = self.first[3]
        return ShortRows(self.short_row(), self.table[:n], self.seen[:n], self.total[:n], self.kinds[:n].astype(np.float64))


class ShortRows(NamedTuple):
    """The part of a model that holds contexts of up to two bytes."""

    row: np.ndarray
    table: np.ndarray
    seen: np.ndarray
    total: np.ndarray
    kinds: np.ndarray

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probability of the last byte after the two before it, seen there, total and kinds of their row)."""
        row = self.row[((grams >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
        symbol = (grams & np.uint64(255)).astype(np.int64)
        known = (self.seen[row, symbol >> 3] >> (7 - (symbol & 7)).astype(np.uint8)) & 1 == 1
        return 10.0 ** self.table[row, symbol].astype(np.float64), known, self.total[row], self.kinds[row]


_SCORED = ("uid long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>, "
           "open array<long>, open_times array<long>")


def _by_text(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Lists of each text's distinct keys and of how often each occurs."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    head = np.ones(len(key), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(head)
    offsets = pa.array(np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array(key[at].view(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(at, len(key))).astype(np.int64))))


def _score(batches: Iterator[pa.RecordBatch], model: PpmModel, frequent: np.ndarray, logs: np.ndarray,
           end: float) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in slices(batch, "_text", _SCORED_BYTES):
            column, n = part.column("_text"), part.num_rows
            grams, first = _symbols(column)
            value, settled = model.score(grams)
            score = np.add.reduceat(np.where(settled, value, np.float32(0)).astype(np.float64), first[:-1])
            left = np.flatnonzero(~settled)
            more = _by_text(np.searchsorted(first, left, "right") - 1, grams[left], n)
            words = Words(column)
            doc, h = words.doc(), words.hashes
            at = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
            known = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
            base = np.bincount(doc[known], weights=logs[at[known]], minlength=n) + end
            n_known = np.bincount(doc[known], minlength=n) + 1
            other, times = np.unique(np.stack([doc[~known].astype(np.uint64), h[~known]]), axis=1, return_counts=True) \
                if (~known).any() else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            offsets = pa.array(np.searchsorted(other[0], np.arange(n + 1).astype(np.uint64)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(uid + np.arange(n)), pa.array((words.counts + 1).astype(np.int64)),
                 pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score),
                 pa.ListArray.from_arrays(offsets, pa.array(other[1].view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))), *more],
                ["row", "uid", "n_tokens", "n_known", "base", "score", "rare", "times", "open", "open_times"])
            uid += n


def _short(batches: Iterator[pa.RecordBatch], rows: ShortRows) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column("key")
        low, seen, total, kinds = rows.look_up(key.to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([key, pa.array(low), pa.array(seen), pa.array(total), pa.array(kinds)],
                                         ["key", "p2", "seen2", "t2", "d2"])


def _last(column: str, size: int) -> Column:
    """The last `size` bytes of a gram."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1))


def _joined(keys: DataFrame, grams: DataFrame, four: DataFrame, three: DataFrame, rows: ShortRows) -> DataFrame:
    """(key, value): log10-probability of each 6-gram's last byte, from the counts of all contexts.

    t, d, x are the total of a context, its distinct symbols, and the total of these symbols after its suffix.
    """
    def sized(listed: DataFrame, suffix: DataFrame, bytes_: int, order: int) -> DataFrame:
        below = suffix.select(F.col("key").alias("b_key"), F.col("n").alias("b_n"))
        return listed.join(below, _last("key", bytes_) == F.col("b_key")).groupBy(
            F.shiftright("key", 8).alias(f"ctx{order}")).agg(
            F.sum("n").alias(f"t{order}"), F.count(F.lit(1)).alias(f"d{order}"), F.sum("b_n").alias(f"x{order}"))

    found = keys.mapInArrow(lambda b: _short(b, rows), "key long, p2 double, seen2 boolean, t2 double, d2 double")
    for listed, bytes_, order in ((four, 4, 3), (grams, 6, 5)):
        suffix, size = (three, 3) if order == 3 else (four, 4)
        own = listed.select(F.col("key").alias("g_key"), F.col("n").alias(f"n{order}"))
        found = found.join(own, _last("key", bytes_) == F.col("g_key"), "left").drop("g_key")
        stats = sized(listed, suffix, size, order)
        found = found.join(stats, F.shiftright(_last("key", bytes_), 8) == F.col(f"ctx{order}"), "left").drop(f"ctx{order}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")

    def escaped(free: Column, distinct: Column) -> Column:
        return F.when(distinct > 0, distinct / (free + distinct)).otherwise(1.0)

    t, d = F.col("t2") - zero("x3"), F.col("d2") - zero("d3")
    below = F.when(F.col("d3").isNull(), F.col("p2")).when(
        F.col("seen2"), F.col("p2") * (F.col("t2") + F.col("d2")) / (t + d)).otherwise(
        F.col("p2") * (F.col("t2") + F.col("d2")) / F.col("d2") * escaped(t, d))
    t, d = zero("t3") - zero("x5"), zero("d3") - zero("d5")
    shorter = F.when(F.col("n3").isNotNull(), F.col("n3") / (t + d)).otherwise(escaped(t, d) * below)
    value = F.when(F.col("n5").isNotNull(), F.col("n5") / (F.col("t5") + F.col("d5"))).otherwise(
        escaped(zero("t5"), zero("d5")) * shorter)
    return found.select(F.col("key").alias("v_key"), F.log10(value).alias("value"))


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(n).to_numpy() for n in names]


def lm_scores(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The rows (columns `keep`, default all) with held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out. `score` is the log10 probability of the lower-cased bytes and the
    end of the text, `base_score` that of its words and one end under smoothed word counts. Null texts are empty;
    without training rows every byte is equally likely; repeated rows are learned and scored each; no rows give no
    rows; input columns named like an output column are replaced.
    """
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in names]
    learned = docs.where(~held_out(ident)).select(F.col(text).alias("_text")).mapInArrow(_learn, "kind int, key long, n long")
    counts = staged(learned.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    facts = {r.kind: (r.n or 0, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("key").alias("v")).collect()}
    texts = facts.get(2, (0, 0))[0]
    train = facts.get(0, (0, 0))[0] + texts
    kinds = facts.get(0, (0, 0))[1] + (1 if texts else 0)
    divisor = train + 0.5 * (kinds + 1)

    words = counts.where(F.col("kind") == 0).select("key", "n")
    least = _threshold(words, FREQUENT)
    key, n = _arrays(words.where(F.col("n") >= least), "key", "n")
    order = np.argsort(key.view(np.uint64))
    frequent, logs = key[order].view(np.uint64), np.log10((n[order] + 0.5) / divisor)

    grams = counts.where(F.col("kind") == 1).select("key", "n")

    def shortened(longer: DataFrame, size: int) -> DataFrame:
        """Counts of the last `size` bytes."""
        return longer.groupBy(_last("key", size).alias("key")).agg(F.sum("n").alias("n"))

    def of_frequent(listed: DataFrame, most: int, weight: Column | None) -> tuple[np.ndarray, np.ndarray, bool]:
        """Sorted grams, with counts, whose contexts are frequent enough to fit `most` contexts (or weights), and if all are."""
        ctx = F.shiftright("key", 8)
        sized = listed.groupBy(ctx.alias("ctx")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
        least = _threshold(sized, most, weight)
        own = sized.where(F.col("n") >= least).select("ctx")  # `most` rows at most
        own = listed.join(F.broadcast(own), F.shiftright("key", 8) == F.col("ctx")).orderBy("key")
        return *_arrays(own, "key", "n"), least == 0.0

    four = staged(shortened(grams, 4), "lm-short")
    three = staged(shortened(four, 3), "lm-shorter")
    key4, n4, all4 = of_frequent(four, CONTEXTS, None)
    key3, n3 = _arrays(three.orderBy("key"), "key", "n")  # at most 2^24 rows
    key6, n6, all6 = of_frequent(grams, LISTED, F.col("d"))
    model = PpmModel(key4.astype(np.uint32), n4, key3.astype(np.uint32), n3, key6.astype(np.uint64), n6, (all4, all6))
    del key4, n4, key3, n3, key6, n6
    end = float(np.log10((texts + 0.5) / divisor))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept], held_out(ident).alias("held_out")).alias("row"),
                         F.col(text).alias("_text"))
    kind = packed.schema["row"].dataType.simpleString()
    scored = staged(packed.mapInArrow(lambda b: _score(b, model, frequent, logs, end), f"row {kind}, {_SCORED}"), "lm-scores")
    rare = (scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("w"))
                  .select("uid", F.col("w.rare").alias("key"), F.col("w.times").alias("times")))
    rest = words.where(F.col("n") < least).select(F.col("key").alias("c_key"), F.col("n").alias("c"))
    rare = rare.join(rest, F.col("key") == F.col("c_key"), "left")
    value = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(divisor)) * F.col("times")
    rare = rare.select("uid", value.alias("more"), F.when(F.col("c") > 0, F.col("times")).alias("found"),
                       F.lit(None).cast("double").alias("longer"))
    if not (all4 and all6):
        left = (scored.select("uid", F.explode(F.arrays_zip("open", "open_times")).alias("g"))
                      .select("uid", F.col("g.open").alias("key"), F.col("g.open_times").alias("times")))
        values = _joined(left.select("key").distinct(), grams, four, three, model.shorter())
        left = left.join(values, F.col("key") == F.col("v_key"))
        rare = rare.unionAll(left.select("uid", F.lit(None).cast("double"), F.lit(None).cast("long"),
                                         (F.col("value") * F.col("times")).alias("longer")))
    rare = rare.groupBy("uid").agg(F.sum("more").alias("more"), F.sum("found").alias("found"), F.sum("longer").alias("longer"))
    return scored.select("uid", "row", "n_tokens", "n_known", "base", "score").join(
        rare.withColumnRenamed("uid", "r_uid"), F.col("uid") == F.col("r_uid"), "left").select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("row.held_out").alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0)) - F.lit(0 if texts else 1)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("longer", F.lit(0.0))).alias("score"))
