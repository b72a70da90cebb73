"""Personal data: exact rules and a character-level bidirectional LSTM with a CRF on top.

The network reads windows of characters; CRF transitions over begin/inside tags of four kinds decode each window. It
is trained here, in numpy, from generated sentences with labelled spans that go beyond the rules (phones without a
plus, spelled-out mail addresses, cards in odd groups) and from numbers that are nothing personal. Windows overlap by
half; each character takes its tag from the window whose middle is nearest, and spans are read from the joined tags of
the whole text, so none is cut at a window border.

All labelled kinds hold a digit or "@", so windows without either carry no tag; every text is covered.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
N_TAGS = 1 + 2 * len(KINDS)  # 0 none, 2k+1 begins kind k, 2k+2 continues it
WINDOW, STEP = 64, 32
CHARS, EMBED, HIDDEN = 129, 12, 16
# Training: windows in a batch, batches, rate, characters of generated text; the seed makes every run alike.
BATCH, STEPS, RATE, SAMPLE, SEED = 64, 300, 0.015, 150_000, 20240501
# A decoded span is kept from this mean posterior of its tags.
CONFIDENCE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, leftmost and non-overlapping per kind, by kind, then start.

    Mail addresses are looked for from each "@" outwards, and addresses of four numbers only where a number begins,
    which gives the leftmost matches in time linear in the text.
    """
    spans, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = _DOMAIN.match(text, at + 1) if start < at else None
        if after:
            spans.append((0, start, after.end()))
            done = after.end()
        at = text.find("@", max(at + 1, done))
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) < 12 and int(p) <= 255 for p in (
        x.lstrip("0") or "0" for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        own = _digits(m[0])
        if 16 <= len(own) <= 19 and _luhn(own):
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


# Labelled training windows.

def _word(rng: random.Random) -> str:
    word = "".join(rng.choices("etaoinshrdlucmfwypvbgkäöüéèñ", k=rng.randint(2, 9)))
    word = word.capitalize() if rng.random() < 0.15 else word.upper() if rng.random() < 0.05 else word
    return word + rng.choice(["", "", "", "", "", ".", ",", "!!", "&&&", "###", " |", "***"])


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _personal(rng: random.Random, kind: int) -> str:
    pick, name = rng.choice, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
    if kind == 0:
        local = pick([name, f"{name}.{_number(rng, 2)}", f"{name}_{_number(rng, 1)}", _number(rng, 2), f"{name}+x"])
        host = pick(["mail", "example", "post", f"mail{_number(rng, 1)}.example", "web-host"])
        return (local + pick(["@", "@", "@", " @ ", "(@)"]) + host + pick([".", ".", ".", " . "])
                + pick(["com", "org", "net", "de", "fr", "es"]))
    if kind == 1:
        return pick([".", ".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        return pick(["", " ", "-", "."]).join(_number(rng, 4) for _ in range(4)) + pick(["", "", _number(rng, 2)])
    area, a, b = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return pick([f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"+{_number(rng, 2)} {area} {a} {b}", f"{area}-{a}-{b}",
                 f"+{_number(rng, 11)}", f"00{_number(rng, 2)} {area} {a}{b}", f"{area}.{a}.{b}"])


def _plain(rng: random.Random) -> str:
    n = [_number(rng, k) for k in (1, 2, 3, 4)]
    return rng.choice([n[3], f"{n[1]}.{n[1]}", f"{n[0]}.{n[0]}.{n[1]}", f"{n[3]}-{n[1]}-{n[1]}", f"{n[1]}:{n[1]}",
                       f"${n[2]}.{n[1]}", f"{n[1]}%", f"({n[3]})", f"v{n[0]}.{n[0]}", f"@{_word(rng)}", f"#{n[2]}",
                       f"{n[2]},{n[2]}", f"http://{_word(rng)}/{n[2]}", f"{n[0]}/{n[1]}", "2.0.", f"+{n[1]}", f"2^{n[1]}",
                       "".join(rng.choices("0123456789abcdef", k=32)), f"x = {n[2]}"])


@functools.cache
def labelled_text(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(character ids, tags) of generated text of about `size` characters with personal and plain numbers in it."""
    rng, pieces, tags, length = random.Random(seed), [], [], 0
    while length < size:
        roll, kind = rng.random(), rng.randrange(len(KINDS))
        piece = _personal(rng, kind) if roll < 0.1 else _plain(rng) if roll < 0.2 else _word(rng)
        tag = [2 * kind + 1] + [2 * kind + 2] * (len(piece) - 1) if roll < 0.1 else [0] * len(piece)
        after = "" if roll < 0.007 else "\n" if rng.random() < 0.05 else " "
        pieces.append(piece + after)
        tags += tag + [0] * len(after)
        length += len(piece) + len(after)
    return char_ids("".join(pieces)), np.array(tags)


def training_windows(rng: np.random.Generator, n: int, size: int = SAMPLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(character ids, tags) of n windows cut at random places out of the generated text."""
    ids, tags = labelled_text(size, seed)
    spot = rng.integers(0, len(ids) - WINDOW, n)[:, None] + np.arange(WINDOW)
    return ids[spot], tags[spot]


def char_ids(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), CHARS - 1).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class BiLstmCrf:
    """Parameters and passes of the tagger; all arrays are float32 or float64 numpy."""

    def __init__(self, rng: np.random.Generator):
        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {"embed": normal(CHARS, EMBED) * 3, "out": normal(2 * HIDDEN, N_TAGS), "out_b": np.zeros(N_TAGS),
                  "move": np.zeros((N_TAGS, N_TAGS)), "first": np.zeros(N_TAGS)}
        for way in "fb":
            self.p[f"x{way}"], self.p[f"h{way}"] = normal(EMBED, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN: 2 * HIDDEN] = 1.0
            self.p[f"b{way}"] = bias

    def _run(self, ids: np.ndarray, way: str, keep: bool):
        """Hidden states (time, row, HIDDEN) in text order, and what the backward pass needs."""
        p, n, steps = self.p, len(ids), ids.shape[1]
        inputs = (p["embed"] @ p[f"x{way}"] + p[f"b{way}"])
        h = c = np.zeros((n, HIDDEN), inputs.dtype)
        hidden, saved = np.zeros((steps, n, HIDDEN), inputs.dtype), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[ids[:, t]] + h @ p[f"h{way}"]
            gate = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN: 2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c = c, f * c + i * g
            s = np.tanh(c)
            if keep:
                saved.append((t, i, f, o, g, before, s, h))
            h = o * s
            hidden[t] = h
        return hidden, saved

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(ids, "f", False)[0], self._run(ids, "b", False)[0]], axis=2)
        return both @ self.p["out"] + self.p["out_b"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tags, their posteriors) of each window, by Viterbi and forward-backward."""
        e, move, first = self.emissions(ids), self.p["move"], self.p["first"]
        steps, n, _ = e.shape
        best, back = first + e[0], np.zeros((steps, n, N_TAGS), np.int8)
        for t in range(1, steps):
            way = best[:, :, None] + move
            back[t] = way.argmax(axis=1)
            best = np.take_along_axis(way, back[t][:, None].astype(np.int64), axis=1)[:, 0] + e[t]
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        sure = np.ones((n, steps))
        some = np.flatnonzero(tags.any(axis=1))  # posteriors matter only where a span was found
        if len(some):
            gamma = self._posteriors(e[:, some])[0]
            sure[some] = np.take_along_axis(gamma, tags[some].T[:, :, None], axis=2)[:, :, 0].T
        return tags, sure

    def _posteriors(self, e: np.ndarray):
        move, steps = self.p["move"], len(e)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = self.p["first"] + e[0]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        norm = _logsum(alpha[-1], 1)
        return np.exp(alpha + beta - norm[:, None]), alpha, beta, norm

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log-likelihood of the tags."""
        p, n, steps = self.p, len(ids), ids.shape[1]
        runs = {way: self._run(ids, way, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = both @ p["out"] + p["out_b"]
        gamma, alpha, beta, norm = self._posteriors(e)
        gold = np.eye(N_TAGS)[tags.T]
        d_e = (gamma - gold) / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["first"] = d_e[0].sum(axis=0)
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + p["move"] + (e[t] + beta[t])[:, None, :] - norm[:, None, None])
            g["move"] += (pair.sum(axis=0) - gold[t - 1].T @ gold[t]) / n
        g["out"] = np.einsum("tnh,tnk->hk", both, d_e)
        g["out_b"] = d_e.sum(axis=(0, 1))
        d_both = d_e @ p["out"].T
        for way, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
            d_h = d_c = np.zeros((n, HIDDEN))
            d_zs = np.zeros((steps, n, 4 * HIDDEN))
            for t, i, f, o, gg, before, s, h in reversed(runs[way][1]):
                d_h = d_h + part[t]
                d_c = d_c + d_h * o * (1 - s * s)
                d_z = np.concatenate([d_c * gg * i * (1 - i), d_c * before * f * (1 - f), d_h * s * o * (1 - o),
                                      d_c * i * (1 - gg * gg)], axis=1)
                g[f"h{way}"] += h.T @ d_z
                g[f"b{way}"] += d_z.sum(axis=0)
                d_zs[t] = d_z
                d_h, d_c = d_z @ p[f"h{way}"].T, d_c * f
            flat = ids.T.ravel()
            order = np.argsort(flat, kind="stable")
            used, first = np.unique(flat[order], return_index=True)
            own = np.zeros((CHARS, 4 * HIDDEN))
            own[used] = np.add.reduceat(d_zs.reshape(-1, 4 * HIDDEN)[order], first, axis=0)
            g[f"x{way}"] = p["embed"].T @ own
            g["embed"] += own @ p[f"x{way}"].T
        return g


@functools.cache
def trained() -> BiLstmCrf:
    """The tagger after STEPS batches of generated windows, by Adam with a decaying rate; the same in every process."""
    rng = np.random.default_rng(SEED)
    model = BiLstmCrf(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        g = model.gradients(*training_windows(rng, BATCH))
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def _windows(ids: np.ndarray) -> list[int]:
    """Starts of the windows of a text that hold a digit or "@"."""
    cue = np.flatnonzero(((ids >= 48) & (ids < 58)) | (ids == 64))
    own = {int(w) for c in np.unique(cue // STEP) for w in (c - 1, c) if w >= 0}
    return [w * STEP for w in sorted(own)]


def _spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the tagged runs of a text that are confident enough."""
    out, t, n = [], 0, len(tags)
    marked = np.flatnonzero(tags)
    i = 0
    while i < len(marked):
        t = int(marked[i])
        kind = (int(tags[t]) - 1) // 2
        end = t + 1
        while end < n and tags[end] == 2 * kind + 2:
            end += 1
        if sure[t:end].mean() >= CONFIDENCE:
            out.append((kind, t, end))
        i = int(np.searchsorted(marked, end))
    return out


def _plausible(kind: int, text: str) -> bool:
    digits = len(_digits(text))
    return (("@" in text and "." in text and len(text) >= 6) if kind == 0 else 4 <= digits <= 12 if kind == 1
            else 16 <= digits <= 19 and _luhn(_digits(text)) if kind == 2 else 8 <= digits <= 15)


def model_spans(texts: list[str], model: BiLstmCrf) -> list[list[tuple[int, int, int]]]:
    """Spans of the tagger for each text, windows decoded together and reconciled over the whole text."""
    jobs, ids = [], []
    for k, text in enumerate(texts):
        ids.append(char_ids(text))
        jobs += [(k, s) for s in _windows(ids[-1])]
    tags = [np.zeros(len(x), np.int8) for x in ids]
    sure = [np.ones(len(x), np.float32) for x in ids]
    edge = (WINDOW - STEP) // 2
    known = set(jobs)
    while jobs:
        touched = []
        for a in range(0, len(jobs), 4096):
            part = jobs[a: a + 4096]
            block = np.full((len(part), WINDOW), 32)
            for r, (k, s) in enumerate(part):
                own = ids[k][s: s + WINDOW]
                block[r, : len(own)] = own
            best, post = model.decode(block)
            for r, (k, s) in enumerate(part):
                n = len(ids[k])
                lo = s + edge if s else 0
                # the middle is this window's; the first also owns its edge, the last unless a later one was decoded
                hi = n if s + WINDOW >= n and (k, s + STEP) not in known else min(n, s + WINDOW - edge)
                tags[k][lo:hi] = best[r, lo - s: hi - s]
                sure[k][lo:hi] = post[r, lo - s: hi - s]
                if lo < hi:  # a tagged run goes on in the neighbour window until it ends
                    touched += [(k, s - STEP)] * bool(s and tags[k][lo]) + [(k, s + STEP)] * bool(hi < n and tags[k][hi - 1])
        jobs = sorted(set(touched) - known)
        known.update(jobs)
    out = []
    for k, text in enumerate(texts):
        found = []
        for kind, a, b in _spans(tags[k], sure[k]):
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if _plausible(kind, text[a:b]):
                found.append((kind, a, b))
        out.append(found)
    return out


def _scan(batches: Iterator[pa.RecordBatch], model: BiLstmCrf) -> Iterator[pa.RecordBatch]:
    cue = np.zeros(256, bool)
    cue[[64, *range(48, 58)]] = True
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.bool_())]))
    for batch in batches:
        for part in slices(batch, "_text"):
            buf, offsets = text_bytes(part.column("_text"))
            marks = np.concatenate([[0], np.cumsum(cue[buf])])
            some = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
            texts = [part.column("_text")[int(i)].as_py() for i in some]
            spans: list[list] = [[] for _ in range(part.num_rows)]
            for i, text, more in zip(some.tolist(), texts, model_spans(texts, model)):
                base = rule_spans(text)
                taken = sorted((a, b) for _, a, b in base)
                free = [(k, a, b) for k, a, b in more if not any(x < b and a < y for x, y in taken)]
                spans[i] = sorted([(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in free])
            out = [[{"kind": KINDS[k], "start": a, "end": b, "rule": r} for k, a, b, r in x] for x in spans]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, kind_type)], ["row", "spans"])


def find_personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows (columns `keep`, default all) with `spans`: array of (kind, start, end, rule), by kind, then start.

    `rule` tells matches of the exact rules from spans that only the tagger found; the latter never overlap the
    former. Places count characters, end exclusive. Null and empty texts have no spans; repeated rows are scanned
    alike; no rows give no rows; an input column called spans is replaced. Nothing is shuffled.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c != "spans"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("_text"))
    kinds, model = packed.schema["row"].dataType.simpleString(), trained()
    found = packed.mapInArrow(lambda b: _scan(b, model),
                              f"row {kinds}, spans array<struct<kind:string,start:bigint,end:bigint,rule:boolean>>")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "spans")
