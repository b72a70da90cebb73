"""Secret scans with one automaton for all rules.

Rule expressions are compiled together: positions of a nondeterministic automaton, subset construction over byte
classes, minimisation, and one transition array. The arrays run over every byte of every text once, many text stretches
side by side, and leave for each byte the rules that accept there; a stretch lies between bytes that send every state back
to the start, so no match crosses its ends.

Spans follow from the accepting bytes. Every rule ends in a repeated class (or in a fixed text), so a greedy match ends
where a run of accepting bytes does, the length of the run is the count of the repeated class, and the match begins where
the same automaton of the rule's first part, read backwards from the run, accepts last.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices, text_bytes

# Kind, expression, what a match must satisfy. The first three are the base rules, in their order.
RULES = {
    "assign": (r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "value", 6),
    "access": (r"AKIA[A-Z0-9]+", "match", 20),
    "hex": (r"[0-9a-f]+", "match", 24),
    "hosting": (r"gh[pousr]_[A-Za-z0-9]+", "match", 34),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", "match", 15),
    "maps": (r"AIza[A-Za-z0-9_-]+", "match", 39),
    "payment": (r"[rs]k_live_[A-Za-z0-9]+", "match", 24),
    "bearer": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "match", 30),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "match", 0),
}
BASE = ("assign", "access", "hex")


class _Nfa:
    """Positions with byte-set moves and empty moves, built from parsed expressions."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, fold: bool = False) -> int:
        """Extend from `start` by the parsed expression; the state reached."""
        for op, arg in tree:
            if op in (sre.LITERAL, sre.IN):
                chars = {arg} if op is sre.LITERAL else self._members(arg)
                if fold:
                    chars |= {ord(c) for x in chars for c in (chr(x).lower(), chr(x).upper())}
                end = self.state()
                self.moves[start].append((frozenset(chars), end))
            elif op is sre.SUBPATTERN:
                end = self.add(arg[3], start, fold or bool(arg[1] & re.IGNORECASE))
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.empty[self.add(branch, start, fold)].append(end)
            elif op is sre.MAX_REPEAT:
                low, high, body = arg
                end = start
                for _ in range(low):
                    end = self.add(body, end, fold)
                if high is sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[end].append(loop)
                    self.empty[self.add(body, loop, fold)].append(loop)
                    end = loop
                else:
                    out = self.state()
                    for _ in range(high - low):
                        self.empty[end].append(out)
                        end = self.add(body, end, fold)
                    self.empty[end].append(out)
                    end = out
            else:
                raise ValueError(f"rule expressions cannot hold {op}")
            start = end
        return start

    @staticmethod
    def _members(items) -> set[int]:
        chars: set[int] = set()
        for op, arg in items:
            chars |= {arg} if op is sre.LITERAL else set(range(arg[0], arg[1] + 1))
        return chars

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton that searches all expressions at once.

    `klass` maps bytes to classes, `table` (state * n_classes + class) to the next state times n_classes, `fired`
    a state to the bits of the expressions that end there; `reset` marks bytes after which only the start remains.
    """

    def __init__(self, expressions: list[str]):
        nfa = _Nfa()
        start = nfa.state()
        ends = {nfa.add(sre_parser.parse(e), start): i for i, e in enumerate(expressions)}
        sets = {chars for moves in nfa.moves for chars, _ in moves}
        marks = [tuple(b in s for s in sets) for b in range(256)]
        classes = {m: k for k, m in enumerate(dict.fromkeys(marks))}
        self.klass = np.array([classes[m] for m in marks], np.int32)
        sample = {k: b for b, k in reversed(list(enumerate(self.klass.tolist())))}
        # subsets are bit masks; each position's moves are closed over beforehand
        def mask(states) -> int:
            return sum(1 << t for t in nfa.closure(states))

        moves = [[mask([t for chars, t in nfa.moves[s] if sample[k] in chars]) for k in range(len(classes))] for s in range(len(nfa.moves))]
        begin = mask([start])
        names, rows, todo = {begin: 0}, [], [begin]
        while todo:
            now, row = todo.pop(), [begin] * len(classes)
            for s in range(now.bit_length()):
                if now >> s & 1:
                    row = [m | to for m, to in zip(row, moves[s])]
            for to in row:
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
            rows.append((names[now], [names[to] for to in row]))
        table = np.array([row for _, row in sorted(rows)])
        fired = np.array([sum(1 << i for s, i in ends.items() if x >> s & 1) for x in names], np.int64)
        part = np.unique(fired, return_inverse=True)[1]
        while True:  # refine until equal rows stay together
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        order = {p: i for i, p in enumerate(dict.fromkeys(part.tolist()))}  # the start keeps number 0
        part = np.array([order[p] for p in part.tolist()])
        lead = np.unique(part, return_index=True)[1]
        self.n_classes = len(classes)
        after = part[table[lead]]
        self.fired = fired[lead].astype(np.int16)
        self.reset = (after == 0).all(axis=0)[self.klass]
        self.table = (after * self.n_classes).ravel().astype(np.int32)

    def accepting(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For every byte of the texts the bits of the expressions that end there."""
        inside = ~self.reset[buf]
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(buf))]
        head[borders] = inside[borders]
        tail[borders - 1] = inside[borders - 1]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        order = np.argsort(start - end, kind="stable")  # longest first
        at, length = start[order], (end - start)[order]
        out = np.zeros(len(buf), np.int16)
        state = np.zeros(len(at), np.int32)
        code, fired = self.klass[buf], np.repeat(self.fired, self.n_classes)  # by entry of the table
        active = len(at)
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length[:active], -t, "left"))  # those longer than t
            here = at[:active] + t
            now = self.table.take(state[:active] + code.take(here))
            state[:active] = now
            out[here] = fired.take(now)
        return out


class _Lazy:
    """One expression as an automaton whose subsets are made when they are met; few bytes come here."""

    def __init__(self, tree, search: bool):
        self.nfa = _Nfa()
        begin = self.nfa.state()
        self.end = self.nfa.add(tree, begin)
        self.start = self.nfa.closure([begin])
        self.search, self.known = search, {}

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        key = states, byte
        if key not in self.known:
            to = self.nfa.closure({t for s in states for chars, t in self.nfa.moves[s] if byte in chars})
            self.known[key] = to | self.start if self.search else to
        return self.known[key]


def _backwards(tree) -> list:
    """The parsed expression of all matches read from their end."""
    out = []
    for op, arg in reversed(list(tree)):
        if op is sre.SUBPATTERN:
            arg = (*arg[:3], _backwards(arg[3]))
        elif op is sre.BRANCH:
            arg = (arg[0], [_backwards(b) for b in arg[1]])
        elif op is sre.MAX_REPEAT:
            arg = (*arg[:2], _backwards(arg[2]))
        out.append((op, arg))
    return out


class _Rule:
    def __init__(self, expression: str, what: str, least: int):
        tree = list(sre_parser.parse(expression))
        op, arg = tree[-1]
        self.repeats = op is sre.MAX_REPEAT or (op is sre.SUBPATTERN and arg[3][-1][0] is sre.MAX_REPEAT)
        self.what, self.least = what, least
        self.forward = _Lazy(tree, search=True)
        self.back = _Lazy(_backwards(tree[:-1] if self.repeats else tree), search=False)

    def begin(self, text: bytes, stop: int, low: int) -> int | None:
        """Leftmost place from `low` on where the part before `stop` can begin."""
        states, found = self.back.start, None
        for k in range(stop, low - 1, -1):
            if self.back.end in states:
                found = k
            if k == low:
                break
            states = self.back.step(states, text[k - 1])
            if not states:
                break
        return found

    def span(self, text: bytes, first: int, end: int, low: int) -> tuple[int, int] | None:
        """(start, first accepting byte) of the leftmost match from `low` on that ends where the run [first, end) does."""
        start = self.begin(text, first if self.repeats else end, low)
        if start is None and self.repeats:
            # what began the run overlaps the match before; search on behind that one
            states = self.forward.start
            for k in range(low, end):
                states = self.forward.step(states, text[k])
                if self.forward.end in states:
                    start, first = self.begin(text, k, low), k
                    break
        return None if start is None else (start, first)


@functools.cache
def automaton() -> Automaton:
    return Automaton([e for e, _, _ in RULES.values()])


@functools.cache
def _rules() -> list[_Rule]:
    return [_Rule(*rule) for rule in RULES.values()]


def _spans(buf: np.ndarray, offsets: np.ndarray, machine: Automaton) -> list[tuple[int, int, int, int]]:
    """(text, start, rule, end) of all matches, in bytes of the buffer."""
    accepting, out, text = machine.accepting(buf, offsets), [], buf.tobytes()
    for r, rule in enumerate(_rules()):
        on = np.flatnonzero(accepting & (1 << r))
        if not len(on):
            continue
        new = np.ones(len(on), bool)
        new[1:] = on[1:] != on[:-1] + 1
        new |= np.isin(on, offsets[:-1])  # a run does not go on into the next text
        first = on[new]
        end = np.append(on[np.flatnonzero(new)[1:] - 1], on[-1]) + 1
        doc = np.searchsorted(offsets, first, "right") - 1
        if not rule.back.nfa.moves[0]:  # the class alone: a match is a run
            long = end - first >= rule.least
            out += zip(doc[long].tolist(), first[long].tolist(), [r] * int(long.sum()), end[long].tolist())
            continue
        last, low = -1, 0
        for d, a, b in zip(doc.tolist(), first.tolist(), end.tolist()):
            if d != last:
                last, low = d, int(offsets[d])
            found = rule.span(text, a, b, low)
            if found:
                low = b
                if b - (found[1] if rule.what == "value" else found[0]) >= rule.least:
                    out.append((d, found[0], r, b))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch], machine: Automaton) -> Iterator[pa.RecordBatch]:
    kinds = list(RULES)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "_text"):
            buf, offsets = text_bytes(part.column("_text"))
            out: list[list[dict]] = [[] for _ in range(part.num_rows)]
            found = _spans(buf, offsets, machine)
            points = np.zeros(len(buf) + 1 if found else 0, np.int64)  # characters before each byte
            if found:
                np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
            for d, a, r, b in found:
                base = points[offsets[d]]
                out[d].append({"kind": kinds[r], "start": int(points[a] - base), "end": int(points[b] - base)})
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, kind_type)], ["row", "spans"])


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows (columns `keep`, default all) with `spans`: array of (kind, start, end), by start, then rule order.

    Places count characters, end exclusive. Matches of a rule are leftmost and do not overlap; those that fail its
    length are dropped. Null and empty texts have no spans; repeated rows are scanned alike; no rows give no rows;
    an input column called spans is replaced. Nothing is shuffled.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c != "spans"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("_text"))
    kinds = packed.schema["row"].dataType.simpleString()
    machine = automaton()  # compiled here once, some three megabytes that travel with the tasks
    found = packed.mapInArrow(lambda b: _scan(b, machine), f"row {kinds}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
