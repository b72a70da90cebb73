"""Conversation structure repair by iterative-deepening A*.

A conversation should run `(s?(ua)+)?` in role initials. Edits turn its rows into such a run: Keep, Rerole (to user or
assistant), Delete, Insert (an empty user or assistant turn). The search for the cheapest edits is depth-first in ASCII
order of the edits' initials under a growing bound of cost. A place and role state from which a remaining budget did not
suffice stays in a table of failures, which lasts over all bounds, so no state is opened twice with one budget. The
first path that is accepted is thus the cheapest and, among equals, the least in ASCII.

The estimate of remaining cost looks at LOOK rows at a time and forgets the role state between them; it never exceeds the
true cost. Conversations are searched in segments of SEGMENT rows. A segment of a longer conversation gives its best path
for each state before and after it, and a fold over the segments picks among these, so a conversation that holds a third
of all rows is searched by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ordered import joined_safely, row_index
from ..session import staged

# Rows searched at once, and rows the cost estimate looks at together.
SEGMENT, LOOK = 512, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# Role states: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_INITIALS, _FAULTS = "sua-", "-bdt"  # of a row: role initial (or other), first fault: none, blank, duplicate, truncated
_FAR = 1 << 40


def _moves(initial: str, fault: str) -> list[list[tuple[str, int, int, int]]]:
    """Per state, the edits at a row in ASCII order: (step, rows taken, next state, cost).

    Steps are d (Delete), u and a (Insert), k (Keep), U and A (Rerole).
    """
    out = []
    for state in range(4):
        new = "a" if state == _USER else "u"
        then = _AFTER[state, new]
        extra = TRUNCATED if fault == "t" else 0
        edits = [("d", 1, state, DELETE), (new, 0, then, INSERT)]
        if fault not in "bd":
            if (state, initial) in _AFTER:
                edits.append(("k", 1, _AFTER[state, initial], KEEP + extra))
            edits.append((new.upper(), 1, then, REROLE + extra))
        out.append(edits)
    return out


# One letter a row: 4 initials x 4 faults.
_CODES = {chr(65 + 4 * i + f): (initial, fault) for i, initial in enumerate(_INITIALS) for f, fault in enumerate(_FAULTS)}
_MOVES = {code: _moves(*row) for code, row in _CODES.items()}
_ENDING = [[m for m in edits if not m[1]] for edits in _moves("-", "-")]
_AUDIT = ("duakUA", "DIIKRR")


def _closed(costs: list[int]) -> list[int]:
    """Costs of the four states once insertions are allowed before them."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_ENDING[s][0][2]]) for s, c in enumerate(costs)]
    return costs


class Search:
    """Cheapest edits over a run of rows that end in one of the states `exits`."""

    def __init__(self, codes: str, exits: tuple[int, ...]):
        self.codes, self.exits, n = codes, exits, len(codes)
        self.failed = [-1] * (4 * n + 4)
        self.least = [_FAR] * (4 * n + 4)
        ahead = _closed([0 if s in exits else _FAR for s in range(4)])
        self.least[4 * n:] = ahead
        for i in range(n - 1, -1, -1):
            if (n - 1 - i) % LOOK == 0 and i < n - 1:
                ahead = [min(ahead)] * 4  # the state is forgotten here
            ahead = _closed([min((m[3] + ahead[m[2]] for m in _MOVES[codes[i]][s] if m[1]), default=_FAR) for s in range(4)])
            self.least[4 * i: 4 * i + 4] = ahead

    def path(self, entry: int) -> tuple[int, str] | None:
        """(cost, steps) from the state `entry`; None where no edits lead to an exit."""
        late = entry in (_USER, _ASSISTANT)
        reach = {_USER, _ASSISTANT} | ({_START} if entry == _START else set())
        if not late and (entry == _SYSTEM or any(_CODES[c][0] == "s" and _CODES[c][1] in "-t" for c in self.codes)):
            reach.add(_SYSTEM)
        if not reach & set(self.exits):
            return None
        bound = self.least[entry]
        while (steps := self._within(entry, bound)) is None:
            bound += 1
        return bound, steps

    def _within(self, entry: int, budget: int) -> str | None:
        codes, failed, least, n, done = self.codes, self.failed, self.least, len(self.codes), []
        stack = [(0, entry, budget, iter(_MOVES[codes[0]][entry] if n else _ENDING[entry]))]
        while stack:
            i, state, left, edits = stack[-1]
            if i == n and state in self.exits:
                return "".join(done)
            for step, taken, then, cost in edits:
                at, rest = 4 * (i + taken) + then, left - cost
                if rest >= least[at] and rest > failed[at]:
                    done.append(step)
                    stack.append((i + taken, then, rest, iter(_MOVES[codes[i + taken]][then] if i + taken < n else _ENDING[then])))
                    break
            else:
                failed[4 * i + state] = max(failed[4 * i + state], left)
                stack.pop()
                if done:
                    done.pop()
        return None


def _audit(steps: str) -> str:
    return steps.translate(str.maketrans(*_AUDIT))


@lru_cache(maxsize=50_000)
def _whole(codes: str) -> tuple[int, str]:
    return Search(codes, (_START, _ASSISTANT)).path(_START)


@lru_cache(maxsize=2_000)
def _parts(codes: str, first: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, steps) of the best path for each pair of states around a segment."""
    found = []
    for end in range(4):
        search = Search(codes, (end,))
        for entry in (_START,) if first else range(4):
            best = search.path(entry)
            if best:
                found.append((entry, end, *best))
    return found


def _search_segments(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """The paths of each segment; a conversation in one segment has only its answer."""
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("steps", pa.string())]))
    for batch in batches:
        out = []
        for seg, codes in zip(batch.column("seg").to_pylist(), batch.column("codes").to_pylist()):
            found = ([(_START, _ASSISTANT, *_whole(codes))] if seg == 0 and len(codes) < segment else _parts(codes, seg == 0))
            out.append([dict(zip(("entry", "leave", "cost", "steps"), f)) for f in found])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "found"])


class _Fold:
    """Best paths up to each state over the segments of one conversation.

    Of two paths it is enough to keep how their audits compare: decided, or one a beginning of the other with the rest
    of the longer one. So no audit of all rows is ever copied or compared again.
    """

    def __init__(self):
        self.costs, self.origin = {_START: 0}, []
        self.order: dict[tuple[int, int], int | tuple[str, str]] = {}

    def _compare(self, a: tuple, b: tuple) -> int | tuple[str, str]:
        (p, x), (q, y) = a, b
        if p != q:
            known = self.order[p, q]
            if isinstance(known, int):
                return known
            x, y = known[0] + x, known[1] + y
        k = next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
        if k == len(x) or k == len(y):
            return x[k:], y[k:]
        return -1 if x[k] < y[k] else 1

    def _before(self, a: tuple, b: tuple) -> bool:
        order = self._compare(a, b)
        return order < 0 if isinstance(order, int) else len(order[0]) < len(order[1])

    def add(self, found: list[dict]) -> None:
        best: dict[int, tuple[int, tuple, str]] = {}
        for f in found:
            if f["entry"] in self.costs:
                cost, way = self.costs[f["entry"]] + f["cost"], (f["entry"], _audit(f["steps"]))
                old = best.get(f["leave"])
                if old is None or cost < old[0] or (cost == old[0] and self._before(way, old[1])):
                    best[f["leave"]] = (cost, way, f["steps"])
        self.order = {(a, b): self._compare(best[a][1], best[b][1]) for a in best for b in best if a != b}
        self.costs = {state: b[0] for state, b in best.items()}
        self.origin.append({state: (b[1][0], b[2]) for state, b in best.items()})

    def steps(self) -> list[str]:
        """Steps of each segment on the best path to an accepting state."""
        ends = [s for s in (_START, _ASSISTANT) if s in self.costs]
        state = min(ends, key=lambda s: self.costs[s])
        other = next((s for s in ends if s != state), None)
        if other is not None and self.costs[other] == self.costs[state] and self._before((other, ""), (state, "")):
            state = other
        out = []
        for origin in reversed(self.origin):
            state, steps = origin[state]
            out.append(steps)
        return out[::-1]


def _items(steps: str) -> list[str]:
    """Steps cut behind each row's own; insertions at the end go with the last row."""
    out, held = [], ""
    for c in steps:
        held += c
        if c not in "ua":
            out.append(held)
            held = ""
    if held:
        out[-1:] = [(out[-1] if out else "") + held]
    return out


def _cost(steps: str, codes: str) -> int:
    paid, row = 0, 0
    for c in steps:
        if c in "ua":
            paid += INSERT
            continue
        paid += DELETE if c == "d" else (KEEP if c == "k" else REROLE) + (TRUNCATED if _CODES[codes[row]][1] == "t" else 0)
        row += 1
    return paid


def _fold_segments(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row per segment, from rows sorted by conversation and segment: the chosen steps, cost and counts."""
    names = ["conv_id", "seg", "items", "steps", "cost", "blank", "duplicate", "truncated", "illegal"]
    types = [key_type, pa.int64(), pa.list_(pa.string()), pa.string(), *[pa.int64()] * 5]

    def rows(key, segments: list[tuple[int, str]], fold: _Fold) -> Iterator[list]:
        last = ""
        for (seg, codes), steps in zip(segments, fold.steps()):
            roles = last + "".join(_CODES[c][0] for c in codes)
            faults = [_CODES[c][1] for c in codes]
            illegal = sum(roles[k: k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
            yield [key, seg, _items(steps), steps, _cost(steps, codes), *(faults.count(f) for f in "bdt"), illegal]
            last = roles[-1:]

    def packed(ready: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], t) for k, t in enumerate(types)], names)

    key, segments, fold, ready = None, [], None, []
    for batch in batches:
        for now, seg, codes, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "codes", "found"))):
            if segments and (now != key or seg == 0):
                ready.extend(rows(key, segments, fold))
                segments = []
            if not segments:
                key, fold = now, _Fold()
            segments.append((seg, codes))
            fold.add(found)
            if len(ready) >= 2_000:
                yield packed(ready)
                ready = []
    if segments:
        ready.extend(rows(key, segments, fold))
    if ready:
        yield packed(ready)


def _digests(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha256 of the lines joined by newlines) from rows sorted by conversation; a line at a time is held."""
    key, digest, done = None, None, []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key_type), pa.array([d[1] for d in done])],
                                          ["conv_id", "digest"])

    for batch in batches:
        for now, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if digest is None or now != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = now, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        if done:
            yield packed()
            done = []
    if digest is not None:
        done.append((key, digest.hexdigest()))
        yield packed()


def _in_order(df: DataFrame, order: list[str], work: Callable, schema: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(work, schema)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows damaged by a hash of `conv_id:turn`.

    Of twenty values 0 drops a row, 1 empties its text, 2 removes `[.!?]`, 3 repeats it and 4 makes it a user's. Nulls
    count as one space (in the hash, too), but a null turn stays null.
    """
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(filled("role")).alias("role"), text.alias("text"),
                       fault.alias("_fault"), F.explode(copies).alias("_copy")).where("_fault != 0").drop("_fault", "_copy")


def repair(rows: DataFrame, segment: int = SEGMENT, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, reports) of rows (conv_id, turn, role, text).

    turns: conv_id, pos, part, role, text of the repaired conversations in order (pos, part); inserted turns are empty.
    reports, one row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows count by turn, null turns first, then by role and text; null roles and texts count as one space. A row's first
    fault counts: blank, duplicate of an earlier role and text, or not ended by one of `.!?`. Roles are told by their
    initial; one that is empty or none of s, u, a fits nowhere and must be changed or deleted. A null conv_id is a
    conversation of its own, repeated rows are duplicates, other columns are not read, no rows give no rows.
    """
    key_type = rows.schema["conv_id"].dataType
    key, arrow_key = key_type.simpleString(), to_arrow_type(key_type)
    filled = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    numbered = row_index(filled, ["conv_id"], ["turn", "role", "text"], "pos", hot_rows)
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    # the last character that is not a blank
    ended = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    blank = F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == ""
    numbered = staged(numbered.select("conv_id", "pos", "turn", "role", "text", said.alias("said"), blank.alias("is_blank"),
                                      ended.alias("ended")), "turns")
    # repeated texts only; their first place tells the duplicates
    first = numbered.where(~F.col("is_blank")).groupBy("conv_id", "said").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    marked = joined_safely(numbered.select("conv_id", "pos", "role", "said", "is_blank", "ended"),
                           first.where("n > 1").drop("n"), ["conv_id", "said"], "left")
    fault = (F.when(F.col("is_blank"), 1).when(F.col("first").isNotNull() & (F.col("pos") > F.col("first")), 2)
             .when(~F.col("ended").isin(".", "!", "?"), 3).otherwise(0))
    initial = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in _INITIALS[:3]]), F.substring("role", 1, 1)), F.lit(0))
    code = F.char(F.lit(65) + 4 * F.when(initial == 0, 3).otherwise(initial - 1).cast("int") + fault)
    coded = marked.select("conv_id", "pos", F.floor(F.col("pos") / segment).alias("seg"), code.alias("code"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "code")))
    segments = coded.groupBy("conv_id", "seg").agg(F.array_join(F.transform(listed, lambda r: r["code"]), "").alias("codes"))
    searched = segments.mapInArrow(
        lambda b: _search_segments(b, segment),
        f"conv_id {key}, seg long, codes string, found array<struct<entry: int, leave: int, cost: long, steps: string>>")
    folded = staged(_in_order(searched, ["seg"], lambda b: _fold_segments(b, arrow_key),
                              f"conv_id {key}, seg long, items array<string>, steps string, cost long, blank long, duplicate long, "
                              "truncated long, illegal long"), "edits")

    edits = folded.select("conv_id", "seg", F.posexplode("items").alias("k", "item")).select(
        "conv_id", (F.col("seg") * segment + F.col("k")).alias("pos"), "item")
    rows_ = joined_safely(numbered.select("conv_id", "pos", "role", "text"), edits, ["conv_id", "pos"], "inner")
    steps = F.filter(F.split("item", ""), lambda c: ~c.isin("", "d"))
    role = (F.when(F.col("step").isin("u", "U"), "user").when(F.col("step").isin("a", "A"), "assistant").otherwise(F.col("role")))
    turns = rows_.select("conv_id", "pos", "role", "text", F.posexplode(steps).alias("part", "step")).select(
        "conv_id", "pos", "part", role.alias("role"), F.when(F.col("step").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    pieces = F.array_sort(F.collect_list(F.struct("seg", "steps")))
    reports = folded.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums], F.translate(F.array_join(
        F.transform(pieces, lambda p: p["steps"]), ""), *_AUDIT).alias("audit"))
    places = numbered.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    return turns, joined_safely(reports, places, ["conv_id"], "inner").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, digest): sha256 of the turns as `role:text` joined by newlines."""
    key_type = turns.schema["conv_id"].dataType
    arrow_key = to_arrow_type(key_type)
    lines = turns.select("conv_id", "pos", "part", F.concat_ws(":", "role", "text").alias("line"))
    return _in_order(lines, ["pos", "part"], lambda b: _digests(b, arrow_key), f"conv_id {key_type.simpleString()}, digest string")
