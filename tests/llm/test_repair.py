"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from latticework.llm import repair
from latticework.llm.queries import LLM_QUERIES

BLANK = re.compile("[^\x20\x09-\x0d]")


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def _brute(rows):
    """Report and repaired lines of one conversation's rows, every edit tried (least cost, then least audit, per state)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        visible = BLANK.findall(text)
        faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "-")
        seen.add((role, text))
    accepted = re.compile("(s?(ua)+)?")
    begun = re.compile("s?(ua)*u?")
    best = {"": (0, "", [])}
    for k in range(len(rows) + 1):
        for _ in range(2):  # insertions before this row
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    _offer(best, begun, state + role[0], (cost + 2, audit + "I", lines + [f"{role}:"]))
        if k == len(rows):
            break
        _, _, role, text = rows[k]
        extra, after = int(faults[k] == "t"), {}
        for state, (cost, audit, lines) in best.items():
            _offer(after, begun, state, (cost + 3, audit + "D", lines))
            if faults[k] not in "bd":
                _offer(after, begun, state + role[:1] if role else state + "?", (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    _offer(after, begun, state + new[0], (cost + 2 + extra, audit + "R", lines + [f"{new}:{text}"]))
        best = after
    cost, audit, lines = min((v for s, v in best.items() if accepted.fullmatch(s)), key=lambda v: v[:2])
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), lines


def _offer(best, begun, state, way):
    if not begun.fullmatch(state):
        return
    if len(state) > 3:  # role states repeat; three letters tell them apart
        state = state[:-2]
    if state not in best or way[:2] < best[state][:2]:
        best[state] = way


def _random_rows(rng, conv, n):
    words = ["Hello there.", "Yes!", "And then", "", " \t", "Fine?", "No way \n", "Well."]
    rows = []
    for k in range(n):
        role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
        text = rng.choice(words) + ("" if rng.random() < 0.3 else f" {rng.randint(0, 9)}{rng.choice(['.', '!', '', '?'])}")
        rows.append((conv, None if rng.random() < 0.1 else k + (rng.random() < 0.1), role, None if rng.random() < 0.05 else text))
    return rows


def _expected(rows):
    convs = {}
    for r in _damaged(rows):
        convs.setdefault(r[0], []).append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        report, lines = _brute(convs[conv]) if conv in convs else ((0,) * 6 + ("",), [])
        out[conv] = (*report, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = LLM_QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("segment", [512, 3])
def test_query_equals_the_plain_search(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(repair.repair, "__defaults__", (segment, None))
    rng = random.Random(3)
    rows = [r for conv in range(120) for r in _random_rows(rng, conv, rng.choice([1, 2, 3, 5, 8, 13]))]
    rows += _random_rows(rng, None, 6) + _random_rows(rng, 500, 60) + [(501, 0, "user", "a."), (502, None, None, None)] + [(503, 1, "user", "Same.")] * 4
    rows += [(504, k, "user", f"All {k}.") for k in range(40)] + [(505, 0, "system", "x" * 200_000 + "."), (505, 1, "user", "y.")]
    assert _query(spark, tmp_path, rows) == _expected(rows)


def test_a_hot_conversation_and_no_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = _random_rows(rng, 1, 2_000)
    turns, reports = repair.repair(repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")),
                                   hot_rows=300)
    report, lines = _brute(_damaged(rows))
    assert tuple(reports.first())[1:] == report
    assert [f"{r.role}:{r.text}" for r in turns.orderBy("pos", "part").collect()] == lines
    assert _query(spark, tmp_path, spark.createDataFrame([], "conv_id long, turn long, role string, text string").collect()) == {}


def test_repaired_conversations_stay_as_they_are(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 5, "user", "Hm?"), (2, 7, "assistant", "So.")]
    clashing = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, copy string")
    turns, reports = repair.repair(clashing)
    assert {tuple(r) for r in reports.collect()} == {(1, 0, 0, 0, 0, 0, 0, "KKK"), (2, 1, 0, 0, 0, 0, 0, "KK")}
    assert turns.count() == 5


def test_budgets_that_failed_are_not_opened_again():
    search = repair.Search("".join(random.Random(1).choice("ADEHIM") for _ in range(300)), (0, 3))
    cost, steps = search.path(0)
    opened = sum(f >= 0 for f in search.failed)
    assert opened <= 4 * 301 and cost == repair._cost(steps, search.codes)
