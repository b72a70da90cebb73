"""Entries of nested JSON objects of any size, cut by many tasks.

A corpus may be one JSON object of many gigabytes, too long for a row. The text source reads it by byte range in pieces
that end at a closing brace. Two scans in reading order then find the entries:

1. Every block of a file gives a summary for both cases, begun outside a string or inside one: whether it turns the
   quote state, and how far it goes up or down in nesting. Summaries combine along the file, so the state at the start
   of each block is known.
2. With that state each block is cut where nesting returns to depth 2 or less. Cuts across block borders are put
   together afterwards; they are two at most per block.

Files of JSON lines are read by the same scans: between lines nesting is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .blocks import by_unit, looked_up, pieces, with_state

_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_STRING = r'"(?:[^"\\]|\\.)*"'
# the last key before an object, behind entries with plain values
_OUTER_KEY = rf'^[\s,{{]*(?:{_STRING}\s*:\s*[^{{"\[,]*,\s*)*({_STRING})\s*:\s*\{{'


def _scan(text: bytes, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(in a string or not, nesting) behind every byte."""
    if b"\\" in text:
        text = _ESCAPE.sub(b"__", text)
    raw = np.frombuffer(text, np.uint8)
    state = (inside + np.cumsum(raw == 34)) & 1
    return state, depth + np.cumsum(np.where(state == 0, _STEP[raw], 0))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch, bytes]]:
    """(first of its unit, rows, their text without the last closing brace)."""
    for new, rows in by_unit(batches):
        yield new, rows, "}".join(rows.column("value").to_pylist()).encode()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: quotes turned or not, nesting gained if begun outside or inside a string, bytes."""
    names = ["file", "block", "size", "turn", "outside", "inside", "bytes"]
    key, sums = None, [0, 0, 0, 0]

    def add(text: bytes) -> None:
        outer, depth = _scan(text, sums[0], 0)
        inner = _scan(text, 1 - sums[0], 0)[1]
        if len(depth):
            sums[0], sums[1], sums[2] = int(outer[-1]), sums[1] + int(depth[-1]), sums[2] + int(inner[-1])
        sums[3] += len(text)

    def row() -> pa.RecordBatch:
        add(b"}")
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *sums)], names)

    for new, rows, text in _texts(batches):
        if new:
            if key:
                yield row()
            key, sums = tuple(rows.column(c)[0].as_py() for c in names[:3]), [0, 0, 0, 0]
            add(text)
        else:
            add(b"}" + text)
    if key:
        yield row()


def _states(summaries: DataFrame) -> DataFrame:
    """(unit, file, block, inside, depth, last, whole) of every block: the state at its start, whether it ends the file,
    and whether the file ends with a brace (null: unknown, as in compressed files)."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    file = W.partitionBy("file")
    found = summaries.withColumn("in", F.coalesce(F.sum("turn").over(before), F.lit(0)) % 2)
    gained = F.when(F.col("in") == 1, F.col("inside")).otherwise(F.col("outside"))
    over = F.sum("bytes").over(file) - F.col("size")
    return found.select(
        F.xxhash64("file", "block").alias("unit"), "file", "block", F.col("in").cast("int").alias("inside"),
        F.coalesce(F.sum(gained).over(before), F.lit(0)).cast("int").alias("depth"),
        (F.col("block") == F.max("block").over(file)).alias("last"), F.when(over == 0, True).when(over == 1, False).alias("whole"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each block: (file, block, k, kind, text, start, end, key).

    kind is whole, head (the first one, which may begin in an earlier block) or tail (no end in this block). start and
    end are the nesting around an entry; key is the outer key, where it began in this block.
    """
    names = ["file", "block", "k", "kind", "text", "start", "end", "key"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    outer = re.compile(_OUTER_KEY)
    at: dict = {}
    ready: list[tuple] = []

    def add(text: bytes) -> None:
        state, depth = _scan(text, at["inside"], at["depth"])
        ends = np.flatnonzero((np.frombuffer(text, np.uint8) == 125) & (state == 0) & (depth <= 2))
        begin = 0
        for e in ends.tolist():
            entry = (b"".join(at["held"]) + text[begin: e + 1]).decode()
            if at["k"]:
                if at["start"] < 2:
                    found = outer.match(entry)
                    at["key"] = found.group(1) if found else at["key"]
                if entry.strip("\t\n\r ,") != "}":
                    ready.append((*at["place"], at["k"], "whole", entry, at["start"], int(depth[e]), at["key"]))
            else:
                ready.append((*at["place"], 0, "head", entry, at["start"], int(depth[e]), None))
            at["held"], at["start"], at["k"], begin = [], int(depth[e]), at["k"] + 1, e + 1
        at["held"].append(text[begin:])
        if len(text):
            at["inside"], at["depth"] = int(state[-1]), int(depth[-1])

    def close() -> None:
        whole = at["whole"] if at["whole"] is not None else at["piece"].strip() != ""
        if whole or not at["last"]:
            add(b"}")
        rest = b"".join(at["held"]).decode()
        if at["last"]:
            if at["depth"] or at["inside"] or rest.strip():
                raise ValueError(f"{at['place'][0]}: not a complete JSON object")
        else:
            ready.append((*at["place"], at["k"], "tail", rest, at["start"], None, None))

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], t) for i, t in enumerate(types)], names)

    for new, rows, text in _texts(batches):
        if new:
            if at:
                close()
            first = {c: rows.column(c)[0].as_py() for c in ("file", "block", "inside", "depth", "last", "whole")}
            at = {**first, "place": (first["file"], first["block"]), "held": [], "k": 0, "start": first["depth"], "key": None}
            add(text)
        else:
            add(b"}" + text)
        at["piece"] = rows.column("value")[rows.num_rows - 1].as_py()
        if ready:
            yield packed()
            ready.clear()
    if at:
        close()
    if ready:
        yield packed()


def json_entries(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, block, k, json): objects {outer: {inner: value}} which together hold all inner entries, one or few each.

    (block, k) is the order in a file. Nesting and strings alone are looked at; whoever parses `json` finds other faults.
    A file whose braces do not close fails the query.
    """
    rows = pieces(spark, path, recursive, "}")
    states = staged(_states(rows.select("file", "block", "size", "unit", "value").mapInArrow(
        _summaries, "file string, block long, size long, turn long, outside long, inside long, bytes long")), "blocks")
    parts = staged(with_state(rows.select("unit", "ord", "value"), states).mapInArrow(
        _cut, "file string, block long, k long, kind string, text string, start int, end int, key string"), "entries")

    # entries across borders: a tail, blocks without an end, and the head that ends them
    loose = parts.where("kind != 'whole'")
    order = W.partitionBy("file").orderBy("block", "k").rowsBetween(W.unboundedPreceding, -1)
    grouped = loose.select("file", "block", "k", "end").withColumn("part", F.coalesce(F.count("end").over(order), F.lit(0))).drop("end")
    row = F.struct("block", "k", "text", "start", "end")
    glued = loose.join(grouped, ["file", "block", "k"]).groupBy("file", "part").agg(F.array_sort(F.collect_list(row)).alias("r"))
    last = F.element_at("r", -1)
    glued = glued.where(last["end"].isNotNull()).select(
        "file", last["block"].alias("block"), F.lit(0).cast("long").alias("k"), F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"),
        F.element_at("r", 1)["start"].alias("start"), last["end"].alias("end"))
    own = F.when(F.col("start") < 2, F.nullif(F.regexp_extract("text", _OUTER_KEY, 1), F.lit("")))
    glued = staged(glued.withColumn("key", own), "borders")

    # outer keys that began in an earlier block
    known = parts.where("kind = 'whole'").groupBy("file", "block").agg(F.max_by("key", F.when(F.col("key").isNotNull(), F.col("k"))).alias("late"))
    known = states.select("file", "block").join(known, ["file", "block"], "left").join(
        glued.select("file", "block", F.col("key").alias("early")), ["file", "block"], "left")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = F.last(F.coalesce("late", "early"), ignorenulls=True).over(earlier)
    known = staged(known.select("file", "block", carried.alias("before"), F.coalesce("early", carried).alias("after_head")), "keys")

    whole = parts.where("kind = 'whole'").drop("kind")
    sure, unsure = whole.where("key IS NOT NULL"), whole.where("key IS NULL")
    unsure = looked_up(unsure.drop("key"), known, ["file", "block"]).withColumn("key", F.col("after_head"))
    glued = looked_up(glued.withColumnRenamed("key", "own"), known, ["file", "block"]).withColumn("key", F.coalesce("own", "before"))
    columns = ["file", "block", "k", "text", "start", "end", "key"]
    entries = sure.select(columns).unionByName(unsure.select(columns)).unionByName(glued.select(columns))
    return entries.select("file", "block", "k", _object(F.col("text"), F.col("start"), F.col("end"), F.col("key")).alias("json"))


def _object(text: Column, start: Column, end: Column, key: Column) -> Column:
    """The entry as a whole object again."""
    body = F.regexp_replace(text, r"^[\s,]*", "")
    opened = F.when(start == 0, body).when(start == 1, F.concat(F.lit("{"), body)).otherwise(F.concat(F.lit("{"), key, F.lit(":{"), body))
    return F.concat(opened, F.repeat(F.lit("}"), end))
