"""Sharding by histogram sort.

The sort key of a row is (hash of the text, hash of the id, row number), so equal texts lie side by side while a
text that fills more than a shard can still be cut by id. Splitters for equal bytes are found by counting: every
round counts the exact bytes below 4096 candidate boundaries inside each open interval, in one aggregate over all
partitions, and narrows the interval to the candidate gap that holds the target. When all splitters meet the
tolerance, rows are exchanged once into their final places. Everything is DataFrame code.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

# One round resolves 12 of the 60 bits of each of the three key parts.
_BITS, _PART, _PARTS = 12, 60, 3
_LEVELS = _PARTS * _PART // _BITS
# Sorted pieces per shard: enough tasks for large shards, and a bounded table of splitters (8 shards: 1,024).
PIECES, MAX_PIECES, ROWS_PER_PIECE = 16, 128, 200_000


def with_keys(docs: DataFrame, kept: list[str], text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The kept columns as struct `row`, _size (UTF-8 bytes plus 1), _crc and the key parts (60 bits each)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        (F.octet_length(body) + 1).cast("long").alias("_size"), F.crc32(body.cast("binary")).alias("_crc"),
        F.shiftrightunsigned(F.xxhash64(F.col(text)), 4).alias("_k1"),
        F.shiftrightunsigned(F.xxhash64(F.col(ident)), 4).alias("_k2"),
        (F.monotonically_increasing_id() % (1 << _PART)).alias("_k3"))


def _digit(level: int) -> Column:
    part, step = divmod(level, _PART // _BITS)
    return F.shiftright(F.col(f"_k{part + 1}"), _PART - _BITS * (step + 1)).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def _prefix(level: int) -> list[Column]:
    """The key parts with every bit from this level on cleared."""
    part, step = divmod(level, _PART // _BITS)
    mask = ((1 << _PART) - 1) ^ ((1 << (_PART - _BITS * step)) - 1)
    return ([F.col(f"_k{i + 1}") for i in range(part)] + [F.col(f"_k{part + 1}").bitwiseAND(F.lit(mask))]
            + [F.lit(0).cast("long")] * (_PARTS - part - 1))


def _split(key: int) -> tuple[int, ...]:
    low = (1 << _PART) - 1
    return tuple((key >> (_PART * (_PARTS - 1 - i))) & low for i in range(_PARTS))


def _rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(str(tuple(int(v) for v in r)) for r in rows)} AS t({names})")


def find_splitters(keyed: DataFrame, total: int, n_shards: int, pieces: int, tolerance: float) -> list[int]:
    """Key values cutting the rows into n_shards * pieces runs of near-equal bytes.

    A border between shards is moved until it is within `tolerance` of a shard's size of its target; one between
    pieces of a shard needs a tenth of a piece only. The table of open intervals has at most n_shards * MAX_PIECES
    rows, hence the broadcast.
    """
    spark, n = keyed.sparkSession, n_shards * pieces
    need = {i: total * tolerance / n_shards if i % pieces == 0 else total / n * 0.1 for i in range(1, n)}
    start, below, found = dict.fromkeys(need, 0), dict.fromkeys(need, 0), {}
    for level in range(_LEVELS):
        open_ = [i for i in need if i not in found]
        if not open_:
            break
        spots = sorted({start[i] for i in open_})
        rows = keyed.select("_size", _digit(level).alias("_d"), *[c.alias(f"_p{j}") for j, c in enumerate(_prefix(level))])
        where = _rows(spark, "_p0, _p1, _p2, _at", [(*_split(k), j) for j, k in enumerate(spots)])
        counts = (rows.join(F.broadcast(where.select(*[F.col(f"_p{j}").cast("long") for j in range(3)], "_at")),
                            ["_p0", "_p1", "_p2"])
                      .groupBy("_at", "_d").agg(F.sum("_size").alias("_b"), F.count(F.lit(1)).alias("_n")))
        upto = counts.withColumn("_hi", F.sum("_b").over(W.partitionBy("_at").orderBy("_d")))
        aims = _rows(spark, "_at, _i, _aim", [(spots.index(start[i]), i, (total * i) // n - below[i]) for i in open_])
        gaps = (upto.join(F.broadcast(aims), "_at")
                    .where((F.col("_hi") - F.col("_b") < F.col("_aim")) & (F.col("_aim") <= F.col("_hi")))
                    .select("_i", "_d", "_b", "_n", "_hi", "_aim").collect())
        unit = 1 << (_PART * _PARTS - _BITS * (level + 1))
        seen = {g._i: g for g in gaps}
        for i in open_:
            g = seen.get(i)
            if g is None:  # a target of no bytes: the interval's start serves
                found[i] = start[i]
                continue
            low, over = g._aim - (g._hi - g._b), g._hi - g._aim  # distance to the gap's start and end
            base = start[i] + g._d * unit
            if min(low, over) <= need[i] or g._n == 1 or level == _LEVELS - 1:
                found[i] = base if low < over else base + unit
            else:
                start[i], below[i] = base, below[i] + g._hi - g._b
    cuts, last = [], 0
    for i in range(1, n):
        last = max(last, found[i])
        cuts.append(last)
    return cuts


def _piece(cuts: list[int]) -> Column:
    """Number of splitters at or below the row's key: a table by the key's first digit, then a short comparison."""
    unit = 1 << (_PART * _PARTS - _BITS)
    table = [{"base": 0, "inside": []} for _ in range(1 << _BITS)]
    for c in cuts:
        if c // unit < len(table):
            table[c // unit]["inside"].append(dict(zip("abc", _split(c))))
    seen = 0
    for slot in table:
        slot["base"], seen = seen, seen + len(slot["inside"])
    kind = "array<struct<base:int,inside:array<struct<a:bigint,b:bigint,c:bigint>>>>"
    slot = F.element_at(F.from_json(F.lit(json.dumps(table)), kind), _digit(0) + 1)
    key = F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b"), F.col("_k3").alias("c"))
    return slot["base"] + F.when(F.size(slot["inside"]) == 0, 0).otherwise(
        F.size(F.filter(slot["inside"], lambda x: x <= key)))


def shard(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001, text: str = "text",
          ident: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The rows with size, text_crc32, shard and slot (place in the shard, gapless from 0).

    Law: bytes; shards hold near-equal sums of size, within `tolerance` of a shard or one row, whichever is more.
    Equal texts are neighbours, in one shard unless a border falls inside their run. Null texts count as empty for
    size and checksum; null ids and repeated rows are ordinary rows; no rows give no rows. `keep` names the input
    columns to carry (default all); input columns named like an output column are replaced.
    """
    own = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in own]
    keyed = staged(with_keys(docs, kept, text, ident), "shard-keys")
    total = keyed.agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    pieces = min(MAX_PIECES, max(PIECES, -(-total.n // (n_shards * ROWS_PER_PIECE))))
    cuts = find_splitters(keyed, total.b, n_shards, pieces, tolerance) if total.n else []
    placed = keyed.withColumn("_piece", _piece(cuts))
    sizes = {r._piece: r["count"] for r in placed.groupBy("_piece").count().collect()}  # at most n_shards * MAX_PIECES
    offsets, run = [], 0
    for p in range(n_shards * pieces):
        run = 0 if p % pieces == 0 else run
        offsets.append(run)
        run += sizes.get(p, 0)
    offset = F.element_at(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col("_piece") + 1)
    order = W.partitionBy("_piece").orderBy("_k1", "_k2", "_k3")
    return placed.withColumn("_row", F.row_number().over(order)).select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.floor(F.col("_piece") / pieces).cast("int").alias("shard"),
        (offset + F.col("_row") - 1).cast("long").alias("slot"))
