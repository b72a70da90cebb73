"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots that hold one block of documents each. A source of weight w releases its block k (from 0) at slot
floor(k / w) and wants it placed before slot ceil((k + 1) / w). Serving the released block with the earliest deadline in
every slot keeps each source less than one block from its exact share at all times.

Weights become whole numbers of a fixed part of their sum, so floors and ceilings are exact in 64 bits. Shares with six
decimals, thirds, sevenths and the like are met exactly; for others the rounding stays below a millionth of a block over a
million slots. The schedule covers the whole mixture, slot after slot: one fold for each stretch of slots, which takes up the
state the one before it left, so a block is BLOCK documents however large the mixture is. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path, staged

# Documents in a block, slots one job folds, slots whose result one step of the fold gathers, rows one task numbers.
BLOCK, STRETCH, CHUNK, ROWS_PER_TASK = 64, 1 << 17, 512, 4_000
# Beyond this many slots (some 10^14 documents) blocks are doubled; slot numbers and rounding stay exact enough below it.
SLOTS = 1 << 40
# Weights are whole numbers of this part of their sum; a source without a positive weight gets
# LEAST of the sum of the others.
WHOLE, LEAST = 8 * 10 ** 6 * 9 * 7 * 11 * 13 * 17 * 19, 1e-3
# Tables of one row per source are broadcast up to this many rows and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def tempered_weights(docs: DataFrame, source: str = "source", alpha: float = 0.9) -> DataFrame:
    """(source, weight): target weights in proportion to the count of documents to the power alpha."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count(F.lit(1)), alpha).alias("weight"))


def _served(stretch: DataFrame) -> DataFrame:
    """The row with `out`, the (i, k) served in each of the `size` slots from slot `t0` on, and the state after them.

    The state holds one entry for each source: its next block k, released at slot r, and the remainder f of that release, so
    that k * total = r * u + f; stepping it from block to block keeps to small whole numbers however long the mixture is.
    """
    def after(s: Column, u: Column) -> Column:
        # the release of the next block
        f = s["f"] + u["rest"]
        return F.transform(F.array(f), lambda f: F.struct(
            (s["k"] + 1).alias("k"), (s["r"] + u["step"] + F.when(f >= u["u"], 1).otherwise(0)).alias("r"),
            F.when(f >= u["u"], f - u["u"]).otherwise(f).alias("f")))[0]

    def serve(state: Column, t: Column) -> Column:
        # (deadline, index) of each source's next block, or null before its release
        dues = F.zip_with(state["s"], F.col("units"), lambda s, u: F.when(s["r"] <= t, after(s, u)))
        dues = F.transform(dues, lambda n, i: F.when(n.isNotNull(), F.struct(
            (n["r"] + F.when(n["f"] > 0, 1).otherwise(0)).alias("due"), i.alias("index"))))
        pick = F.array_min(dues)["index"]
        moved = F.zip_with(F.transform(state["s"], lambda s, i: F.struct(s.alias("s"), i.alias("i"))), F.col("units"),
                           lambda s, u: F.when(s["i"] == pick, after(s["s"], u)).otherwise(s["s"]))
        served = F.struct(pick.alias("i"), F.get(state["s"], pick)["k"].alias("k"))
        return F.struct(moved.alias("s"), F.concat(state["out"], F.array(served)).alias("out"))

    empty = F.array().cast("array<struct<i:int,k:bigint>>")

    def chunk(state: Column, c: Column) -> Column:
        last = F.least(c * CHUNK + CHUNK, F.col("size")) - 1
        end = F.aggregate(F.sequence(F.col("t0") + c * CHUNK, F.col("t0") + last),
                          F.struct(state["s"].alias("s"), empty.alias("out")), serve)
        return F.transform(F.array(end), lambda e: F.struct(e["s"].alias("s"), F.concat(state["out"], F.array(e["out"])).alias("out")))[0]

    begin = F.struct(F.col("state").alias("s"), F.array().cast("array<array<struct<i:int,k:bigint>>>").alias("out"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / CHUNK).cast("long"))
    end = stretch.withColumn("_e", F.aggregate(chunks, begin, chunk))
    return end.select("s", "units", "t0", F.col("_e.s").alias("state"), F.flatten("_e.out").alias("out"))


def schedule(weights: DataFrame, slots: int) -> DataFrame:
    """(source, k, slot): the block of which source stands in each of the first `slots` slots; weights are positive.

    Earliest deadline first goes from slot to slot. A job folds one stretch of STRETCH slots in one row that holds all
    sources, and hands its state on, so work is slots times sources and memory that of one stretch.
    """
    sums = weights.agg(F.sum("weight")).first()[0] or 1.0
    unit = F.greatest(F.round(F.col("weight") / F.lit(sums) * WHOLE), F.lit(1)).cast("long")
    packed = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", unit.alias("u")))).alias("s")).where(F.size("s") > 0)
    packed = packed.withColumn("d", F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + s["u"]))
    zero = F.lit(0).cast("long")
    row = packed.select("s", F.transform("s", lambda s: F.struct(
        s["u"].alias("u"), F.call_function("div", F.col("d"), s["u"]).alias("step"), (F.col("d") % s["u"]).alias("rest"))).alias("units"),
        F.transform("s", lambda s: F.struct(zero.alias("k"), zero.alias("r"), zero.alias("f"))).alias("state"))
    path = scratch_path(weights.sparkSession, "mix-stretches")
    for n, t0 in enumerate(range(0, max(slots, 1), STRETCH)):
        row = row.withColumns({"t0": F.lit(t0).cast("long"), "size": F.lit(max(1, min(STRETCH, slots - t0))).cast("long")})
        served = _served(row)
        served.write.parquet(f"{path}/stretch={n}")
        row = weights.sparkSession.read.schema(served.schema).parquet(f"{path}/stretch={n}").select("s", "units", "state")
    whole = weights.sparkSession.read.schema(served.schema).parquet(path)
    return whole.select("s", "t0", F.posexplode("out").alias("at", "o")).select(
        F.get("s", F.col("o.i"))["source"].alias("source"), F.col("o.k").alias("k"), (F.col("t0") + F.col("at")).alias("slot")).where(
        F.col("slot") < slots)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", ident: str = "doc_id",
        block: int = BLOCK, repeat: bool = True) -> DataFrame:
    """The rows with their place in the mixture: mix_slot, mix_offset (inside the block) and mix_epoch.

    Sorting by (mix_slot, mix_offset) gives a sequence in which each source's blocks differ by less than one from
    its weight times the slots passed. No document is left out: the mixture lasts until the source that is slowest
    against its weight has been read through, and the others begin again (mix_epoch 1, 2, ...), unless `repeat` is
    off, which lets every source end after its last document. Null sources are one source; sources without a positive
    weight get LEAST times the sum of all others' weights; rows alike in all columns are interchangeable; no rows give no rows. Input columns named
    like an output column are replaced.
    """
    names = ("mix_slot", "mix_offset", "mix_epoch")
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(source).alias("_source"),
                       F.col(ident).alias("_id"), F.xxhash64(F.col(ident)).alias("_hash"))
    counts = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
    weights = weights if weights is not None else tempered_weights(docs, source)
    named = weights.select(F.col("source").alias("w_source"), F.col("weight"))
    named = counts.join(named, F.col("_source").eqNullSafe(F.col("w_source")), "left")
    given = F.when(F.col("weight") > 0, F.col("weight").cast("double"))
    known = named.agg(F.sum(given)).first()[0]
    named = staged(named.select(F.col("_source").alias("source"), "n", F.coalesce(given, F.lit(LEAST * known if known else 1.0)).alias("weight")),
                   "mix-weights")
    n_plan, sums = named.agg(F.count(F.lit(1)), F.sum("weight")).first()
    share = F.greatest(F.col("weight") / F.lit(sums or 1.0), F.lit(1 / WHOLE))
    # by then the source slowest against its weight has been read through
    def needed(block: int) -> Column:
        return F.max(F.ceil(F.ceil(F.col("n") / block) / share) + 1)

    sizes = [block << k for k in range(40)]
    lengths = named.agg(*[needed(b).alias(str(b)) for b in sizes]).first()
    block, slots = next((b, int(n or 0)) for b, n in zip(sizes, lengths) if (n or 0) <= SLOTS or b == sizes[-1])
    plan = staged(schedule(named, slots), "mix-plan")

    # numbers inside a source, without putting a large source into one task
    cut = counts.select(F.col("_source").alias("c_source"), F.col("n").alias("_n"),
                        F.ceil(F.col("n") / ROWS_PER_TASK).cast("long").alias("_cuts"))
    cut = _sized(cut, n_plan)
    rows = rows.join(cut, F.col("_source").eqNullSafe(F.col("c_source")), "left").withColumn(
        "_cut", F.pmod(F.col("_hash"), F.col("_cuts"))).drop("c_source")
    sizes = rows.groupBy("_source", "_cut").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(F.col("_source").alias("o_source"), F.col("_cut").alias("o_cut"), (
        F.sum("_size").over(W.partitionBy("_source").orderBy("_cut")) - F.col("_size")).alias("_offset"))
    rows = rows.withColumn("_row", F.row_number().over(
        W.partitionBy("_source", "_cut").orderBy("_hash", "_id", F.xxhash64("row"))) - 1)
    rows = rows.join(offsets, F.col("_source").eqNullSafe(F.col("o_source")) & (F.col("_cut") == F.col("o_cut")))
    place = F.col("_offset") + F.col("_row")
    rows = rows.withColumns({"_block": F.floor(place / block), "mix_offset": (place % block).cast("long"),
                             "_blocks": F.ceil(F.col("_n") / block).cast("long")})

    # the last first-epoch slot over all sources ends the mixture
    last = F.ceil(F.col("n") / block).cast("long") - 1
    ends = counts.withColumn("last", last).join(plan, F.col("_source").eqNullSafe(F.col("source")) & (F.col("last") == F.col("k")))
    end = ends.agg(F.max("slot")).first()[0] or 0
    span = plan.where(F.col("slot") <= end).groupBy(F.col("source").alias("u_source")).agg((F.max("k") + 1).alias("_placed"))
    rows = rows.join(_sized(span, n_plan), F.col("_source").eqNullSafe(F.col("u_source")), "left")
    rounds = F.ceil(F.col("_placed") / F.col("_blocks")).cast("long") - 1
    epochs = F.sequence(F.lit(0).cast("long"), rounds) if repeat else F.array(F.lit(0).cast("long"))
    rows = rows.withColumn("mix_epoch", F.explode(epochs)).withColumn(
        "_at", F.col("_block") + F.col("mix_epoch") * F.col("_blocks"))
    spots = plan.where(F.col("slot") <= end).select(F.col("source").alias("s_source"), "k", F.col("slot").alias("mix_slot"))
    rows = rows.join(spots, F.col("_source").eqNullSafe(F.col("s_source")) & (F.col("_at") == F.col("k")))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], *names)
