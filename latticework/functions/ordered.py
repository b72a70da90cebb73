"""Order-dependent operators that stay distributed when one group holds a large share of all rows.

Spark evaluates a window partition in one task. The helpers here first cut every oversized group into
order-preserving buckets, work inside (group, bucket), and stitch buckets together through per-bucket
summaries. Groups below the limit keep a single bucket and cost one ordinary window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

# Rows one task may sort for one group. At most total_rows / HOT_ROWS groups can exceed it, so the table
# of such groups has one row per four million input rows: about 16 MB for 10^12 rows, safe to broadcast.
HOT_ROWS = 4_000_000
# Rows sampled for each part that a hot group is cut into.
SAMPLE = 16
# Buckets used to locate an order statistic.
QUANTILE_BUCKETS = 256


def hot_groups(df: DataFrame, keys: list[str], order: list[str] | None = None,
               hot_rows: int | None = None) -> DataFrame | None:
    """Groups above the limit, with borders that cut them into even parts of the sort by `order`, or None where there are none.

    Runs one map-side-combined count now, so that ordinary data gets the short plan. Borders are whole tuples of the
    order columns, taken at even places of a sorted sample (all rows of a small group), so ties in the first columns
    are cut by the later ones. They are written once, since the sample is drawn at random.
    """
    limit = hot_rows or HOT_ROWS
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    if hot.isEmpty():
        return None
    if order is None:
        return hot
    cuts = F.ceil(F.col("_n") / limit).cast("int")
    large = joined_safely(df.select(*keys, F.struct(*order).alias("_o")), F.broadcast(hot), keys, "inner")
    sample = large.where(F.rand(11) * F.col("_n") < SAMPLE * cuts)
    listed = sample.groupBy(*keys).agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list("_o")).alias("_s"))
    places = F.transform(F.sequence(F.lit(1), cuts - 1), lambda i: F.get("_s", F.floor(i * F.size("_s") / cuts).cast("int")))
    return staged(listed.select(*keys, F.array_distinct(places).alias("_borders")), "borders")


def joined_safely(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` where null equals null; the keys come from the left."""
    other = right.select(*[F.col(k).alias(f"_safe_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        same = left[k].eqNullSafe(other[f"_safe_{k}"])
        on = same if i == 0 else on & same
    return left.join(other, on, how).drop(*[f"_safe_{k}" for k in keys])


def _cut(df: DataFrame, hot: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add `_bucket`, increasing with `order` (nulls first, as in a sort); 0 for groups that are not hot."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    # how many borders are at most the row's tuple, by bisection
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size("_borders")) & (F.get("_borders", at + step - 1) <= F.struct(*order)), at + step).otherwise(at))
    cut = joined_safely(df, F.broadcast(hot), keys, "left")
    return cut.withColumn("_bucket", F.when(F.col("_borders").isNull(), F.lit(0)).otherwise(bucket).cast("long")).drop("_borders")


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str,
              hot_rows: int | None = None) -> DataFrame:
    """0-based position of each row inside its group; rows alike in all order columns stay in one task."""
    hot = hot_groups(df, keys, order, hot_rows)
    if hot is None:
        whole = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(whole) - 1).cast("long"))
    cut = _cut(df, hot, keys, order)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = cut.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # only later buckets need an offset: one row per hot_rows input rows, same bound as the hot table
    offsets = sizes.select(*keys, "_bucket", F.sum("_rows").over(before).alias("_offset")).where("_bucket > 0")
    return (joined_safely(numbered, F.broadcast(offsets), [*keys, "_bucket"], "left")
                    .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0).cast("long")))
                    .drop("_offset", "_bucket"))


def fill_forward(df: DataFrame, keys: list[str], bucket: str, order: str, source: str,
                 name: str) -> DataFrame:
    """Last non-null `source` at or before each row, carried across buckets of the same group."""
    inside = W.partitionBy(*keys, bucket).orderBy(order)
    local = F.last(source, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    tails = df.groupBy(*keys, bucket).agg(
        F.max(F.when(F.col(source).isNotNull(), F.struct(F.col(order), F.col(source)))).alias("_tail"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carry = tails.select(*keys, bucket,
                         F.last("_tail", ignorenulls=True).over(earlier)[source].alias("_carry"))
    return (df.withColumn("_local", local).join(carry, [*keys, bucket], "left")
              .withColumn(name, F.coalesce("_local", "_carry")).drop("_local", "_carry"))


def runs(df: DataFrame, keys: list[str], value: str, order: str | list[str], hot_rows: int | None = None) -> DataFrame:
    """Runs of equal consecutive values: (keys, value, run_start, run_length); later order columns decide ties."""
    order = [order] if isinstance(order, str) else order
    slim = df.select(*keys, value, *order)
    hot = hot_groups(slim, keys, order, hot_rows)
    if hot is None:
        whole = W.partitionBy(*keys).orderBy(*order)
        new = ~F.lag(value).over(whole).eqNullSafe(F.col(value)) | (F.row_number().over(whole) == 1)
        return (slim.withColumn("_new", new.cast("long"))
                    .withColumn("_run", F.sum("_new").over(whole.rowsBetween(W.unboundedPreceding, 0)))
                    .groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(order[0]).alias("run_start"),
                                                F.count(F.lit(1)).alias("run_length")).drop("_run"))
    cut = _cut(slim, hot, keys, order)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    starts = ~F.lag(value).over(inside).eqNullSafe(F.col(value)) | (F.row_number().over(inside) == 1)
    islands = (cut.withColumn("_starts", starts.cast("long"))
                  .withColumn("_island", F.sum("_starts").over(inside.rowsBetween(W.unboundedPreceding, 0)))
                  .groupBy(*keys, "_bucket", "_island")
                  .agg(F.first(value).alias(value), F.min(order[0]).alias("run_start"),
                       F.count(F.lit(1)).alias("run_length")))
    last_of = W.partitionBy(*keys, "_bucket")
    islands = islands.withColumn("_last", F.max("_island").over(last_of))
    edge = (F.col("_island") == 1) | (F.col("_island") == F.col("_last"))
    inner = islands.where(~edge).select(*keys, value, "run_start", "run_length")
    # two edge runs per bucket at most, so one group's edges stay few whatever its size
    seam = W.partitionBy(*keys).orderBy("_bucket", "_island")
    opens = ~(F.lag(value).over(seam).eqNullSafe(F.col(value))
              & (F.lag("_bucket").over(seam) != F.col("_bucket"))) | (F.row_number().over(seam) == 1)
    merged = (islands.where(edge)
                     .withColumn("_opens", opens.cast("long"))
                     .withColumn("_run", F.sum("_opens").over(seam.rowsBetween(W.unboundedPreceding, 0)))
                     .groupBy(*keys, "_run")
                     .agg(F.first(value).alias(value), F.min("run_start").alias("run_start"),
                          F.sum("run_length").alias("run_length")).drop("_run"))
    return inner.unionByName(merged)


def values_at_ranks(df: DataFrame, keys: list[str], value: str,
                    ranks: dict[str, Callable[[Column], Column]], freq: Column | None = None) -> DataFrame:
    """Exact order statistics: (keys, n, stat, value) with value = sorted[rank(n)], rank 0-based.

    Equal values are pre-aggregated before the shuffle; measured quantiles cut each group into buckets of about as
    many distinct values, exact counts find the one bucket that holds each rank, and only its values are ordered.
    """
    freq = F.lit(1) if freq is None else freq
    distinct = (df.select(*keys, F.col(value).cast("double").alias("_v"), freq.cast("long").alias("_f"))
                  .where(F.col("_v").isNotNull())
                  .groupBy(*keys, "_v").agg(F.sum("_f").alias("_f")))
    points = F.array(*[F.lit(i / QUANTILE_BUCKETS) for i in range(1, QUANTILE_BUCKETS)])
    stats = distinct.groupBy(*keys).agg(F.sum("_f").alias("n"),
                                        F.percentile_approx("_v", points, 10 * QUANTILE_BUCKETS).alias("_borders"))
    above = F.size(F.filter("_borders", lambda b: b < F.col("_v")))
    binned = (joined_safely(distinct, stats, keys)
                      .withColumn("_b", above.cast("int"))
                      .select(*keys, "_v", "_f", "_b"))
    by_bucket = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    buckets = (binned.groupBy(*keys, "_b").agg(F.sum("_f").alias("_c"))
                     .withColumn("_cum", F.sum("_c").over(by_bucket)))
    wanted = stats.select(*keys, "n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("stat"), rank(F.col("n")).cast("long").alias("_rank"))
        for name, rank in ranks.items()])).alias("_w")).select(*keys, "n", "_w.stat", "_w._rank")
    hits = (joined_safely(buckets, wanted, keys)
                   .where((F.col("_rank") < F.col("_cum")) & (F.col("_rank") >= F.col("_cum") - F.col("_c")))
                   .select(*keys, "_b", "n", "stat", (F.col("_rank") - F.col("_cum") + F.col("_c")).alias("_r")))
    inside = W.partitionBy(*keys, "stat").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return (joined_safely(binned, hits, [*keys, "_b"])
                  .withColumn("_upto", F.sum("_f").over(inside))
                  .where(F.col("_upto") > F.col("_r"))
                  .groupBy(*keys, "n", "stat").agg(F.min("_v").alias("value")))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              freq: Column | None = None, hot_rows: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of `probs`, plus the row count `n`."""
    weight = F.lit(1) if freq is None else freq
    slim = (df.select(*keys, F.col(value).cast("double").alias("_x"), weight.cast("long").alias("_w"))
              .where(F.col("_x").isNotNull()))
    hot = hot_groups(slim, keys, hot_rows=hot_rows)
    cold = slim if hot is None else joined_safely(slim, F.broadcast(hot.select(*keys)), keys, "left_anti")
    points = F.array(*[F.lit(float(p)) for p in probs.values()])
    cold = (cold.groupBy(*keys).agg(F.sum("_w").alias("n"), F.percentile("_x", points, F.col("_w")).alias("_q"))
                .select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)]))
    if hot is None:
        return cold
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[name + "|lo"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1))
        ranks[name + "|hi"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    picked = values_at_ranks(joined_safely(slim, F.broadcast(hot.select(*keys)), keys, "left_semi"), keys, "_x", ranks, F.col("_w"))
    wide = picked.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("stat") == stat, F.col("value"))).alias(stat) for stat in ranks])
    warm = wide.select(*keys, "n", *[
        (F.col(f"`{name}|lo`") + (F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1)))
         * (F.col(f"`{name}|hi`") - F.col(f"`{name}|lo`"))).alias(name) for name, p in probs.items()])
    return cold.unionByName(warm)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each group. The rank filter lets Spark drop rows before the shuffle."""
    ranked = df.withColumn(rank or "_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(rank or "_rank") <= k)
    return kept if rank else kept.drop("_rank")
