"""Corpus statistics, profiles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import N_CLASSES, RDF_CLIP, VAL_MODULUS
from ..functions.ordered import joined_safely, quantiles, runs, top_k, values_at_ranks


def gid_of(symbols: Column) -> Column:
    """48-bit number of a set of symbols: md5 of the sorted names."""
    key = F.array_join(F.array_sort(F.array_distinct(symbols)), ",")
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def group_id(atoms: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    """(keys, n_elements, gid): one row per structure; a set holds at most 94 symbols."""
    sets = atoms.groupBy(*keys).agg(F.collect_set(symbol).alias("_s"))
    return sets.select(*keys, F.size("_s").alias("n_elements"), gid_of(F.col("_s")).alias("gid"))


def assign_split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("gid") % VAL_MODULUS == 0, "val").otherwise("train"))


def exclude_val(df: DataFrame) -> DataFrame:
    """Drop held-out element sets from derived data."""
    return df.where(F.col("gid") % VAL_MODULUS != 0)


def class_weights(labels: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """(zn, n, weight): 1/sqrt(n) over seen classes, scaled to mean 1, clipped to [0, 10]; 0 if unseen."""
    counts = labels.groupBy("zn").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.agg(F.map_from_entries(F.collect_list(F.struct("zn", "n"))).alias("_m"),
                        F.avg(1.0 / F.sqrt("n")).alias("_mean"))
    full = packed.withColumn("zn", F.explode(F.sequence(F.lit(1), F.lit(n_classes))))
    n = F.coalesce(F.try_element_at("_m", F.col("zn")), F.lit(0).cast("long"))
    weight = F.when(n > 0, F.least(1.0 / F.sqrt(n) / F.col("_mean"), F.lit(10.0))).otherwise(0.0)
    return full.select("zn", n.alias("n"), weight.alias("weight"))


def profile(atoms: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """Histograms (metric, value, n): atoms per frame, distinct elements per frame, element instances and,
    with (system_id, structure_id) rows, frames per system. One pass per frame summary, then tiny tables."""
    by_frame = atoms.groupBy("structure_id", "symbol").agg(F.count(F.lit(1)).alias("c"))
    frames = by_frame.groupBy("structure_id").agg(F.sum("c").alias("atoms"), F.count(F.lit(1)).alias("kinds"))
    distinct = F.when(F.col("kinds") < 5, F.col("kinds").cast("string")).otherwise("5+")
    flat = frames.select(F.explode(F.array(
        F.struct(F.lit("n_atoms").alias("metric"), F.col("atoms").cast("string").alias("value")),
        F.struct(F.lit("n_distinct").alias("metric"), distinct.alias("value")))).alias("e")).select("e.*")
    out = flat.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(by_frame.groupBy(F.col("symbol").alias("value")).agg(F.sum("c").alias("n"))
                                  .select(F.lit("element").alias("metric"), "value", "n"))
    if systems is not None:
        sizes = systems.groupBy("system_id").agg(F.count(F.lit(1)).alias("k"))
        bucket = F.when(F.col("k") < 20, F.col("k").cast("string")).otherwise(">=20")
        out = out.unionByName(sizes.groupBy(bucket.alias("value")).agg(F.count(F.lit(1)).alias("n"))
                                   .select(F.lit("frames_per_system").alias("metric"), "value", "n"))
    return out


def parse_info(frames: DataFrame, line: str = "info") -> DataFrame:
    """Keys present in an info line, its label, and the label split into prefix and trailing number."""
    label = F.regexp_extract(line, r"db_label=(\S+)", 1)
    parts = r"^(.+)_(\d+)$"
    return (frames.withColumn("keys", F.array_distinct(F.regexp_extract_all(F.col(line), F.lit(r"(\w+)="), F.lit(1))))
                  .withColumn("label", F.when(label != "", label))
                  .withColumn("prefix", F.when(F.col("label").rlike(parts), F.regexp_extract("label", parts, 1))
                              .otherwise(F.col("label")))
                  .withColumn("number", F.when(F.col("label").rlike(parts), F.regexp_extract("label", parts, 2)).cast("long")))


def completeness(parsed: DataFrame) -> DataFrame:
    """(key, n_present, n_total): how many rows carry each key."""
    total = parsed.agg(F.count(F.lit(1)).alias("n_total")).withColumn("_one", F.lit(1))
    seen = (parsed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_present"))
                  .withColumn("_one", F.lit(1)))
    return seen.join(F.broadcast(total), "_one").drop("_one")


def missing_examples(parsed: DataFrame, key: str, id_column: str, k: int = 5) -> DataFrame:
    """First k rows that lack a key."""
    return parsed.where(~F.array_contains("keys", key)).orderBy(id_column).limit(k)


def null_report(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNotNull()).alias("non_null"), F.count_if(F.col(column).isNull()).alias("nulls"))


def run_lengths(df: DataFrame, keys: list[str], value: str, order: str | list[str]) -> DataFrame:
    """Per key, null included: number of runs, mean, max, upper median and runs of length one."""
    found = runs(df, keys, value, order).groupBy(*keys, "run_length").agg(F.count(F.lit(1)).alias("c"))
    stats = found.groupBy(*keys).agg(F.sum("c").alias("n_runs"),
                                     (F.sum(F.col("run_length") * F.col("c")) / F.sum("c")).alias("mean"),
                                     F.max("run_length").alias("max"),
                                     F.sum(F.when(F.col("run_length") == 1, F.col("c")).otherwise(0)).alias("n_len1"))
    middle = values_at_ranks(found, keys, "run_length", {"m": lambda n: F.floor(n / 2)}, F.col("c"))
    return joined_safely(stats, middle.select(*keys, F.col("value").cast("long").alias("median")), keys)


def hist_percentiles(hist: DataFrame, keys: list[str], value: str, freq: str,
                     points=(5, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    return quantiles(hist, keys, value, {f"p{p}": p / 100 for p in points}, F.col(freq))


def top_share(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each key with their share, the rest summed up as 'tail'."""
    counts = df.groupBy(*keys, F.col(value).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    head = top_k(counts, keys, [F.desc("n"), F.col("value")], n, "rank")
    rest = (counts.join(head.select(*keys, "value"), [*keys, "value"], "left_anti")
                  .groupBy(*keys).agg(F.sum("n").alias("n"))
                  .select(*keys, F.lit("tail").alias("value"), "n", F.lit(n + 1).alias("rank")))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return (head.unionByName(rest).join(total, keys)
                .withColumn("share", F.col("n") / F.col("_all")).drop("_all"))


def repair_values(df: DataFrame, column: str) -> DataFrame:
    """Replace NaN by 0 and clip to [0, 1e4]; `n_bad` counts non-finite or oversized entries."""
    def bad(x):
        return F.isnan(x) | (x > RDF_CLIP) | (x == float("-inf"))

    return (df.withColumn("n_bad", F.size(F.filter(column, bad)))
              .withColumn(column, F.transform(column, lambda x: F.least(F.greatest(
                  F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(RDF_CLIP)))))


def nearest_lookup(masses: DataFrame, elements: DataFrame, k: int = 3) -> DataFrame:
    """Top-k elements by absolute mass difference; distinct masses only, each against 94 elements."""
    table = elements.agg(F.collect_list(F.struct("zn", "symbol", "mass")).alias("_e")).withColumn("_one", F.lit(1))
    distinct = masses.select("mass").distinct().withColumn("_one", F.lit(1))
    near = distinct.join(F.broadcast(table), "_one").select("mass", F.slice(F.array_sort(F.transform(
        "_e", lambda e: F.struct(F.abs(e["mass"] - F.col("mass")).alias("diff"), e["zn"].alias("zn"),
                                 e["symbol"].alias("symbol")))), 1, k).alias("_n"))
    return masses.join(near.select("mass", F.posexplode("_n").alias("pos", "e")), "mass").select(
        *masses.columns, (F.col("pos") + 1).alias("rank"), "e.zn", "e.symbol", "e.diff")


def semi_filter(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_semi")


def twin_swap(members: DataFrame, twins: DataFrame) -> DataFrame:
    """Per structure the first element (by name) whose look-alike is not already in the structure."""
    kinds = members.select("structure_id", "symbol").distinct()
    options = kinds.join(F.broadcast(twins), "symbol")
    free = options.join(kinds.select("structure_id", F.col("symbol").alias("twin")), ["structure_id", "twin"], "left_anti")
    return free.groupBy("structure_id").agg(F.min(F.struct("symbol", "twin")).alias("s")).select(
        "structure_id", F.col("s.symbol").alias("symbol"), F.col("s.twin").alias("twin"))
