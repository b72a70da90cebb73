"""Class probabilities: normalisation, fusion of models, ranking and evaluation.

Long form throughout: one row per (structure_id, type_id, class zn). A window per (structure, type) holds at
most 94 rows, so none of these steps can concentrate data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import top_k

ITEM = ["structure_id", "type_id"]
LOG_FLOOR = 1e-12


def log_of(p: str = "p"):
    return F.log(F.col(p) + F.lit(LOG_FLOOR))


def softmax(df: DataFrame, logit: str, keys: list[str], out: str = "p") -> DataFrame:
    """Softmax over the classes of each key."""
    whole = W.partitionBy(*keys)
    weight = F.exp(F.col(logit) - F.max(logit).over(whole))
    return df.withColumn("_w", weight).withColumn(out, F.col("_w") / F.sum("_w").over(whole)).drop("_w")


def log_softmax(df: DataFrame, logit: str, keys: list[str], out: str = "logp") -> DataFrame:
    whole = W.partitionBy(*keys)
    shifted = df.withColumn("_z", F.col(logit) - F.max(logit).over(whole))
    return shifted.withColumn(out, F.col("_z") - F.log(F.sum(F.exp("_z")).over(whole))).drop("_z")


def apply_temperature(probs: DataFrame, temperature: float) -> DataFrame:
    """Probabilities after dividing log-probabilities by the temperature."""
    return softmax(probs.withColumn("_t", log_of() / F.lit(float(temperature))), "_t", ITEM).drop("_t")


def log_pool(probs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean log-probability over frames and draws within `keys` (structure, type, model, class)."""
    return probs.groupBy(*keys).agg(F.avg(log_of()).alias("logp"))


def fuse(probs: DataFrame, mode: str = "conf") -> DataFrame:
    """Combine models (structure_id, type_id, model, zn, logp) into one normalised logp per class."""
    by_class = [*ITEM, "zn"]
    if mode == "logmean":
        mixed = probs.groupBy(*by_class).agg(F.avg("logp").alias("_l"))
    elif mode == "probmean":
        mixed = probs.groupBy(*by_class).agg(F.log(F.avg(F.exp("logp"))).alias("_l"))
    elif mode == "conf":
        # softmax over models of 4 * top probability; every class of a model shares its weight
        sure = F.exp(4.0 * F.exp(F.max("logp").over(W.partitionBy(*ITEM, "model"))))
        weighted = probs.withColumn("_w", sure)
        mixed = weighted.groupBy(*by_class).agg(
            F.log(F.sum(F.col("_w") * F.exp("logp")) / F.sum("_w") + LOG_FLOOR).alias("_l"))
    elif mode == "median":
        # lower middle for an even number of models
        ordered = F.sort_array(F.collect_list("logp"))
        mixed = probs.groupBy(*by_class).agg(ordered.alias("_s")).withColumn(
            "_l", F.col("_s")[F.floor((F.size("_s") - 1) / 2).cast("int")]).drop("_s")
    else:
        raise ValueError(f"unknown fusion mode {mode!r}")
    return log_softmax(mixed, "_l", ITEM).drop("_l")


def debias(probs: DataFrame, weights: DataFrame, gamma: float) -> DataFrame:
    """Undo class weighting: logp - gamma ln(max(w, 1e-6)). The weight table has one row per class."""
    joined = probs.join(F.broadcast(weights.select("zn", "weight")), "zn", "left")
    return joined.withColumn("logp", F.col("logp") - F.lit(gamma) * F.log(
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6)))).drop("weight")


def ranked(probs: DataFrame) -> DataFrame:
    """Rank classes of each item by probability, the lower atomic number first on ties."""
    order = W.partitionBy(*ITEM).orderBy(F.desc("p"), "zn")
    return probs.withColumn("rank", F.row_number().over(order))


def top_candidates(probs: DataFrame, k: int) -> DataFrame:
    return top_k(probs, ITEM, [F.desc("p"), F.col("zn")], k, "rank")


def join_truth(probs: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank of the true class (structure_id, type_id, true_zn); items without truth are not scored."""
    known = truth.select(*ITEM, "true_zn")
    return ranked(probs).join(known, ITEM).where(F.col("zn") == F.col("true_zn"))


def remap_truth(labels: DataFrame, mapping: DataFrame, case: str = "case_id") -> DataFrame:
    """Truth of cases whose files name types by placeholders: labels (structure_id, type_id, case, label) looked up in
    mapping (case, label, true_zn). Labels the mapping does not name have no truth and are left out; a case without
    any mapping keeps its own `true_zn` where the labels carry one."""
    named = labels.join(mapping.select(case, "label", F.col("true_zn").alias("_mapped")), [case, "label"], "left")
    cases = mapping.select(case).distinct().withColumn("_has", F.lit(True))
    named = named.join(cases, case, "left")
    own = F.col("true_zn") if "true_zn" in labels.columns else F.lit(None).cast("int")
    return named.withColumn("_zn", F.when(F.col("_has"), F.col("_mapped")).otherwise(own)).where(
        F.col("_zn").isNotNull()).select(*ITEM, F.col("_zn").alias("true_zn"))


def top1_agreement(left: DataFrame, right: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row (agree, n, rate): how often two scorings name the same first class, over items both have (and, with
    `truth`, whose class is known)."""
    a = ranked(left).where("rank = 1").select(*ITEM, F.col("zn").alias("_a"))
    b = ranked(right).where("rank = 1").select(*ITEM, F.col("zn").alias("_b"))
    both = a.join(b, ITEM)
    if truth is not None:
        both = both.join(truth.select(*ITEM).distinct(), ITEM, "left_semi")
    return both.agg(F.count_if(F.col("_a") == F.col("_b")).alias("agree"), F.count(F.lit(1)).alias("n")).withColumn(
        "rate", F.col("agree") / F.col("n"))


def hits_at_k(ranks: DataFrame, case: str, ks=(1, 3, 5)) -> DataFrame:
    """Hits per case plus one row with a null case for the total."""
    return ranks.rollup(case).agg(*[F.count_if(F.col("rank") <= k).alias(f"top{k}") for k in ks],
                                  F.count(F.lit(1)).alias("n"))


def rank_report(ranks: DataFrame, bucket: str) -> DataFrame:
    """Top-k rates and median rank per bucket; ranks are counted first, so the median sees 94 values at most."""
    counted = ranks.groupBy(bucket, "rank").agg(F.count(F.lit(1)).alias("c"))
    rate = {k: F.sum(F.when(F.col("rank") <= k, F.col("c")).otherwise(0)) / F.sum("c") for k in (1, 3, 5)}
    return counted.groupBy(bucket).agg(F.sum("c").alias("n"), *[v.alias(f"top{k}") for k, v in rate.items()],
                                       F.percentile("rank", F.lit(0.5), F.col("c")).alias("median_rank"))


def win_rate(pairs: DataFrame, swap: str) -> DataFrame:
    """How often the true assignment scores lower than its swap, per swap and (null) overall."""
    wins = F.count_if(F.col("f_true") < F.col("f_swap"))
    return pairs.rollup(swap).agg(wins.alias("wins"), F.count(F.lit(1)).alias("n")).withColumn(
        "rate", F.col("wins") / F.col("n"))


def score_batch(rows: DataFrame, predict: Callable[[pd.DataFrame], list], model: str = "model") -> DataFrame:
    """Run a model over padded structure rows and return long probabilities.

    `predict` gets an Arrow batch as pandas and returns, per row, an (n_types x classes) table of
    probabilities. It is shipped once per task; load weights lazily inside it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Arrow's own conversion: environments are nested arrays of unlike lengths
            frame = pa.Table.from_batches([batch]).to_pandas(maps_as_pydicts="strict")
            tables = [np.asarray(t, np.float64) for t in predict(frame)]
            rows_of = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
            ids = np.concatenate([np.asarray(i, np.int32) for i in frame["type_ids"]]) if tables else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("structure_id").take(pa.array(rows_of)), pa.array(ids),
                 pa.array([row for t in tables for row in t], pa.list_(pa.float64()))], ["structure_id", "type_id", "_p"])

    kind = rows.schema["structure_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"structure_id {kind}, type_id int, _p array<double>")
    return scored.select("structure_id", "type_id", F.lit(model).alias("model"), F.posexplode("_p").alias("_z", "p")).select(
        "structure_id", "type_id", "model", (F.col("_z") + 1).cast("int").alias("zn"), "p")


def mean_confidence(probs: DataFrame) -> DataFrame:
    """Mean top probability over a structure's types, the tie-breaker of unit inference."""
    top = probs.groupBy(*ITEM).agg(F.max("p").alias("_top"))
    return top.groupBy("structure_id").agg(F.avg("_top").alias("confidence"))
