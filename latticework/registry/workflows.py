"""Checks of jobs, models and the smaller operators around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..elements import elements
from ..operators import augment as A
from ..operators import decode as J
from ..operators import descriptors as D
from ..operators import gates as Q
from ..operators import geometry as G
from ..operators import learning
from ..operators import scoring as P
from ..operators import tokens as T
from ..plans import jobs
from ..session import scratch_path, staged
from ..sources import store
from .base import probs3_view, query, table
from .base import typed_atoms as typed
from .corpus import cooccurrence_tables
from .scores import pmi_table, truth_of

ITEM = P.ITEM


@query("rescale_units", "atoms", """
    SELECT structure_id, atom_id, round(xi / 100.0 * f, 5) AS x, round(zi / 100.0 * f, 5) AS z, round(edge / 100.0 * f, 5) AS side
    FROM (SELECT *, CASE structure_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.529177 ELSE 10.0 END AS f FROM atoms) t""")
def rescale_units(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    factor = F.when(F.col("structure_id") % 3 == 0, 1.0).when(F.col("structure_id") % 3 == 1, 0.529177).otherwise(10.0)
    moved, cells = G.rescale(atoms, structures, structures.select("structure_id", factor.alias("scale")))
    sides = cells.select("structure_id", F.round(F.col("cell")[0][0], 5).alias("side"))
    return moved.join(sides, "structure_id").select("structure_id", "atom_id", F.round("x", 5).alias("x"),
                                                    F.round("z", 5).alias("z"), "side")


@query("drop_virtual", "atoms", "SELECT structure_id, atom_id, label - 3 AS label FROM atoms WHERE label >= 3")
def drop_virtual(spark, sf_dir):
    shifted = typed(spark, sf_dir)[0].withColumn("label", F.col("label") - 3)
    return Q.drop_virtual(shifted).select("structure_id", "atom_id", "label")


@query("stats_roundtrip", "single_counts pair_counts", """
    SELECT zn AS z1, zn AS z2, n FROM single_counts UNION ALL SELECT z1, z2, n FROM pair_counts""")
def stats_roundtrip(spark, sf_dir):
    singles, pairs = J.cooccurrence(cooccurrence_tables(spark, sf_dir))
    path = scratch_path(spark, "stats")
    store.save_stats(singles.select(F.col("zn").alias("z1"), F.col("zn").alias("z2"), "n").unionByName(pairs), path)
    return store.load_stats(spark, path)


@query("evaluate_cases", "ranks", """
    SELECT structure_id, count(*) FILTER (WHERE rank <= 1) AS top1, count(*) FILTER (WHERE rank <= 3) AS top3,
           count(*) FILTER (WHERE rank <= 5) AS top5, count(*) AS n
    FROM ranks WHERE zn = true_zn GROUP BY ROLLUP (structure_id)""")
def evaluate_cases(spark, sf_dir):
    probs = probs3_view(spark, sf_dir)
    return jobs.evaluate(probs.drop("true_zn"), truth_of(probs))


# placeholder labels: type t of a structure is called 'X<t>'; every third structure maps X1 and X3 only
@query("remapped_truth", "ranks", """
    SELECT structure_id, type_id, rank, true_zn FROM ranks
    WHERE zn = true_zn AND (structure_id % 3 <> 0 OR type_id IN (1, 3))""")
def remapped_truth(spark, sf_dir):
    probs = probs3_view(spark, sf_dir)
    labels = truth_of(probs).withColumns({"case_id": F.col("structure_id"), "label": F.concat(F.lit("X"), F.col("type_id"))})
    mapping = labels.where("structure_id % 3 <> 0 OR type_id IN (1, 3)").select("case_id", "label", "true_zn")
    truth = P.remap_truth(labels.drop("true_zn"), mapping)
    return P.join_truth(probs.drop("true_zn"), truth).select(*ITEM, "rank", "true_zn")


@query("top1_agreement", "model_probs", """
    , r AS (SELECT *, row_number() OVER (PARTITION BY structure_id, type_id, model ORDER BY p DESC, zn) AS rank FROM model_probs)
    SELECT count(*) FILTER (WHERE a.zn = b.zn) AS agree, count(*) AS n,
           CAST(count(*) FILTER (WHERE a.zn = b.zn) AS DOUBLE) / count(*) AS rate
    FROM r a JOIN r b ON a.structure_id = b.structure_id AND a.type_id = b.type_id
    WHERE a.model = 1 AND b.model = 2 AND a.rank = 1 AND b.rank = 1""")
def top1_agreement(spark, sf_dir):
    from .base import model_probs_view
    probs = model_probs_view(spark, sf_dir).drop("true_zn")
    return P.top1_agreement(probs.where("model = 1").drop("model"), probs.where("model = 2").drop("model"))


@query("mean_confidence", "probs3", """
    SELECT structure_id, round(avg(top), 6) AS confidence
    FROM (SELECT structure_id, type_id, max(p) AS top FROM probs3 GROUP BY 1, 2) t GROUP BY 1""")
def mean_confidence(spark, sf_dir):
    return P.mean_confidence(probs3_view(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("calibrate_job")
def calibrate_job(spark, sf_dir):
    probs = probs3_view(spark, sf_dir)
    return jobs.calibrate(probs.drop("true_zn"), truth_of(probs))


@query("profile_report", "elements", """
    , s AS (SELECT l_orderkey AS id, symbol, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey
            JOIN elements ON zn = CAST(substr(p_brand, 7) AS INT) GROUP BY 1, 2),
    f AS (SELECT id, sum(c) AS atoms, count(*) AS kinds FROM s GROUP BY id)
    SELECT 'n_atoms' AS metric, CAST(CAST(atoms AS BIGINT) AS VARCHAR) AS value, count(*) AS n FROM f GROUP BY 2
    UNION ALL SELECT 'n_distinct', CASE WHEN kinds < 5 THEN CAST(kinds AS VARCHAR) ELSE '5+' END, count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'element', symbol, CAST(sum(c) AS BIGINT) FROM s GROUP BY 2""")
def profile_report(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("zn"))
    atoms = (table(spark, sf_dir, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey"))
             .join(F.broadcast(elements(spark)), "zn").select(F.col("l_orderkey").alias("structure_id"), "symbol"))
    path = scratch_path(spark, "report")
    jobs.profile_corpus(atoms, None, path)
    return spark.read.schema("metric string, value string, n long").json(path).select("metric", "value", "n")


@query("augment_all")
def augment_all(spark, sf_dir):
    atoms, _ = A.augment(*typed(spark, sf_dir), seed=7)
    return atoms.groupBy("structure_id", "type_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sum_x"))


def opened(spark, sf_dir):
    """Every other structure without a cell, so that it has to be boxed."""
    atoms, structures = typed(spark, sf_dir)
    odd = F.col("structure_id") % 2 == 1
    return atoms, structures.withColumns({"cell": F.when(~odd, F.col("cell")), "pbc": ~odd})


@query("features_with_env")
def features_with_env(spark, sf_dir):
    pairs, types = D.compute_features(*opened(spark, sf_dir))
    sizes = F.transform("env", lambda center: F.size(center))
    return (types.join(pairs.groupBy("structure_id", F.col("type_a").alias("type_id")).agg(F.count(F.lit(1)).alias("n_pairs")),
                       ["structure_id", "type_id"], "left")
                 .select("structure_id", "type_id", F.round(F.col("frac").cast("double"), 6).alias("frac"),
                         F.size("env").alias("n_centers"), F.aggregate(sizes, F.lit(0), lambda a, n: a + n).alias("n_neighbors"), "n_pairs"))


@query("padded_records", "counts", """
    SELECT structure_id, CAST(count(*) AS INT) AS n_types, 64 AS n_rows, CAST(8 - count(*) AS INT) AS empty_slots,
           CAST(count(*) * count(*) AS INT) AS filled_rows FROM counts GROUP BY structure_id""")
def padded_records(spark, sf_dir):
    rows = T.pad_records(T.model_rows(D.packed_features(*typed(spark, sf_dir), with_env=False)))
    used = F.filter("pair_extra", lambda v: F.exists(v, lambda x: x != 0))
    return rows.select("structure_id", "n_types", F.size("rdf").alias("n_rows"), F.size(F.filter("mask", lambda m: ~m)).alias("empty_slots"),
                       F.size(used).alias("filled_rows"))


@query("baseline_model")
def baseline_model(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    labels = atoms.groupBy("structure_id", "type_id").agg((F.max("label")).cast("int").alias("zn"))
    named = labels.groupBy("structure_id").agg(F.map_from_entries(F.collect_list(F.struct("type_id", "zn"))).alias("zns"))
    # training reads the vectors again and again: pooled once next to their labels, they are staged and never shuffled
    pooled = T.pooled_types(D.packed_features(atoms, structures, with_env=False, carry=named))
    vectors = staged(pooled.withColumn("zn", F.element_at("zns", F.col("type_id"))).drop("zns"), "vectors", "zstd")
    probs = learning.predict_baseline(learning.train_baseline(vectors, max_iter=5), vectors)
    return probs.groupBy("structure_id", "type_id").agg(F.round(F.sum("p"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


def _flat_model(batch):
    """A stand-in for a trained model: class z of a type gets weight 1 + z mod (1 + its pair rows)."""
    import numpy as np
    out = []
    for ids in batch["type_ids"]:
        table_ = 1.0 + np.arange(94) % (2 + np.asarray(ids)[:, None])
        out.append(table_ / table_.sum(axis=1, keepdims=True))
    return out


@query("predict_job")
def predict_job(spark, sf_dir):
    atoms, structures = opened(spark, sf_dir)
    using = jobs.Predictor(models={"flat": _flat_model}, pmi=pmi_table(spark, sf_dir), env_draws=2, units="angstrom")
    found = jobs.predict(atoms, structures.drop("n_types"), using)["candidates"]
    return found.groupBy("structure_id", "type_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 6).alias("best"))


@query("build_features_job")
def build_features_job(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    named = atoms.withColumn("zn", F.col("label").cast("int")).join(
        F.broadcast(elements(spark).select("zn", "symbol")), "zn")
    return jobs.build_features(named, structures, scratch_path(spark, "features"), "parts", n_aug=1, seed=7)
