"""End-to-end jobs and augmentation on a small corpus."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.elements import elements
from latticework.operators import augment as A
from latticework.operators import decode as J
from latticework.operators import descriptors as D
from latticework.operators import gates, learning, tokens
from latticework.operators import geometry as G
from latticework.operators import sampling as S
from latticework.plans import jobs
from latticework.sources import store


@pytest.fixture(scope="module")
def corpus(spark):
    """Twelve two-element crystals: the lattice constant gives the elements away."""
    rng = np.random.default_rng(0)
    rows, cells = [], []
    for s in range(12):
        a, names = (4.2, ("Li", "F")) if s % 2 else (5.6, ("Na", "Cl"))
        base = np.array([(i, j, k) for i in range(3) for j in range(3) for k in range(3)], float) * a / 2
        for i, p in enumerate(base + rng.normal(0, .02, base.shape)):
            rows.append((f"s{s}", i, names[i % 2], *map(float, p)))
        cells.append((f"s{s}", (np.eye(3) * a * 1.5).tolist(), True, 27))
    rows.append(("lonely", 0, "O", 0.0, 0.0, 0.0))
    cells.append(("lonely", (np.eye(3) * 9).tolist(), True, 1))
    atoms = spark.createDataFrame(rows, "structure_id string, atom_id long, symbol string, x double, y double, z double")
    atoms = G.map_elements(atoms, elements(spark)).withColumn("label", F.col("symbol"))
    return atoms.cache(), spark.createDataFrame(cells, "structure_id string, cell array<array<double>>, pbc boolean, n_atoms long").cache()


def flat_model():
    """Scores by type fraction; built here so that workers get the function itself, not this module's name."""
    def score(batch):
        out = []
        for fractions in batch["frac"]:
            weights = np.exp(np.outer(np.asarray(fractions), np.arange(1, 95) / 20))
            out.append(weights / weights.sum(axis=1, keepdims=True))
        return out

    return score


def test_feature_job(spark, corpus, tmp_path):
    path = str(tmp_path / "features")
    atoms, structures = corpus
    # nine types do not fit a record
    many = spark.createDataFrame([("many", i, ["Li", "F", "Na", "Cl", "O", "K", "Mg", "Al", "Si"][i % 9], i * .7, i % 3 * 2.1, i % 2 * 2.) for i in range(18)],
                                 "structure_id string, atom_id long, symbol string, x double, y double, z double")
    atoms = atoms.unionByName(G.map_elements(many, elements(spark)).withColumn("label", F.col("symbol")).select(atoms.columns))
    structures = structures.unionByName(spark.createDataFrame([("many", (np.eye(3) * 14).tolist(), True, 18)], structures.schema))
    for _ in range(2):  # the second run replaces what the first one stored
        reasons = jobs.build_features(atoms, structures, path, "demo/1", gates.DYNAMICS, n_aug=2, seed=3)
        assert {r.reason: r.n for r in reasons.collect()} == {"kept": 12, "too_few_atoms": 1, "too_many_types": 1}
    assert store.read_features(spark, [path]).select("source").distinct().first().source == "demo/1"
    stored = store.read_features(spark, [path]).collect()
    assert len(stored) == 36
    for r in stored:
        assert len(r.labels) == r.n_types == len(r.frac) and len(r.rdf) == r.n_types ** 2 and len(r.rdf[0]) == 64
        assert set(r.labels) in ({3, 9}, {11, 17}) and abs(sum(r.frac) - 1) < 1e-6
    assert len({r.gid for r in stored}) == 2 and max(r.n_types for r in stored) > 2


def test_prediction_and_calibration(spark, corpus):
    atoms, cells = corpus
    named = G.relabel_types(atoms.where("structure_id <> 'lonely'"))
    truth = named.select("structure_id", "type_id", F.col("zn").alias("true_zn")).distinct()
    singles, pairs = J.cooccurrence(spark.createDataFrame([(1, 3), (1, 9), (2, 11), (2, 17)], "gid long, zn int"))
    pmi = J.pmi(singles, pairs, spark.createDataFrame([(2,)], "n_sets long"))
    using = jobs.Predictor({"m1": flat_model(), "m2": flat_model()}, pmi=pmi, env_draws=2)
    out = jobs.predict(atoms.drop("type_id"), cells, using)
    verdicts = {r.structure_id: (r.verdict, r.unit) for r in out["verdicts"].collect()}
    assert verdicts["lonely"] == ("not_atoms", None) and verdicts["s0"] == ("atoms", "angstrom")
    probs = out["probs"].toPandas()
    assert len(probs) == 12 * 2 * 94 and np.allclose(probs.groupby(["structure_id", "type_id"])["p"].sum(), 1)
    assert out["candidates"].where("rank = 1").count() == 24
    calib = jobs.calibrate(out["probs"], truth).collect()[0]
    assert calib.n_cal == 24 and .5 <= calib.temperature <= 8
    row = spark.createDataFrame([calib])
    sets = jobs.conformal_sets(out["probs"], row)
    hit = sets.join(truth, ["structure_id", "type_id"]).select(F.avg(F.array_contains("members", F.col("true_zn")).cast("int"))).first()[0]
    assert hit >= .9
    total = [r for r in jobs.evaluate(out["probs"], truth).collect() if r.structure_id is None]
    assert total[0].n == 24


def test_stored_units_are_recovered(spark, corpus):
    atoms, cells = corpus
    shrunk = atoms.withColumns({c: F.col(c) / 10 for c in "xyz"})
    small = cells.withColumn("cell", F.expr("transform(cell, r -> transform(r, v -> v / 10))"))
    verdicts = jobs.detect_units(shrunk, small).where("structure_id <> 'lonely'")
    assert {r.unit for r in verdicts.collect()} == {"nm"}
    back, boxes = G.rescale(shrunk, small, verdicts)
    assert abs(boxes.where("structure_id = 's1'").first().cell[0][0] - 6.3) < 1e-9
    assert back.where("structure_id = 'lonely'").count() == 0


def test_baseline_classifier(spark, corpus):
    atoms, cells = corpus
    named = G.relabel_types(atoms.where("structure_id <> 'lonely'"))
    labels = named.select("structure_id", "type_id", "zn").distinct()
    vectors = tokens.type_tokens(*D.compute_features(named, cells.where("n_atoms > 1"), with_env=False)).cache()
    model = learning.train_baseline(vectors, labels)
    probs = learning.predict_baseline(model, vectors)
    best = jobs.evaluate(probs, labels.withColumnRenamed("zn", "true_zn"))
    assert best.where("structure_id IS NULL").first().top1 == 24


def test_baseline_trains_on_vectors_that_carry_their_labels(spark, corpus):
    atoms, cells = corpus
    named = G.relabel_types(atoms.where("structure_id <> 'lonely'"))
    labels = named.select("structure_id", "type_id", "zn").distinct()
    zns = labels.groupBy("structure_id").agg(F.map_from_entries(F.collect_list(F.struct("type_id", "zn"))).alias("zns"))
    packed = D.packed_features(named, cells.where("n_atoms > 1"), with_env=False, carry=zns)
    vectors = tokens.pooled_types(packed).withColumn("zn", F.element_at("zns", F.col("type_id"))).drop("zns").cache()
    assert {tuple(r) for r in vectors.select("structure_id", "type_id", "zn").collect()} == {tuple(r) for r in labels.collect()}
    own, joined = learning.train_baseline(vectors, max_iter=3), learning.train_baseline(vectors.drop("zn"), labels, max_iter=3)
    assert np.allclose(*[m.stages[0].coefficientMatrix.toArray() for m in (own, joined)], atol=1e-9)


def test_augmentation_is_deterministic_and_valid(spark, corpus):
    atoms, cells = corpus
    named = G.relabel_types(atoms.where("structure_id <> 'lonely'"))
    first, _ = A.make_variants(named, cells, 3, seed=5)
    again, _ = A.make_variants(named.repartition(7), cells.repartition(3), 3, seed=5)
    columns = ["structure_id", "atom_id", "type_id", "x", "y", "z"]
    assert sorted(map(tuple, first.select(columns).collect())) == sorted(map(tuple, again.select(columns).collect()))
    labels = first.groupBy("structure_id", "type_id").agg(F.countDistinct("symbol").alias("s"), F.count("*").alias("n"))
    assert labels.agg(F.max("s"), F.min("n")).first()[0] == 1
    types = first.groupBy("structure_id").agg(F.max("type_id").alias("m"), F.countDistinct("type_id").alias("t"))
    assert types.where("m + 1 <> t").count() == 0 and types.where("t > 2").count() > 0


def test_uneven_splits_cover_every_group(spark, corpus):
    named = G.relabel_types(corpus[0].where("structure_id <> 'lonely'"))
    split = A.type_split(named, 4, uneven_share=1.0)
    sizes = split.groupBy("structure_id").agg(F.countDistinct("type_id").alias("t"), F.count("*").alias("n")).collect()
    assert all(3 <= r.t <= 4 and r.n == 27 for r in sizes)


def test_draws_are_independent_of_partitioning(spark, corpus):
    named = G.relabel_types(corpus[0])
    one = S.sample_centers(named.coalesce(1), 4, 9, draws=3)
    many = S.sample_centers(named.repartition(8), 4, 9, draws=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_profile_report(spark, corpus, tmp_path):
    jobs.profile_corpus(corpus[0], None, str(tmp_path / "report"))
    rows = spark.read.json(str(tmp_path / "report")).collect()
    assert {(r.metric, r.value): r.n for r in rows}["n_distinct", "2"] == 12


def test_lines_of_one_task_are_bounded(spark, monkeypatch):
    from latticework.registry import base
    monkeypatch.setattr(base, "TASK_LINES", 250)
    lines = spark.range(0, 5000, 1, 3).selectExpr("id % 200 AS structure_id", "id AS o", "CAST(id % 7 + 1 AS INT) AS label", "id * 7 AS c")
    found = base._gathered(lines, 5000)
    sizes = found.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) > 10 and sizes.max() <= 1000 and sizes.sum() == 5000
    assert found.where("first").count() == 200 and found.where("n_atoms <> 25").isEmpty()


def test_structure_queries_read_small_parts(spark):
    from latticework.session import tune
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        assert tune(spark, structures=True).conf.get(key) == "16m"
        wide = spark.range(0, 8_000_000, 1, 8).selectExpr("xxhash64(id) AS k", "id AS v").repartition("k")
        wide.write.format("noop").mode("overwrite").save()
        sizes = wide.groupBy(F.spark_partition_id()).count().count()
        assert sizes >= 5
    finally:
        spark.conf.set(key, before)


def test_records_are_not_moved_after_they_are_described(spark, corpus):
    atoms, cells = corpus
    named = G.relabel_types(atoms.where("structure_id <> 'lonely'"))
    gids = named.groupBy("structure_id").agg(F.countDistinct("type_id").cast("int").alias("_types"), F.count("*").alias("gid"))
    places = store.with_part(gids, ("_types",), 5)
    assert places.count() == gids.count() and places.agg(F.countDistinct("_types", "_part")).first()[0] > 1
    records = D.packed_features(named, cells.where("n_atoms > 1"), with_env=False, carry=places, by=("_types", "_part"))
    tasks = records.withColumn("task", F.spark_partition_id()).groupBy("_types", "_part").agg(F.countDistinct("task").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] == 1 and records.count() == gids.count()
    plan = records._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("ArrowEvalPython")]
    assert "Exchange" not in above
