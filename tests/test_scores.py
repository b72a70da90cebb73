"""Fusion, decoding, calibration and unit inference on small closed-form cases."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latticework.elements import ELEMENTS, OXIDATION, SYMBOLS, elements
from latticework.operators import calibration as K
from latticework.operators import corpus as C
from latticework.operators import decode as J
from latticework.operators import sampling as S
from latticework.operators import scoring as P
from latticework.operators import units as U


def test_element_tables():
    assert len(ELEMENTS) == 94 and len(OXIDATION) == 94
    assert (SYMBOLS[1], SYMBOLS[8], SYMBOLS[26], SYMBOLS[57], SYMBOLS[79], SYMBOLS[94]) == ("H", "O", "Fe", "La", "Au", "Pu")
    masses = [m for _, _, m in ELEMENTS]
    assert sum(b < a for a, b in zip(masses, masses[1:])) == 5  # Ar/K, Co/Ni, Te/I, Th/Pa, U/Np


def long_probs(spark, tables):
    rows = [("s", 0, m, z, float(p)) for m, table in tables.items() for z, p in enumerate(table, 1)]
    return spark.createDataFrame(rows, "structure_id string, type_id int, model string, zn int, p double")


@pytest.mark.parametrize("mode,want", [("probmean", (.7, .3)), ("logmean", (.75, .25))])
def test_fusion(spark, mode, want):
    logs = long_probs(spark, {"a": (.9, .1), "b": (.5, .5)}).withColumn("logp", F.log("p"))
    got = [math.exp(r.logp) for r in P.fuse(logs, mode).orderBy("zn").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_fusion_conf_and_median(spark):
    tables = {"a": (.9, .1), "b": (.5, .5)}
    logs = long_probs(spark, tables).withColumn("logp", F.log("p"))
    w = np.exp([4 * .9, 4 * .5])
    w /= w.sum()
    mixed = w @ np.array(list(tables.values()))
    got = [math.exp(r.logp) for r in P.fuse(logs, "conf").orderBy("zn").collect()]
    assert np.allclose(got, mixed / mixed.sum(), atol=1e-9)
    low = np.minimum(*map(np.array, tables.values()))
    got = [math.exp(r.logp) for r in P.fuse(logs, "median").orderBy("zn").collect()]
    assert np.allclose(got, low / low.sum(), atol=1e-9)
    with pytest.raises(ValueError):
        P.fuse(logs, "other")


def test_raps_set_includes_the_crossing_class(spark):
    probs = long_probs(spark, {"a": (.5, .3, .15, .05)}).drop("model")
    calib = spark.createDataFrame([(.9, .02, 1)], "qhat double, lam double, k_reg int")
    assert K.raps_sets(probs, calib).first().members == [1, 2, 3]


def test_raps_set_ends_at_a_score_equal_to_the_threshold(spark):
    # (p1 + p2 + p3) - p3 is below p1 + p2 by rounding; the threshold is the second class's own score
    p = (.31, .3, .29, .1)
    assert p[0] + p[1] + p[2] - p[2] < p[0] + p[1]
    calib = spark.createDataFrame([(p[0] + p[1], .02, 4)], "qhat double, lam double, k_reg int")
    assert K.raps_sets(long_probs(spark, {"a": p}).drop("model"), calib).first().members == [1, 2]


def test_calibration_matches_numpy(spark):
    rng = np.random.default_rng(1)
    raw = rng.dirichlet(np.full(12, .5), 300)
    truth = np.array([rng.choice(12, p=p) for p in raw])
    rows = [(str(i), 0, z + 1, float(p)) for i, table in enumerate(raw) for z, p in enumerate(table)]
    probs = spark.createDataFrame(rows, "structure_id string, type_id int, zn int, p double").repartition(7)
    known = spark.createDataFrame([(str(i), 0, int(t) + 1) for i, t in enumerate(truth)], "structure_id string, type_id int, true_zn int")
    grid = K.fit_temperature(probs, known).toPandas().set_index("temperature")
    logs = np.log(raw + 1e-12)
    want = []
    for t in np.linspace(.5, 8, 76):
        z = logs / t
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        want.append(-np.log(p[np.arange(300), truth] + 1e-12).mean())
    assert np.allclose(grid.sort_index()["nll"], want) and grid["best"].sum() == 1
    assert math.isclose(grid.index[grid["best"]][0], np.linspace(.5, 8, 76)[int(np.argmin(want))], abs_tol=1e-9)
    order = np.argsort(-raw, axis=1)
    scores = []
    for i in range(300):
        rank = int(np.where(order[i] == truth[i])[0][0])
        scores.append(raw[i][order[i]][:rank + 1].sum() + .02 * max(0, rank + 1 - 4))
    q = np.quantile(scores, min(1, math.ceil(301 * .9) / 300), method="higher")
    assert math.isclose(K.raps_quantile(K.raps_scores(probs, known), .9).first().qhat, q)


def test_neutrality(spark):
    df = spark.createDataFrame([([3, 15, 16], [3 / 8, 1 / 8, 4 / 8]), ([3, 17], [.3, .7]), ([200, 11], [.5, .5])], "zs array<int>, x array<double>")
    got = [r.n for r in df.select(J.neutrality(F.col("zs"), F.col("x")).alias("n")).collect()]
    assert got[0] == 0 and math.isclose(got[1], .4) and math.isclose(got[2], .5)


def test_beam_search_prunes_by_score_alone(spark):
    rng = np.random.default_rng(9)
    logp = np.log(rng.dirichlet(np.ones(94), 5))
    rows = [("s", t, z + 1, float(v)) for t, table in enumerate(logp) for z, v in enumerate(table)]
    table = spark.createDataFrame(rows, "structure_id string, type_id int, zn int, logp double").repartition(6)
    partials = [(0.0, ())]
    for t in range(5):
        cand = np.argsort(-logp[t])[:6]
        partials = sorted(((s + logp[t, c], zs + (int(c) + 1,)) for s, zs in partials for c in cand), key=lambda e: -e[0])[:40]
    got = J.beam_candidates(table, top_k=6, beam=40).collect()
    assert sorted((tuple(r.zs) for r in got)) == sorted(zs for _, zs in partials)
    assert np.allclose(sorted(r.s for r in got), sorted(s for s, _ in partials))


def test_marginals_sum_to_one(spark):
    df = spark.createDataFrame([("s", [1, 2], -1.0), ("s", [3, 2], -2.0)], "structure_id string, zs array<int>, score double")
    table = J.marginals(df).toPandas()
    assert len(table) == 188 and np.allclose(table.groupby("type_id")["p"].sum(), 1)
    first = table[table.type_id == 0].set_index("zn")["p"]
    assert math.isclose(first[1], 1 / (1 + math.exp(-1)), rel_tol=1e-9)


def test_group_id(spark):
    df = spark.createDataFrame([("s", e) for e in ("P", "Li", "S", "Li")], "structure_id string, symbol string")
    row = C.assign_split(C.group_id(df, ["structure_id"])).first()
    assert (row.gid, row.split, row.n_elements) == (204866495781871, "train", 3)


def test_linspace_indices(spark):
    for n, k in itertools.product((1, 2, 5, 11, 48, 97, 1000), (1, 2, 4, 7)):
        want = sorted(set(np.linspace(0, n - 1, min(k, n)).astype(int).tolist())) if n > k else list(range(n))
        frames = spark.range(n).selectExpr("'s' AS system_id", "id AS frame_id") if n <= 48 else None
        if frames is not None:
            got = sorted(r.frame_index for r in S.sample_frames(frames, k, ["system_id"], ["frame_id"]).collect())
        else:
            got = sorted(spark.range(1).select(S.linspace_indices(F.lit(n).cast("long"), k).alias("i")).first().i)
        assert got == want, (n, k)


def test_mass_lookup(spark):
    found = C.nearest_lookup(spark.createDataFrame([(15.9994,)], "mass double"), elements(spark)).orderBy("rank").collect()
    assert [r.symbol for r in found] == ["O", "N", "F"]


def test_unit_inference(spark):
    nn = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("grain", 0.002), ("nm", .2), ("nm", .21)], "structure_id string, d double")
    got = {r.structure_id: (r.verdict, r.unit) for r in U.infer_units(U.unit_scores(nn)).collect()}
    assert got == {"a": ("atoms", "angstrom"), "grain": ("not_atoms", None), "nm": ("atoms", "nm")}


@pytest.mark.parametrize("bohr,want", [(.55, "angstrom"), (.85, "bohr")])
def test_unit_tie_break_keeps_angstrom_unless_clearly_beaten(spark, bohr, want):
    nn = spark.createDataFrame([("a", 2.0), ("a", 2.1)], "structure_id string, d double")
    conf = spark.createDataFrame([("a", "angstrom", .5), ("a", "bohr", bohr)], "structure_id string, unit string, confidence double")
    row = U.infer_units(U.unit_scores(nn), conf).first()
    assert row.unit == want and row.tiebreak


def test_rescored_batches(spark):
    rows = spark.createDataFrame([("s", [0, 1])], "structure_id string, type_ids array<int>")
    got = P.score_batch(rows, lambda b: [[[.2, .8], [.6, .4]] for _ in range(len(b))], "m").toPandas()
    assert got["p"].tolist() == [.2, .8, .6, .4]
    conf = P.mean_confidence(spark.createDataFrame(pd.DataFrame(got))).first().confidence
    assert math.isclose(conf, .7)


def test_neutrality_of_many_types_equals_all_combinations(spark):
    rng = np.random.default_rng(12)
    rows = []
    for n in list(range(1, 9)) * 3:
        zs = [int(z) for z in rng.integers(1, 95, n)]
        x = rng.integers(1, 9, n)
        rows.append((zs, [float(v) for v in x / x.sum()]))
    got = [r.n for r in spark.createDataFrame(rows, "zs array<int>, x array<double>").select(J.neutrality(F.col("zs"), F.col("x")).alias("n")).collect()]
    for (zs, x), n in zip(rows, got):
        least = min(abs(float(np.dot(x, q))) for q in itertools.product(*[OXIDATION.get(z, (0,)) for z in zs]))
        assert abs(n - (0.0 if least < 1e-9 else least)) < 1e-12
    # twenty types of four charges each: 4^20 combinations
    four = [z for z, q in OXIDATION.items() if len(q) == 4]
    zs = [four[k % len(four)] for k in range(20)]
    x = (rng.permutation(20) + 1) / 210
    began = time.time()
    found = spark.createDataFrame([(zs, x.tolist())], "zs array<int>, x array<double>").select(
        J.neutrality(F.col("zs"), F.col("x")).alias("n")).first().n
    assert time.time() - began < 60
    low, high = (np.sort([sum(t) for t in itertools.product(*[x[k] * np.array(OXIDATION[zs[k]]) for k in part])])
                 for part in (range(10), range(10, 20)))
    at = np.searchsorted(high, -low)
    least = min(np.abs(low + high[np.clip(at + k, 0, len(high) - 1)]).min() for k in (-1, 0))
    assert abs(found - (0.0 if least < 1e-9 else least)) < 1e-12


def test_pruned_candidates_are_the_best_of_all(spark):
    rng = np.random.default_rng(13)
    logp = np.log(rng.dirichlet(np.ones(94), (3, 5)))
    rows = [(s, t, z + 1, float(logp[s, t, z])) for s in range(3) for t in range(5) for z in range(94)]
    got = J.beam_candidates(spark.createDataFrame(rows, "structure_id int, type_id int, zn int, logp double"), top_k=10, beam=60).collect()
    for s in range(3):
        partial = [(0.0, ())]
        for t in range(5):
            best = np.argsort(-logp[s, t])[:10]
            partial = sorted((c - logp[s, t, z], zs + (int(z) + 1,)) for c, zs in partial for z in best)[:60]
        assert sorted(tuple(r.zs) for r in got if r.structure_id == s) == sorted(zs for _, zs in partial)


@pytest.fixture(scope="module")
def short_structure(spark, tmp_path_factory):
    """Tables whose last structure has two types; the others have four."""
    folder = tmp_path_factory.mktemp("short")
    draws = np.random.default_rng(5).normal(size=(10, 64)).astype("float32")
    vectors = pd.DataFrame({"vec_id": range(10), "label": [i % 10 for i in range(10)], "embedding": list(draws)})
    vectors.to_parquet(folder / "embeddings.parquet")
    pd.DataFrame({"l_orderkey": [1, 1, 2], "l_partkey": [1, 2, 2]}).to_parquet(folder / "lineitem.parquet")
    pd.DataFrame({"p_partkey": [1, 2], "p_brand": ["Brand#3", "Brand#8"]}).to_parquet(folder / "part.parquet")
    return str(folder)


def test_candidates_of_a_structure_with_fewer_types(spark, short_structure):
    import duckdb

    from latticework.registry import ORACLES, QUERIES, load_all
    load_all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{short_structure}/embeddings.parquet'")
    want = {(int(a), b, round(c, 5)) for a, b, c in con.execute(ORACLES["beam_candidates"]).fetchall()}
    rows = QUERIES["beam_candidates"](spark, short_structure).collect()
    assert {(r.structure_id, r.zs, round(r.s, 5)) for r in rows} == want
    assert sum(r.structure_id == 2 for r in rows) == 100 and len(rows) == 700


def test_external_scores_of_a_structure_with_fewer_types(spark, short_structure):
    from latticework.registry import QUERIES, load_all
    load_all()
    got = QUERIES["rerank_external"](spark, short_structure).toPandas()
    assert got.groupby("structure_id").type_id.nunique().to_dict() == {0: 4, 1: 4, 2: 2}
    assert np.allclose(got.groupby(["structure_id", "type_id"]).p.sum(), 1, atol=1e-4)
