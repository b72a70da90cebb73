"""The jobs a user runs: corpus to feature store, prediction, calibration, evaluation and profiling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import K_ENV, M_ENV, MAX_TYPES, UNITS
from ..elements import elements
from ..operators import calibration, corpus, decode, gates, scoring, tokens, units
from ..operators.augment import make_variants, test_time_variants
from ..operators.descriptors import average_frames, compute_features, packed_features
from ..operators.geometry import relabel_types, rescale, vacuum_box
from ..operators.neighbors import environment_sets, nn_distance, pack_environments
from ..operators.sampling import interior_crop, sample_centers
from ..session import staged
from ..sources import store

SID = "structure_id"


def build_features(atoms: DataFrame, structures: DataFrame, path: str, source: str, rules: gates.Rules = gates.Rules(),
                   n_aug: int = 1, seed: int = 0) -> DataFrame:
    """Gate, expand, describe and store a corpus; returns the count of structures per gate outcome.

    `atoms` carries label, symbol and zn. One job over the whole corpus: every step is keyed by structure. Records hold
    MAX_TYPES types, so structures with more are rejected and counted whatever the rules say. A repeated job replaces
    the records of its source.
    """
    rules = replace(rules, max_types=min(rules.max_types or MAX_TYPES, MAX_TYPES))
    gated = gates.quality_gate(gates.structure_stats(atoms, structures), rules)
    passed = staged(gates.kept(gated).select(SID), "passed")
    good = relabel_types(atoms.join(passed, SID, "left_semi"))
    gids = corpus.group_id(good, [SID]).select(F.col(SID).alias("parent_id"), "gid")
    points, cells = make_variants(good, structures.join(passed, SID, "left_semi"), n_aug, seed)
    points, cells = staged(points, "variant-atoms"), staged(cells, "variant-cells")
    labels = (points.groupBy(SID, "type_id").agg(F.max("zn").alias("zn")).groupBy(SID).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("type_id", "zn"))), lambda e: e["zn"]).alias("labels")))
    named = labels.join(cells.select(SID, "parent_id"), SID).join(gids, "parent_id").withColumn("_types", F.size("labels"))
    # the place in the store is known beforehand: atoms go there, so that the dense records are not moved
    named = staged(store.with_part(named, ("_types",)), "named")
    records = tokens.model_rows(packed_features(points, cells, carry=named, by=("_types", "_part")))
    store.replace_features(records.drop("_types", "_part"), path, source, placed=True)
    return gates.reject_reasons(gated)


@dataclass
class Predictor:
    """Models and statistics used together. `models` maps a name to a batch function for `score_batch`."""

    models: dict[str, Callable]
    pmi: DataFrame | None = None
    calibration: DataFrame | None = None
    class_weights: DataFrame | None = None
    debias: float = 0.0
    fuse: str = "conf"
    env_draws: int = 4
    max_atoms: int | None = None  # reduce larger periodic structures to an interior crop of about this many
    variants: int = 0  # jittered copies of each frame, pooled with it
    units: str = "auto"
    confidence: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def detect_units(atoms: DataFrame, structures: DataFrame, confidence=None) -> DataFrame:
    """Unit verdict per structure. `confidence(atoms, structures)` scores one rescaled copy per unit."""
    nn = staged(nn_distance(atoms), "nn")
    scores = None
    if confidence is not None:
        for unit, _, scale in UNITS:
            factor = structures.select(SID, F.lit(scale).alias("scale"))
            found = confidence(*rescale(atoms, structures, factor)).select(SID, F.lit(unit).alias("unit"), "confidence")
            scores = found if scores is None else scores.unionByName(found)
    return units.unit_gate(structures, nn, scores)


def jittered_frames(atoms: DataFrame, structures: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Each frame with n mildly jittered copies as further frames of its system; ids of copies become 'frame#k'.

    The frames of a system keep their order and come before all copies.
    """
    moved = test_time_variants(atoms, n)
    name = F.when(F.col("variant") == 0, F.col(SID).cast("string")).otherwise(
        F.concat_ws("#", F.col(SID).cast("string"), F.col("variant").cast("string")))
    points = moved.withColumn(SID, name).drop("variant")
    whole = W.partitionBy("system_id")
    copies = structures.withColumn("_frames", F.max("frame_id").over(whole) + 1).withColumn(
        "variant", F.explode(F.sequence(F.lit(0), F.lit(n))))
    copies = copies.withColumns({"frame_id": F.col("frame_id") + F.col("variant") * F.col("_frames"), SID: name})
    return staged(points, "variant-atoms"), staged(copies.drop("variant", "_frames"), "variant-frames")


def predict(atoms: DataFrame, structures: DataFrame, using: Predictor) -> dict[str, DataFrame]:
    """Ranked candidates and conformal sets for every type of every system.

    Frames of one system share `system_id` (defaults to the structure itself) and are log-pooled together
    with the environment draws and the frame-averaged descriptor. Returns verdicts, probs, candidates, sets.
    """
    if "system_id" not in structures.columns:
        structures = structures.withColumn("system_id", F.col(SID)).withColumn("frame_id", F.lit(0))
    atoms = staged(atoms if "type_id" in atoms.columns else relabel_types(atoms), "predict-atoms")
    if using.units == "auto":
        verdicts = staged(detect_units(atoms, structures, using.confidence), "verdicts")
    else:
        scale = {u: s for u, _, s in UNITS}[using.units]
        verdicts = structures.select(SID, F.lit("atoms").alias("verdict"), F.lit(using.units).alias("unit"), F.lit(scale).alias("scale"))
    atoms, structures = rescale(atoms, structures, verdicts.where("verdict = 'atoms'"))
    if not structures.where("cell IS NULL OR NOT pbc").isEmpty():  # once, for descriptors and environments alike
        boxed, cells = vacuum_box(atoms, structures)
        atoms, structures = staged(boxed, "boxed-atoms"), staged(cells, "boxed-cells")
    if using.variants:
        atoms, structures = jittered_frames(atoms, structures, using.variants)
    pairs, types = compute_features(atoms, structures, with_env=False, max_atoms=using.max_atoms)
    frames = structures.select(SID, "system_id", "frame_id")
    pairs, types = staged(pairs.join(frames, SID), "pairs"), staged(types.join(frames, SID), "types")

    # one neighbour search over the union of all draws' centres; crops keep only complete centres
    points, cells, centers = atoms, structures, atoms
    if using.max_atoms is not None:
        points, cells = interior_crop(atoms, structures, using.max_atoms)
        centers = points.where("is_center")
    picks = staged(sample_centers(centers, M_ENV, 1000, draws=max(2, using.env_draws)), "draws")
    picks = picks.where(F.col("draw") < max(1, using.env_draws))
    found = staged(environment_sets(points, cells, picks.select(SID, "atom_id").distinct(), K_ENV), "environments")
    rows = None
    for draw in range(max(1, using.env_draws)):
        mine = picks.where(F.col("draw") == draw).select(SID, F.col("atom_id").alias("i"))
        env = pack_environments(found.join(mine, [SID, "i"], "left_semi"))
        described = types.join(env, [SID, "type_id"], "left")
        part = tokens.padded_rows(pairs, described).join(frames.select(SID, "system_id"), SID)
        part = part.withColumn("sample", F.lit(draw))
        rows = part if rows is None else rows.unionByName(part)
        if draw == 0:
            first = described
    mean_pairs, mean_types = average_frames(pairs, first)
    averaged = tokens.padded_rows(mean_pairs.withColumnRenamed("system_id", SID), mean_types.withColumnRenamed("system_id", SID))
    rows = rows.unionByName(averaged.withColumn("system_id", F.col(SID)).withColumn("sample", F.lit(-1)))
    rows = staged(rows.withColumn(SID, F.col("system_id")).drop("system_id"), "model-input")

    keys = [SID, "type_id", "model", "zn"]
    logs = None
    for name, model in using.models.items():
        part = scoring.log_pool(scoring.score_batch(rows, model, name), keys)
        logs = part if logs is None else logs.unionByName(part)
    fused = scoring.fuse(logs, using.fuse)
    if using.debias and using.class_weights is not None:
        fused = scoring.debias(fused, using.class_weights, using.debias)
    start = types.groupBy("system_id").agg(F.min("frame_id").alias("frame_id"))
    fractions = types.join(start, ["system_id", "frame_id"]).groupBy(F.col("system_id").alias(SID)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("type_id", "frac"))), lambda e: e["frac"]).alias("frac"))
    if using.pmi is None:
        probs = scoring.softmax(fused, "logp", scoring.ITEM).drop("logp")
    else:
        probs = decode.marginals(decode.beam_rerank(staged(fused, "fused"), fractions, using.pmi))
    probs = staged(probs, "probs")
    out = {"verdicts": verdicts, "probs": probs, "candidates": with_symbols(scoring.top_candidates(probs, 5))}
    if using.calibration is not None:
        out["sets"] = conformal_sets(probs, using.calibration)
    return out


def with_symbols(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(elements(df.sparkSession).select("zn", "symbol")), "zn", "left")


def conformal_sets(probs: DataFrame, calib: DataFrame) -> DataFrame:
    """Candidate sets from temperature-scaled probabilities; `calib` is the row `calibrate` returns."""
    tuned = calibration.attach(probs, calib.select("temperature"))
    scaled = scoring.softmax(tuned.withColumn("_z", scoring.log_of() / F.col("temperature")), "_z", scoring.ITEM)
    return calibration.raps_sets(scaled.select(*scoring.ITEM, "zn", "p"), calib)


def calibrate(probs: DataFrame, truth: DataFrame, coverage: float = 0.9, lam: float = calibration.LAMBDA,
              k_reg: int = calibration.K_REG) -> DataFrame:
    """One row: temperature, qhat, lam, k_reg, coverage, n_cal."""
    grid = calibration.fit_temperature(probs, truth)
    best = grid.where("best").select("temperature")
    tuned = calibration.attach(probs, best)
    scaled = scoring.softmax(tuned.withColumn("_z", scoring.log_of() / F.col("temperature")), "_z", scoring.ITEM)
    scores = calibration.raps_scores(scaled.select(*scoring.ITEM, "zn", "p"), truth, lam, k_reg)
    row = calibration.attach(calibration.raps_quantile(scores, coverage), best)
    return row.select("temperature", "qhat", F.lit(lam).alias("lam"), F.lit(k_reg).alias("k_reg"),
                      F.lit(coverage).alias("coverage"), F.col("n").alias("n_cal"))


def evaluate(probs: DataFrame, truth: DataFrame, case: str = SID, bucket: str | None = None) -> DataFrame:
    """Hits per case with a total row, or a ranking report per bucket when `truth` carries that column."""
    ranks = scoring.join_truth(probs, truth)
    if bucket is None:
        return scoring.hits_at_k(ranks, case)
    labelled = ranks.join(truth.select(*scoring.ITEM, bucket), scoring.ITEM)
    return scoring.rank_report(labelled, bucket)


def profile_corpus(atoms: DataFrame, systems: DataFrame | None, path: str) -> None:
    """Write the corpus histograms as JSON lines."""
    store.write_report(corpus.profile(atoms, systems), path)

