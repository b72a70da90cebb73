"""Per-type-pair descriptors of all structures at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import (BIN_WIDTH, CN_RADII, K_ENV, M_ENV, MAX_TYPES, N_BINS, N_GLOB, N_PAIR_EXTRA, R_MAX, RDF_CLIP, SMEAR_REACH,
                         SMEAR_SIGMA_BINS)
from ..functions import lattice as L
from ..functions.ordered import quantiles
from ..session import staged
from .geometry import type_counts, vacuum_box
from .neighbors import SMALL, by_size, neighbor_pairs, packed_environments
from .profiles import gathered_profiles
from .sampling import interior_crop, sample_centers
from .tokens import pack_pairs, pack_types

PAIR = ["structure_id", "type_a", "type_b"]


def smear_kernel() -> list[float]:
    taps = [math.exp(-0.5 * (k / SMEAR_SIGMA_BINS) ** 2) for k in range(-SMEAR_REACH, SMEAR_REACH + 1)]
    return [t / sum(taps) for t in taps]


def pair_histogram(pairs: DataFrame) -> DataFrame:
    """(structure_id, type_a, type_b, bin, n) over the occupied bins."""
    return (pairs.withColumn("bin", L.distance_bin(F.col("d")))
                 .groupBy(*PAIR, "bin").agg(F.count(F.lit(1)).alias("n")))


def histogram_and_minima(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histogram and per-atom minima from one pass over the pair join.

    Grouping sets feed both aggregations from the same rows and the result is staged, so the join, the
    dearest step, runs exactly once however often the two tables are read afterwards.
    """
    keyed = pairs.withColumn("bin", L.distance_bin(F.col("d")))
    both = (keyed.groupingSets([[F.col(c) for c in (*PAIR, "bin")], [F.col(c) for c in (*PAIR, "i")]],
                               *[F.col(c) for c in (*PAIR, "bin", "i")])
                 .agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"), F.grouping("i").alias("_no_atom")))
    both = staged(both, "pair-stats")
    hist = both.where(F.col("_no_atom") == 1).select(*PAIR, "bin", "n")
    minima = both.where(F.col("_no_atom") == 0).select("structure_id", "type_a", "i", "type_b", "d")
    return hist, minima


def type_grid(counts: DataFrame) -> DataFrame:
    """Every ordered type pair of a structure: (structure_id, type_a, type_b, n_a, n_b)."""
    listed = counts.groupBy("structure_id").agg(F.collect_list(F.struct("type_id", "n")).alias("t"))
    return (listed.withColumn("a", F.explode("t")).withColumn("b", F.explode("t"))
                  .select("structure_id", F.col("a.type_id").alias("type_a"), F.col("b.type_id").alias("type_b"),
                          F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")))


def coordination(hist: DataFrame, grid: DataFrame) -> DataFrame:
    """`grid` plus running coordination numbers cn0..cn3; the checkpoint's own bin is included."""
    stops = [min(int(r / BIN_WIDTH), N_BINS - 1) for r in CN_RADII]
    sums = hist.groupBy(*PAIR).agg(*[
        F.sum(F.when(F.col("bin") <= stop, F.col("n")).otherwise(0)).alias(f"s{k}") for k, stop in enumerate(stops)])
    return grid.join(sums, PAIR, "left").selectExpr(
        *grid.columns, *[f"coalesce(s{k}, 0) / greatest(n_a, 1) AS cn{k}" for k in range(len(stops))])


def nn_stats(minima: DataFrame, grid: DataFrame) -> DataFrame:
    """Median and 10th percentile over atoms of type a of the nearest distance to type b.

    Atoms that reach no b count as R_MAX; they enter as one weighted value instead of one row each.
    """
    found = minima.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_found"))
    gaps = (grid.join(found, PAIR, "left")
                .select(*PAIR, F.lit(R_MAX).alias("d"),
                        (F.col("n_a") - F.coalesce("n_found", F.lit(0))).alias("w")).where(F.col("w") > 0))
    weighted = minima.select(*PAIR, "d", F.lit(1).cast("long").alias("w")).unionByName(gaps)
    stats = quantiles(weighted, PAIR, "d", {"nn_med": 0.5, "nn_p10": 0.1}, F.col("w"))
    return grid.select(*PAIR).join(stats.drop("n"), PAIR, "left").fillna(R_MAX, ["nn_med", "nn_p10"])


def partial_rdf(hist: DataFrame, density: DataFrame) -> DataFrame:
    """Smeared, ideal-gas normalised g_ab(r): (structure_id, type_a, type_b, bin, g) over bins with any mass.

    `density` holds (structure_id, type_a, type_b, n_a, rho_b). Both sides meet once, partitioned by type
    pair; spreading each count over nine bins and re-summing then needs no further shuffle and stays in
    generated code. A pair has at most 64 histogram rows, so the key cannot be skewed.
    """
    taps = ", ".join(f"struct({k - SMEAR_REACH} AS o, {w!r}D AS w)" for k, w in enumerate(smear_kernel()))
    spread = (hist.select(*PAIR, "bin", "n").join(density.select(*PAIR, "n_a", "rho_b"), PAIR)
                  .selectExpr(*PAIR, "bin", "n", "n_a", "rho_b", f"explode(array({taps})) AS t")
                  .selectExpr(*PAIR, "bin + t.o AS bin", "n * t.w AS h", "n_a * rho_b AS scale")
                  .where(f"bin BETWEEN 0 AND {N_BINS - 1}")
                  .groupBy(*PAIR, "bin").agg(F.sum("h").alias("h"), F.max("scale").alias("scale")))
    shell = f"{4.0 / 3.0 * math.pi!r}D * (power((bin + 1) * {BIN_WIDTH}D, 3) - power(bin * {BIN_WIDTH}D, 3))"
    return spread.selectExpr(*PAIR, "bin", f"least(h / greatest(scale * ({shell}), 1e-12D), {RDF_CLIP}D) AS g")


def rdf_summary(rdf: DataFrame, grid: DataFrame, dense: bool = True) -> DataFrame:
    """`grid` plus the first highest bin (peak_pos scaled to the cutoff, peak_h = ln(1+g)) and, if wanted,
    the 64-bin array `rdf`, from a single aggregation of the long form."""
    lists = [F.sort_array(F.collect_list(F.struct("bin", "g"))).alias("_s")] if dense else []
    packed = rdf.groupBy(*PAIR).agg(F.max(F.struct("g", (-F.col("bin")).alias("nb"))).alias("_m"), *lists)
    # zeros are laid between the occupied bins, so each of the at most 64 entries is visited once
    filled = "flatten(transform(_s, (e, i) -> concat(array_repeat(0D, e.bin - if(i = 0, -1, _s[i - 1].bin) - 1), array(e.g))))"
    full = (f"if(_s IS NULL, array_repeat(0D, {N_BINS}), "
            f"concat({filled}, array_repeat(0D, {N_BINS - 1} - element_at(_s, -1).bin))) AS rdf")
    return grid.join(packed, PAIR, "left").selectExpr(
        *grid.columns, f"(coalesce(-_m.nb, 0) + 0.5D) * {BIN_WIDTH}D / {R_MAX}D AS peak_pos",
        "log1p(coalesce(_m.g, 0D)) AS peak_h", *([full] if dense else []))


def pair_features(shape: DataFrame, nn: DataFrame) -> DataFrame:
    """(pair key, rdf, pair_extra): the eight scalar channels of each type pair next to its RDF."""
    extra = ", ".join([*[f"log1p(cn{k})" for k in range(len(CN_RADII))], f"nn_med / {R_MAX}D", f"nn_p10 / {R_MAX}D",
                       "peak_pos", "peak_h"])
    return shape.join(nn, PAIR).selectExpr(*PAIR, "rdf", f"array({extra}) AS pair_extra")


def global_features(counts: DataFrame, structures: DataFrame) -> DataFrame:
    """(structure_id, type_id, frac, glob[ln density, 1, 1/T])."""
    whole = W.partitionBy("structure_id")
    volume = structures.select("structure_id", L.volume(F.col("cell")).alias("volume"))
    return (counts.withColumn("_all", F.sum("n").over(whole)).withColumn("_t", F.count(F.lit(1)).over(whole))
                  .join(volume, "structure_id")
                  .select("structure_id", "type_id", (F.col("n") / F.col("_all")).alias("frac"),
                          F.array(F.log(F.col("_all") / F.col("volume")), F.lit(1.0), 1.0 / F.col("_t")).alias("glob")))


def density_grid(grid: DataFrame, structures: DataFrame) -> DataFrame:
    volume = structures.select("structure_id", L.volume(F.col("cell")).alias("volume"))
    return grid.join(volume, "structure_id").select(*PAIR, "n_a", (F.col("n_b") / F.col("volume")).alias("rho_b"))


def pair_profiles(atoms: DataFrame, structures: DataFrame, max_atoms: int | None = None, near: str | None = None) -> DataFrame:
    """(structure_id, type_a, type_b, rdf, pair_extra) of every type pair of structures that all have a cell.

    Structures of up to SMALL atoms, MAX_TYPES types and `max_atoms` are described whole, each in the task that gathers
    it; the others meet by grid cell. `near` as in `gathered_profiles`.
    """
    small, large, tasks = _whole_or_grid(atoms, structures, max_atoms)
    found = []
    if small is not None:
        whole = gathered_profiles(*small, tasks, smear_kernel(), near).withColumn("_p", F.explode("_p"))
        found.append(whole.select(*[c for c in whole.columns if c != "_p"], "_p.*"))
    if large is not None:
        rest = _grid_profiles(*large, max_atoms)
        found.append(rest if near is None else rest.join(structures.select("structure_id", near), "structure_id"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _whole_or_grid(atoms: DataFrame, structures: DataFrame, max_atoms: int | None) -> tuple[tuple | None, tuple | None, int]:
    return by_size(atoms, structures, SMALL if max_atoms is None else min(SMALL, max_atoms), MAX_TYPES)


def packed_features(atoms: DataFrame, structures: DataFrame, with_env: bool = True, max_atoms: int | None = None,
                    seed: int = 12345, carry: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """`compute_features` as one row per structure, in the form of `tokens.pack`: the dense pair rows are not moved.

    The columns of `carry`, one row per structure, travel along; structures it lacks are left out. Structures up to SMALL
    atoms that are alike in its columns `by` lie in one task before they are described, larger ones after it.
    """
    atoms, structures = _boxed(atoms, structures)
    types = pack_types(_type_features(atoms, structures, with_env, max_atoms, seed))
    if carry is not None:
        types = types.join(carry, "structure_id")
    small, large, tasks = _whole_or_grid(atoms, structures, max_atoms)
    found = [] if small is None else [gathered_profiles(*small, tasks, smear_kernel(), None, types, by)]
    if large is not None:
        rest = pack_pairs(_grid_profiles(*large, max_atoms)).join(types, "structure_id")
        found.append(rest.repartition(*by) if by else rest)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _grid_profiles(atoms: DataFrame, structures: DataFrame, max_atoms: int | None) -> DataFrame:
    """`pair_profiles` by the pair join, its histogram and its minima."""
    full = staged(type_counts(atoms), "type-counts")
    if max_atoms is None:
        points, cells, centers = atoms, structures, None
        grid = type_grid(full)
        density = density_grid(grid, structures)
    else:
        points, cells = interior_crop(atoms, structures, max_atoms)
        centers = points.where("is_center")
        counted = full.select("structure_id", "type_id").join(type_counts(centers), ["structure_id", "type_id"], "left")
        grid = type_grid(counted.fillna(0, ["n"]))
        density = (density_grid(type_grid(full), structures).select(*PAIR, "rho_b")
                   .join(grid.select(*PAIR, "n_a"), PAIR))
    hist, minima = histogram_and_minima(neighbor_pairs(points, cells, R_MAX, centers))
    shape = rdf_summary(partial_rdf(hist, density), coordination(hist, density))
    return pair_features(shape, nn_stats(minima, grid))


def compute_features(atoms: DataFrame, structures: DataFrame, with_env: bool = True, max_atoms: int | None = None,
                     seed: int = 12345, near: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Full descriptor: (pairs: rdf, pair_extra) and (types: frac, glob[, env]).

    Cell-less structures get a vacuum box. With `max_atoms`, larger periodic structures are reduced to an
    interior crop: complete-neighbourhood centres only, densities and fractions from the full system.
    """
    atoms, structures = _boxed(atoms, structures)
    return pair_profiles(atoms, structures, max_atoms, near), _type_features(atoms, structures, with_env, max_atoms, seed)


def _boxed(atoms: DataFrame, structures: DataFrame) -> tuple[DataFrame, DataFrame]:
    if structures.where("cell IS NULL OR NOT pbc").isEmpty():
        return atoms, structures
    boxed, structures = vacuum_box(atoms, structures)
    return staged(boxed, "boxed-atoms"), staged(structures, "boxed-cells")


def _type_features(atoms: DataFrame, structures: DataFrame, with_env: bool, max_atoms: int | None, seed: int) -> DataFrame:
    types = global_features(staged(type_counts(atoms), "type-counts"), structures)
    if with_env:
        points, cells, centers = atoms, structures, atoms
        if max_atoms is not None:
            points, cells = interior_crop(atoms, structures, max_atoms)
            centers = points.where("is_center")
        env = packed_environments(points, cells, sample_centers(centers, M_ENV, seed), K_ENV)
        types = types.join(env, ["structure_id", "type_id"], "left")
    return types


def long_rdf(pairs: DataFrame) -> DataFrame:
    """(structure_id, type_a, type_b, bin, g) over the bins with any mass."""
    return pairs.select(*PAIR, F.posexplode("rdf").alias("bin", "g")).where("g > 0")


def average_frames(pairs: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean of every descriptor over a system's frames; environments stay those of the first frame.

    Inputs carry system_id and frame_id next to the descriptor columns.
    """
    frames = types.groupBy("system_id").agg(F.countDistinct("frame_id").alias("n_frames"))

    def mean_array(df: DataFrame, keys: list[str], *columns: tuple[str, int]) -> DataFrame:
        sums = [F.sum(F.get(F.col(c), F.lit(k)).cast("double")).alias(f"{c}{k}") for c, n in columns for k in range(n)]
        return df.groupBy(*keys).agg(*sums).join(frames, "system_id").select(*keys, *[
            F.array(*[F.col(f"{c}{k}") / F.col("n_frames") for k in range(n)]).alias(c) for c, n in columns])

    by_pair, by_type = ["system_id", "type_a", "type_b"], ["system_id", "type_id"]
    fused_pairs = mean_array(pairs, by_pair, ("rdf", N_BINS), ("pair_extra", N_PAIR_EXTRA))
    scalar = (types.groupBy(*by_type).agg(F.sum("frac").alias("_s")).join(frames, "system_id")
                   .select(*by_type, (F.col("_s") / F.col("n_frames")).alias("frac")))
    fused_types = scalar.join(mean_array(types, by_type, ("glob", N_GLOB)), by_type)
    if "env" in types.columns:
        first = types.groupBy(*by_type).agg(F.min_by("env", "frame_id").alias("env"))
        fused_types = fused_types.join(first, by_type)
    return fused_pairs, fused_types


def feature_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str,
                 tolerance: float) -> DataFrame:
    """Largest absolute difference per feature; a key missing on one side counts as a failure."""
    a = left.select(*keys, F.col(name).alias("feature"), F.col(value).alias("_a"))
    b = right.select(*keys, F.col(name).alias("feature"), F.col(value).alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return (a.join(b, [*keys, "feature"], "full_outer").groupBy("feature")
             .agg(F.max(gap).alias("max_abs_diff"), F.count(F.lit(1)).alias("n"),
                  F.count_if(gap.isNull()).alias("n_unmatched"))
             .withColumn("passed", (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance) & (F.col("n_unmatched") == 0)))
