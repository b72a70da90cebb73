"""Reproducible sampling: results depend on ids and seeds, never on partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EDGE_EPS, M_ENV, R_MAX
from ..functions import lattice as L
from ..functions.hashing import hash_key
from ..functions.ordered import row_index, top_k


def linspace_indices(n: Column, k: int) -> Column:
    """Distinct integer parts of k evenly spaced points from 0 to n-1."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    step = (n - 1) / F.lit(float(k - 1))
    points = F.array(*[(F.lit(float(i)) * step).cast("long") for i in range(k - 1)], (n - 1).cast("long"))
    return F.array_distinct(points)


def sample_frames(frames: DataFrame, k: int, keys: list[str], order: list[str]) -> DataFrame:
    """Evenly spaced frames of each system, all of them when there are at most k."""
    numbered = row_index(frames, keys, order, "frame_index")
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    keep = (F.col("_n") <= k) | F.array_contains(linspace_indices(F.col("_n"), k), F.col("frame_index"))
    return numbered.join(sizes, keys).where(keep).drop("_n")


def stride(df: DataFrame, step: int, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Every step-th row of each group, optionally only the first `limit` of those."""
    picked = row_index(df, keys, order, "row_index").where(F.col("row_index") % step == 0)
    if limit is not None:
        picked = picked.where(F.col("row_index") < step * limit)
    return picked


def last_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each group."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(*keys, *[F.col("_m")[c].alias(c) for c in [*order, *rest]])


def sample_n(df: DataFrame, n: int, seed: int, id_cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """n rows in hash order, overall or per group; both forms prune inside each task first."""
    order = [hash_key(seed, *[F.col(c) for c in id_cols]), *[F.col(c) for c in id_cols]]
    if keys:
        return top_k(df, keys, order, n)
    return df.orderBy(*order).limit(n)


def sample_centers(atoms: DataFrame, m: int = M_ENV, seed: int = 12345, draws: int = 1) -> DataFrame:
    """At most m atoms per type, without replacement; one independent choice per draw."""
    base = atoms.select("structure_id", "type_id", "atom_id")

    def pick(draw: int) -> DataFrame:
        order = [hash_key(F.lit(seed + draw), F.col("structure_id"), F.col("atom_id")), F.col("atom_id")]
        return top_k(base, ["structure_id", "type_id"], order, m)

    if draws == 1:
        return pick(0)
    # a task sorts the atoms of one draw only, so its memory does not grow with the number of draws
    return reduce(DataFrame.unionByName, [pick(d).select("structure_id", "type_id", "atom_id", F.lit(d).alias("draw")) for d in range(draws)])


def oversample(df: DataFrame, weights: dict[str, int], source: str = "source") -> DataFrame:
    """Repeat rows of each source k times, numbering the copies; unlisted sources stay single."""
    times = F.lit(1)
    for name, k in weights.items():
        times = F.when(F.col(source) == name, F.lit(k)).otherwise(times)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def interior_crop(atoms: DataFrame, structures: DataFrame, max_atoms: int,
                  min_centers: int = 500) -> tuple[DataFrame, DataFrame]:
    """Bounded-size crop of huge periodic structures: (atoms + is_center, structures).

    Structures that are small, open, too thin to crop or left with too few clean centres pass unchanged
    with every atom a centre. The crop keeps only a non-periodic bounding cell. A point within EDGE_EPS of a bound, as a
fraction, lies on it.
    """
    axes = range(3)
    plan = L.expand_cells(structures.where("pbc"), ["structure_id", "n_atoms"]).where(F.col("n_atoms") > max_atoms)
    shrink = f"power({float(max_atoms)!r}D / n_atoms, 1D / 3D)"
    plan = plan.selectExpr("*", *[f"least(1D, greatest({shrink}, {2 * R_MAX + 4.0}D / h{k})) AS q{k}" for k in axes])
    plan = plan.where("NOT (greatest(q0, q1, q2) >= 1D - 1e-9D AND q0 * q1 * q2 > 0.9D)")
    joined = atoms.join(plan.drop("n_atoms"), "structure_id")
    cells = [f"a{r}{k}" for r in axes for k in axes]
    sizes = [f"{n}{k}" for n in "hq" for k in axes]
    joined = joined.selectExpr(*atoms.columns, *cells, *sizes, *[f"{L.fraction_sql(k)} AS u{k}" for k in axes])
    joined = joined.selectExpr(*atoms.columns, *cells, *sizes, *[f"{L.wrap_sql(f'u{k}')} AS f{k}" for k in axes])
    joined = joined.where(" AND ".join(f"f{k} < q{k} - {EDGE_EPS}D" for k in axes))
    clean = " AND ".join(f"f{k} >= {R_MAX}D / h{k} - {EDGE_EPS}D AND f{k} < q{k} - {R_MAX}D / h{k} - {EDGE_EPS}D" for k in axes)
    others = [c for c in atoms.columns if c not in ("x", "y", "z")]
    joined = joined.selectExpr(*others, *[f"{L.cartesian_sql(k)} AS {c}" for k, c in enumerate("xyz")],
                               f"{clean} AS is_center")
    accepted = (joined.groupBy("structure_id")
                      .agg(F.count_if("is_center").alias("_c"), F.count(F.lit(1)).alias("_kept"))
                      .where(F.col("_c") >= min_centers))
    cropped = joined.join(accepted, "structure_id", "left_semi").select(*atoms.columns, "is_center")
    rest = atoms.join(accepted, "structure_id", "left_anti").withColumn("is_center", F.lit(True))
    rows = ", ".join("array(" + ", ".join(f"a{k}{c} * q{k}" for c in axes) + ")" for k in axes)
    shrunk = accepted.join(plan, "structure_id").selectExpr("structure_id", "_kept", f"array({rows}) AS _cell")
    cells = (structures.join(shrunk, "structure_id", "left")
                       .withColumn("cell", F.coalesce("_cell", "cell"))
                       .withColumn("pbc", F.col("pbc") & F.col("_cell").isNull())
                       .withColumn("n_atoms", F.coalesce("_kept", "n_atoms").cast(structures.schema["n_atoms"].dataType))
                       .drop("_cell", "_kept"))
    return cropped.unionByName(rest), cells
