"""Distance joins: fixed-radius neighbours, nearest neighbours and sampled environments.

Catalyst would run a distance predicate as a nested loop. Here each structure gets a grid whose cells are
at least one cutoff wide, the centre side lists the grid cells its sphere can touch, and the pair search is
an equi-join on (structure_id, cell). A huge structure therefore spreads over as many join keys as it has
grid cells; a structure of up to SMALL atoms is gathered into one row and its pairs are formed there.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EDGE_EPS, K_ENV, R_ENV, R_MAX
from ..functions import lattice as L
from ..functions.hashing import uniform
from ..functions.ordered import top_k
from ..session import staged

SMALL = 256
# Atoms of small structures that one task gathers.
TASK_ATOMS = 100_000
# Atom pairs one step of a batch function holds at once.
PAIRS_AT_ONCE = 100_000
_METRIC = [f"w{r}{k}" for r in range(3) for k in range(r, 3)]
_IMAGES = [*_METRIC, *[f"{n}{k}" for n in ("m", "nr", "t") for k in range(3)]]


def _axis_grid(structures: DataFrame, r_max: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per structure: inverse cell v, metric w (d2 = sum w_kl f_k f_l), and per axis the number of
    grid cells g, image reach m (periodic and thinner than two cutoffs), nearest-image switch nr and cutoff t in heights."""
    metric = [(r, k) for r in range(3) for k in range(r, 3)]
    sized = L.expand_cells(structures, ["structure_id", "pbc", "n_atoms", *keep])
    fixed = []
    for k in range(3):
        thin = f"(pbc AND h{k} < {2 * r_max})"
        fixed += [f"CAST(if({thin} OR n_atoms <= {SMALL}, 1, greatest(floor(h{k} / {r_max}D), 1)) AS INT) AS g{k}",
                  f"CAST(if({thin}, ceil({r_max}D / h{k}), 0) AS INT) AS m{k}",
                  f"if(pbc AND NOT {thin}, 1D, 0D) AS nr{k}", f"{r_max}D / h{k} AS t{k}"]
    return sized.selectExpr("structure_id", "pbc", *keep, *[f"v{r}{k}" for r in range(3) for k in range(3)],
                            *[f"w{r}{k}" for r, k in metric], *fixed)


def _probes(k: int) -> str:
    """Grid cells and image shifts one axis has to visit from cell c."""
    around = f"sequence(c{k} - 1, c{k} + 1)"
    return (f"explode_outer(if(g{k} = 1, transform(sequence(-m{k}, m{k}), s -> struct(0 AS cell, s AS shift)), "
            f"transform(if(nr{k} = 1D, array_distinct(transform({around}, v -> pmod(v, g{k}))), "
            f"filter({around}, v -> v >= 0 AND v < g{k})), v -> struct(v AS cell, 0 AS shift)))) AS p{k}")


def by_size(atoms: DataFrame, structures: DataFrame, limit: int = SMALL,
            types: int | None = None) -> tuple[tuple | None, tuple | None, int]:
    """((atoms, structures) of structures up to `limit` atoms, those of larger ones, tasks for the small); None where there are none.

    Small structures can be gathered whole; sizes are counted, never taken from `structures`. With `types`, a structure
    with a type id of that or more counts as large.
    """
    counted = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("_n"), *([] if types is None else [F.max("type_id").alias("_top")]))
    large = F.col("_n") > limit
    if types is not None:
        large = large | (F.col("_top") >= types)
    row = counted.agg(F.count_if(large).alias("large"), F.sum(F.when(~large, F.col("_n"))).alias("atoms")).first()
    tasks = -(-(row.atoms or 0) // TASK_ATOMS)
    if not row.large:
        return (atoms, structures), None, max(tasks, 1)
    if not row.atoms:
        return None, (atoms, structures), 0
    ids = staged(counted.where(large).select("structure_id"), "large")
    return (tuple(df.join(ids, "structure_id", "left_anti") for df in (atoms, structures)),
            tuple(df.join(ids, "structure_id", "left_semi") for df in (atoms, structures)), tasks)


def has_images(structures: DataFrame, r_max: float) -> bool:
    """Whether any periodic cell is thinner than two cutoffs."""
    thin = " OR ".join(f"h{k} < {2 * r_max}" for k in range(3))
    return not L.expand_cells(structures.where("pbc"), ["structure_id"]).where(thin).isEmpty()


def gathered(atoms: DataFrame, structures: DataFrame, r_max: float, tasks: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per small structure: `p`, its (type_id, atom_id, f0, f1, f2) in that order, next to the columns of its cell.

    The atoms move once, by structure; whatever is grouped by structure afterwards needs no further shuffle.
    """
    extra = [c for c in keep if c in atoms.columns]
    packed = (atoms.select("structure_id", "type_id", "atom_id", "x", "y", "z", *extra).repartition(max(tasks, 1), "structure_id")
                   .groupBy("structure_id").agg(
        F.sort_array(F.collect_list(F.struct("type_id", "atom_id", "x", "y", "z", *extra))).alias("_p"),
        F.count(F.lit(1)).alias("n_atoms")))
    cells = structures.select("structure_id", "cell", "pbc", *[c for c in keep if c not in atoms.columns])
    placed = _axis_grid(packed.join(cells, "structure_id"), r_max, ("_p", "n_atoms", *[c for c in keep if c not in atoms.columns]))

    def points(of: str, values: list[str]) -> str:
        return (f"transform({of}, e -> named_struct('type_id', e.type_id, 'atom_id', e.atom_id, "
                + ", ".join([*[f"'f{k}', {v}" for k, v in enumerate(values)], *[f"'{c}', e.{c}" for c in extra]]) + "))")

    placed = placed.withColumn("_p", F.expr(points("_p", [L.fraction_sql(k, "e.x", "e.y", "e.z") for k in range(3)])))
    placed = placed.withColumn("p", F.expr(points("_p", [f"if(pbc, {L.wrap_sql(f'e.f{k}')}, e.f{k})" for k in range(3)])))
    return placed.drop("_p", *[f"v{r}{k}" for r in range(3) for k in range(3)], *[f"g{k}" for k in range(3)])


def shift_sql(k: int, i: str = "a", j: str = "b") -> str:
    """Image shifts of axis k at which two atoms can lie within the cutoff."""
    gap = f"{i}.f{k} - {j}.f{k}"
    return (f"if(m{k} = 0, array(0), sequence(CAST(ceil({gap} - t{k} - 1e-6D) AS INT), CAST(floor({gap} + t{k} + 1e-6D) AS INT)))")


def _small_pairs(atoms: DataFrame, structures: DataFrame, r_max: float, limit: float, centers: DataFrame | None, tasks: int) -> DataFrame:
    """`neighbor_pairs` of structures up to SMALL atoms, every pair formed where its structure was gathered."""
    axes = range(3)
    carried = ["structure_id", *_METRIC, *[f"{n}{k}" for n in ("m", "nr", "t") for k in axes]]
    images = has_images(structures, r_max)
    whole = gathered(atoms, structures, r_max, tasks)
    if centers is None:
        whole = whole.withColumn("q", F.col("p"))
    else:
        wanted = centers.groupBy("structure_id").agg(F.collect_set("atom_id").alias("_c"))
        whole = whole.join(wanted, "structure_id").withColumn("q", F.expr("filter(p, e -> array_contains(_c, e.atom_id))"))
    rows = whole.selectExpr(*carried, "p", "explode(q) AS a").selectExpr(*carried, "a", "explode(p) AS b")
    for k in axes:
        rows = rows.selectExpr("*", f"explode({shift_sql(k)}) AS s{k}" if images else f"0 AS s{k}")
    step = [f"(b.f{k} - (a.f{k} - s{k}) - nr{k} * rint(b.f{k} - (a.f{k} - s{k})))" for k in axes]
    rows = rows.selectExpr("structure_id", "a.atom_id AS i", "b.atom_id AS j", "a.type_id AS type_a", "b.type_id AS type_b",
                           "s0", "s1", "s2", *_METRIC, *[f"{v} AS u{k}" for k, v in enumerate(step)])
    d2 = " + ".join(f"w{r}{k} * u{r} * u{k}" for r in axes for k in range(r, 3))
    return (rows.selectExpr("structure_id", "i", "j", "type_a", "type_b", "s0", "s1", "s2", f"{d2} AS d2")
                .where(f"d2 < {limit * limit!r}D AND NOT (i = j AND s0 = 0 AND s1 = 0 AND s2 = 0)")
                .selectExpr("structure_id", "i", "j", "type_a", "type_b", "s0", "s1", "s2", "sqrt(greatest(d2, 0D)) AS d"))


def neighbor_pairs(atoms: DataFrame, structures: DataFrame, r_max: float = R_MAX,
                   centers: DataFrame | None = None, inclusive: bool = False) -> DataFrame:
    """All ordered (i, j, image) pairs with d < r_max (<= when inclusive), never i with itself unshifted.

    Periodic where `pbc`; otherwise no images, with `cell` only bounding the points. `centers`
    (structure_id, atom_id) restricts i. Displacements are fractional and measured by the cell's metric,
    so a lattice vector keeps its exact length. Structures up to SMALL atoms, as counted, are gathered whole; the others
    meet by grid cell.
    """
    limit = r_max + EDGE_EPS if inclusive else r_max - EDGE_EPS
    small, large, tasks = by_size(atoms, structures)
    found = [] if small is None else [_small_pairs(*small, r_max, limit, centers, tasks)]
    if large is not None:
        found.append(_grid_pairs(*large, r_max, limit, centers))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _grid_pairs(atoms: DataFrame, structures: DataFrame, r_max: float, limit: float, centers: DataFrame | None) -> DataFrame:
    """`neighbor_pairs` by an equi-join on grid cells."""
    axes = range(3)
    counted = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    structures = structures.drop("n_atoms").join(counted, "structure_id")
    metric = [f"w{r}{k}" for r in axes for k in range(r, 3)]
    placed = (atoms.select("structure_id", "atom_id", "type_id", "x", "y", "z")
                   .join(_axis_grid(structures, r_max), "structure_id"))
    carried = ["structure_id", "atom_id", "type_id", *metric,
               *[f"{n}{k}" for n in ("g", "m", "nr") for k in axes]]
    placed = placed.selectExpr(*carried, "pbc", *[f"{L.fraction_sql(k)} AS u{k}" for k in axes])
    placed = placed.selectExpr(*carried, *[f"if(pbc, {L.wrap_sql(f'u{k}')}, u{k}) AS f{k}" for k in axes])
    placed = placed.selectExpr("*", *[f"CAST(greatest(least(floor(f{k} * g{k}), g{k} - 1), 0) AS INT) AS c{k}"
                                      for k in axes])
    # coalesced: a key that cannot be null needs no derived null filter
    key = "coalesce((CAST({0} AS BIGINT) * g1 + {1}) * g2 + {2}, -1L) AS bin"
    right = placed.selectExpr("structure_id", key.format("c0", "c1", "c2"), "atom_id AS j", "type_id AS type_b",
                              *[f"f{k} AS b{k}" for k in axes])
    left = placed if centers is None else placed.join(
        centers.select("structure_id", "atom_id"), ["structure_id", "atom_id"], "left_semi")
    for k in axes:
        left = left.selectExpr("*", _probes(k))
    left = left.selectExpr("structure_id", key.format("p0.cell", "p1.cell", "p2.cell"), "atom_id AS i",
                           "type_id AS type_a", *metric, *[f"nr{k}" for k in axes],
                           *[f"p{k}.shift AS s{k}" for k in axes], *[f"f{k} - p{k}.shift AS e{k}" for k in axes])
    step = [f"(b{k} - e{k} - nr{k} * rint(b{k} - e{k}))" for k in axes]
    d2 = " + ".join(f"w{r}{k} * {step[r]} * {step[k]}" for r in axes for k in range(r, 3))
    return (left.join(right, ["structure_id", "bin"])
                .selectExpr("structure_id", "i", "j", "type_a", "type_b", "s0", "s1", "s2", f"{d2} AS d2")
                .where(f"d2 < {limit * limit!r}D AND NOT (i = j AND s0 = 0 AND s1 = 0 AND s2 = 0)")
                .selectExpr("structure_id", "i", "j", "type_a", "type_b", "s0", "s1", "s2",
                            "sqrt(greatest(d2, 0D)) AS d"))


def contact_guard(structures: DataFrame, pairs: DataFrame, min_distance: float = 0.6) -> DataFrame:
    """Drop structures that hold a pair closer than `min_distance`."""
    bad = pairs.where(F.col("d") < min_distance - EDGE_EPS).select("structure_id").distinct()
    return structures.join(bad, "structure_id", "left_anti")


def contact_free(atoms: DataFrame, structures: DataFrame, min_distance: float = 0.6) -> DataFrame:
    """`contact_guard` straight from the atoms: only pairs within `min_distance` are sought, and none of them leaves its task.

    Structures up to SMALL atoms are judged where they are gathered, one flag each; the others meet by grid cells of that width.
    """
    limit = min_distance - EDGE_EPS
    small, large, tasks = by_size(atoms, structures)
    found = []
    if small is not None:
        # else Spark pulls the whole geometry of a cell into the filter on the flag and repeats it for every atom
        touching = F.arrow_udf(_touching(limit), "boolean").asNondeterministic()
        judged = gathered(*small, min_distance, tasks).select("structure_id", touching("p", *[F.col(c) for c in _IMAGES]).alias("_bad"))
        found.append(judged.where("_bad").select("structure_id"))
    if large is not None:
        found.append(_grid_pairs(*large, min_distance, limit, None).select("structure_id").distinct())
    bad = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return structures.join(bad, "structure_id", "left_anti")


def _touching(limit: float):
    """The function that runs on Arrow batches: whether a structure holds a pair closer than `limit`; whole in itself."""
    names, at_once = list(_IMAGES), PAIRS_AT_ONCE

    def touched(sizes: np.ndarray, f: list[np.ndarray], cell: dict[str, np.ndarray]) -> np.ndarray:
        of = np.repeat(np.arange(len(sizes)), sizes)
        start, each = np.cumsum(sizes) - sizes, sizes[of]
        i = np.repeat(np.arange(len(of)), each)
        j = start[of[i]] + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        bad = np.zeros(len(sizes), bool)
        reach = [cell[f"m{k}"] for k in range(3)]
        for shift in product(*[range(-int(m.max(initial=0)), int(m.max(initial=0)) + 1) for m in reach]):
            if shift < (0, 0, 0):  # the same pairs seen from the other atom
                continue
            here = np.logical_and.reduce([abs(s) <= m for s, m in zip(shift, reach)])[of[i]]
            pick = np.flatnonzero(here if any(shift) else here & (i < j))
            a, b = i[pick], j[pick]
            at = of[a]
            u = []
            for k in range(3):
                step = f[k][b] - (f[k][a] - shift[k])
                u.append(step - cell[f"nr{k}"][at] * np.rint(step))
            d2 = sum(cell[f"w{r}{k}"][at] * u[r] * u[k] for r in range(3) for k in range(r, 3))
            bad[at[d2 < limit * limit]] = True
        return bad

    def run(p: pa.Array, *columns: pa.Array) -> pa.Array:
        sizes = np.diff(p.offsets.to_numpy()).astype(np.int64)
        flat = p.flatten()
        f = [flat.field(f"f{k}").to_numpy(zero_copy_only=False) for k in range(3)]
        cell = {name: c.to_numpy(zero_copy_only=False) for name, c in zip(names, columns)}
        last, work, lo, done = np.cumsum(sizes), np.cumsum(sizes * sizes), 0, 0
        bad = np.zeros(len(sizes), bool)
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(work, done + at_once, "right")))
            atoms = slice(int(last[lo] - sizes[lo]), int(last[hi - 1]))
            bad[lo:hi] = touched(sizes[lo:hi], [v[atoms] for v in f], {n: c[lo:hi] for n, c in cell.items()})
            lo, done = hi, work[hi - 1]
        return pa.array(bad)

    return run


def environment_sets(atoms: DataFrame, structures: DataFrame, centers: DataFrame, k: int = K_ENV,
                     r_env: float = R_ENV, grouped: bool = False) -> DataFrame:
    """K nearest neighbours of each centre as (structure_id, i, type_a, rank, d, type_b).

    Only the sampled centres enter the pair search. Structures up to SMALL atoms are ranked where they are gathered; for the
    others the rank filter prunes before its shuffle. With `grouped`, each small structure is moved once as one row,
    so that whatever is grouped by structure afterwards moves no single rows.
    """
    limit = r_env + EDGE_EPS
    small, large, tasks = by_size(atoms, structures)
    found = [] if small is None else [_small_environments(*small, r_env, limit, centers, k, tasks, grouped)]
    if large is not None:
        found.append(_large_environments(*large, r_env, limit, centers, k))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _small_environments(atoms: DataFrame, structures: DataFrame, r_env: float, limit: float, centers: DataFrame, k: int,
                        tasks: int, grouped: bool) -> DataFrame:
    """`environment_sets` of structures up to SMALL atoms, at most k rows a centre leave the batch function."""
    kind, atom = (atoms.schema[c].dataType.simpleString() for c in ("type_id", "atom_id"))
    result = f"array<struct<i: {atom}, type_a: {kind}, rank: int, d: double, type_b: {kind}>>"
    found = _described(atoms, structures, r_env, centers, tasks, F.arrow_udf(_nearest(k, limit), result))
    if grouped:  # Spark takes rows that come from Python as spread at random
        found = found.repartition(max(tasks, 1), "structure_id")
    return found.select("structure_id", F.explode("_e").alias("e")).select("structure_id", "e.*")


def _described(atoms: DataFrame, structures: DataFrame, r_env: float, centers: DataFrame, tasks: int, nearest) -> DataFrame:
    wanted = centers.groupBy("structure_id").agg(F.collect_set("atom_id").alias("_c"))
    whole = gathered(atoms, structures, r_env, tasks).join(wanted, "structure_id")
    # else Spark runs it twice: for the rows, and for the filter on empty lists that it infers below an explode
    nearest = nearest.asNondeterministic()
    return whole.select("structure_id", nearest("p", "_c", *[F.col(c) for c in _IMAGES]).alias("_e"))


def packed_environments(atoms: DataFrame, structures: DataFrame, centers: DataFrame, k: int = K_ENV, r_env: float = R_ENV) -> DataFrame:
    """`pack_environments` of `environment_sets`; those of structures up to SMALL atoms are packed where they are ranked."""
    limit = r_env + EDGE_EPS
    small, large, tasks = by_size(atoms, structures)
    found = []
    if small is not None:
        kind = atoms.schema["type_id"].dataType.simpleString()
        result = f"array<struct<type_id: {kind}, env: array<array<struct<d: float, t: {kind}>>>>>"
        packed = _described(*small, r_env, centers, tasks, F.arrow_udf(_nearest(k, limit, True), result))
        found.append(packed.select("structure_id", F.explode("_e").alias("e")).select("structure_id", "e.*"))
    if large is not None:
        found.append(pack_environments(_large_environments(*large, r_env, limit, centers, k)))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _large_environments(atoms: DataFrame, structures: DataFrame, r_env: float, limit: float, centers: DataFrame, k: int) -> DataFrame:
    # equal distances are ordered by partner, so rounding noise must not decide
    order = [F.round("d", 7), F.col("type_b"), F.col("j"), F.col("s0"), F.col("s1"), F.col("s2")]
    return top_k(_grid_pairs(atoms, structures, r_env, limit, centers), ["structure_id", "i"], order, k, "rank").select(
        "structure_id", "i", "type_a", "rank", "d", "type_b")


def _nearest(count: int, limit: float, packed: bool = False):
    """The function that runs on Arrow batches; whole in itself, so workers need not have this package.

    Rows of a structure are (i, type_a, rank, d, type_b); when `packed`, one entry per type with the lists of its centres.
    """
    names, at_once = list(_IMAGES), PAIRS_AT_ONCE

    def ranked(sizes: np.ndarray, wanted: np.ndarray, f: list[np.ndarray], cell: dict[str, np.ndarray]):
        """(centre, partner, rank, d) by places of the atoms, for structures whose atoms lie in order of type and id."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        start = np.cumsum(sizes) - sizes
        center = np.flatnonzero(wanted)
        each = sizes[of[center]]
        i = np.repeat(center, each)
        j = start[of[i]] + np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
        reach = []
        for axis in range(3):
            m, t = cell[f"m{axis}"], cell[f"t{axis}"]
            if m.any():  # image shifts at which the two atoms can lie within the cutoff
                gap = f[axis][i] - f[axis][j]
                low = np.where(m[of[i]] == 0, 0, np.ceil(gap - t[of[i]] - 1e-6)).astype(np.int64)
                high = np.where(m[of[i]] == 0, 0, np.floor(gap + t[of[i]] + 1e-6)).astype(np.int64)
                reach.append((low, high, range(int(low.min(initial=0)), int(high.max(initial=0)) + 1)))
            else:
                reach.append((None, None, range(1)))
        images = any(r[0] is not None for r in reach)
        found = []
        for shift in product(*[r[2] for r in reach]):
            a, b = i, j
            if images:
                pick = np.flatnonzero(np.logical_and.reduce([(r[0] <= s) & (s <= r[1]) for s, r in zip(shift, reach) if r[0] is not None]))
                a, b = i[pick], j[pick]
            at = of[a]
            u = []
            for axis in range(3):
                step = f[axis][b] - (f[axis][a] - shift[axis])
                u.append(step - cell[f"nr{axis}"][at] * np.rint(step))
            d2 = sum(cell[f"w{r}{c}"][at] * u[r] * u[c] for r in range(3) for c in range(r, 3))
            close = d2 < limit * limit
            if not any(shift):
                close &= a != b
            d = np.sqrt(np.maximum(d2[close], 0.0))
            found.append((a[close], b[close], d, *[np.full(len(d), s) for s in shift]))
        a, b, d, *shifts = (np.concatenate(v) for v in zip(*found))
        # equal distances are ordered by partner, so rounding noise must not decide
        order = np.lexsort((*(shifts[::-1] if images else ()), b, np.floor(d * 1e7 + 0.5), a))
        a, b, d = a[order], b[order], d[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < count
        return a[keep], b[keep], rank[keep] + 1, d[keep]

    def nested(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    def run(p: pa.Array, wanted: pa.Array, *columns: pa.Array) -> pa.Array:
        sizes = np.diff(p.offsets.to_numpy()).astype(np.int64)
        flat = p.flatten()
        atom, kind = flat.field("atom_id"), flat.field("type_id")
        f = [flat.field(f"f{k}").to_numpy(zero_copy_only=False) for k in range(3)]
        cell = {name: c.to_numpy(zero_copy_only=False) for name, c in zip(names, columns)}
        row = np.arange(len(sizes))
        of = np.repeat(row, sizes)
        code = pa.concat_arrays([atom, wanted.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.concatenate([of, np.repeat(row, np.diff(wanted.offsets.to_numpy()))]) * (code.max(initial=0) + 1) + code
        chosen = np.isin(key[:len(atom)], key[len(atom):])
        work = np.cumsum(np.bincount(of, chosen, len(sizes)) * sizes * np.prod([2 * cell[f"m{k}"].astype(np.int64) + 1 for k in range(3)], axis=0))
        last, done, cuts = np.cumsum(sizes), 0, [0]
        while cuts[-1] < len(sizes):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(work, done + at_once, "right"))))
            done = work[cuts[-1] - 1]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            first = int(last[lo] - sizes[lo])
            atoms = slice(first, int(last[hi - 1]))
            a, b, rank, d = ranked(sizes[lo:hi], chosen[atoms], [v[atoms] for v in f], {n: c[lo:hi] for n, c in cell.items()})
            parts.append((a + first, b + first, rank, d))
        a, b, rank, d = (np.concatenate(v) for v in zip(*parts))
        per_structure = np.bincount(of[a], minlength=len(sizes))
        if packed:
            level = pa.StructArray.from_arrays([pa.array(d.astype(np.float32)), kind.take(pa.array(b))], ["d", "t"])
            center = np.flatnonzero(rank == 1)  # the first row of each centre
            level = nested(np.append(center, len(a)), level)
            type_a, home = kind.take(pa.array(a[center])), of[a[center]]
            code = type_a.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (home[1:] != home[:-1]))[:len(code)])
            level = nested(np.append(first, len(center)), level)
            rows = pa.StructArray.from_arrays([type_a.take(pa.array(first)), level], ["type_id", "env"])
            per_structure = np.bincount(home[first], minlength=len(sizes))
        else:
            rows = pa.StructArray.from_arrays([atom.take(pa.array(a)), kind.take(pa.array(a)), pa.array(rank.astype(np.int32)),
                                               pa.array(d), kind.take(pa.array(b))], ["i", "type_a", "rank", "d", "type_b"])
        return nested(np.concatenate([[0], np.cumsum(per_structure)]), rows)

    return run


def pack_environments(env: DataFrame) -> DataFrame:
    """(structure_id, type_id, env): per type an array over centres of arrays of (d, t), at most 16 x 16."""
    per_center = env.groupBy("structure_id", "type_a", "i").agg(
        F.sort_array(F.collect_list(F.struct("rank", "d", "type_b"))).alias("s"))
    shaped = per_center.select("structure_id", F.col("type_a").alias("type_id"), "i", F.transform(
        "s", lambda e: F.struct(e["d"].cast("float").alias("d"), e["type_b"].alias("t"))).alias("s"))
    return (shaped.groupBy("structure_id", "type_id").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("e"))
                  .select("structure_id", "type_id", F.transform("e", lambda v: v["s"]).alias("env")))


def atom_minimum(pairs: DataFrame) -> DataFrame:
    """Nearest distance from every centre to every type it reaches: (structure_id, type_a, i, type_b, d)."""
    return pairs.groupBy("structure_id", "type_a", "i", "type_b").agg(F.min("d").alias("d"))


def nn_distance(atoms: DataFrame, max_sample: int | None = None, seed: int = 0) -> DataFrame:
    """Distance from each atom to its nearest neighbour, without images, in stored units.

    The grid step follows each structure's own density inside the box of its middle 90 % along every axis, since the
    length unit is still unknown and a stray atom must not widen the grid. A centre is settled once its best distance
    fits inside one step; the few others retry with four times wider cells until all are. With `max_sample`, about
    that many atoms of a larger structure are centres, chosen by hash.
    """
    points = atoms.select("structure_id", "atom_id", "x", "y", "z")
    ends = F.array(F.lit(0.05), F.lit(0.95))
    box = points.groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo_{c}") for c in "xyz"],
        *[F.percentile_approx(c, ends, 1000).alias(f"mid_{c}") for c in "xyz"])
    widths = [F.col(f"mid_{c}")[1] - F.col(f"mid_{c}")[0] for c in "xyz"]
    sides = [F.greatest(w, F.greatest(*widths) * 1e-3) for w in widths]
    box = box.where(F.col("n") >= 2).select(
        "structure_id", "n", "lo_x", "lo_y", "lo_z",
        F.pow(sides[0] * sides[1] * sides[2] / F.col("n"), 1 / 3).alias("step"))
    points = staged(points.join(box, "structure_id"), "nn-points")
    todo = points
    if max_sample is not None:
        todo = points.where(uniform(seed, F.col("structure_id"), F.col("atom_id")) * F.col("n") < max_sample)
    one = (F.col("n") <= SMALL) | (F.col("step") <= 0)

    def cells(df: DataFrame, factor: float) -> DataFrame:
        return df.withColumns({f"c{c}": F.when(one, F.lit(0)).otherwise(
            F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col("step") * factor))).cast("long") for c in "xyz"})

    def reach(c: str) -> Column:
        return F.explode(F.when(one, F.array(F.lit(0).cast("long"))).otherwise(
            F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))

    def gap() -> Column:
        return F.sqrt(sum(((F.col(f"q{c}") - F.col(c)) * (F.col(f"q{c}") - F.col(c)) for c in "xyz"), F.lit(0.0)))

    settled, factor = None, 1.5
    while True:
        left = cells(todo, factor)
        for c in "xyz":
            left = left.withColumn(f"k{c}", reach(c))
        right = cells(points, factor).select("structure_id", *[F.col(f"c{c}").alias(f"k{c}") for c in "xyz"],
                                             F.col("atom_id").alias("j"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
        best = (left.join(right, ["structure_id", "kx", "ky", "kz"]).where(F.col("j") != F.col("atom_id"))
                    .groupBy("structure_id", "atom_id").agg(F.min(gap()).alias("d")))
        tried = todo.join(best, ["structure_id", "atom_id"], "left")
        done = F.coalesce(one | (F.col("d") <= F.col("step") * factor), F.lit(False))
        tried = staged(tried.withColumn("done", done), "nn-tried")
        now = tried.where("done").select("structure_id", "atom_id", "d")
        settled = now if settled is None else settled.unionByName(now)
        todo = tried.where("NOT done").drop("d", "done")
        if todo.isEmpty():
            return settled
        factor *= 4
