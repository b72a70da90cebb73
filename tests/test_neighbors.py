"""Pair search and descriptors against closed forms and a NumPy brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import descriptors as D
from latticework.operators import geometry as G
from latticework.operators import neighbors as N
from latticework.operators import sampling as S


def frame(spark, sid, positions, types, cell, pbc=True):
    rows = [(sid, i, int(t), int(t), *map(float, p)) for i, (t, p) in enumerate(zip(types, positions))]
    atoms = spark.createDataFrame(rows, "structure_id string, atom_id long, label int, type_id int, x double, y double, z double")
    box = None if cell is None else [[float(v) for v in r] for r in cell]
    cells = spark.createDataFrame([(sid, box, pbc, len(rows))], "structure_id string, cell array<array<double>>, pbc boolean, n_atoms long")
    return atoms, cells


def rocksalt():
    fcc = np.array([(0, 0, 0), (.5, .5, 0), (.5, 0, .5), (0, .5, .5)])
    positions, types = [], []
    for shift in itertools.product(range(2), repeat=3):
        for t, offset in ((0, (0, 0, 0)), (1, (.5, 0, 0))):
            for p in fcc:
                positions.append((p + offset + shift) * 4.2)
                types.append(t)
    return np.array(positions), np.array(types), np.eye(3) * 8.4


def brute(positions, types, cell, r, images=4):
    frac = np.linalg.solve(cell.T, positions.T).T % 1.0
    out = []
    for shift in itertools.product(range(-images, images + 1), repeat=3):
        delta = (frac[None, :, :] - frac[:, None, :] + np.array(shift)) @ cell
        d = np.sqrt((delta ** 2).sum(-1))
        keep = d < r
        if shift == (0, 0, 0):
            keep &= ~np.eye(len(frac), dtype=bool)
        i, j = np.nonzero(keep)
        out += list(zip(i, j, np.round(d[i, j], 6)))
    return sorted(out)


def found(pairs):
    return sorted((r.i, r.j, round(r.d, 6)) for r in pairs.select("i", "j", "d").collect())


@pytest.mark.parametrize("small", [0, 256])
@pytest.mark.parametrize("cell", [
    [(6, 0, 0), (2, 6, 0), (1, 1.5, 6)], [(30, 0, 0), (4, 21, 0), (-3, 2, 18)], [(3, 0, 0), (0, 25, 0), (0, 7, 40)]])
def test_pairs_match_brute_force(spark, monkeypatch, cell, small):
    monkeypatch.setattr(N, "SMALL", small)
    rng = np.random.default_rng(3)
    cell = np.array(cell, float)
    positions, types = (rng.random((40, 3)) * 3 - 1) @ cell, np.arange(40) % 2
    positions[7] = positions[6]
    atoms, cells = frame(spark, "a", positions, types, cell)
    got, want = found(N.neighbor_pairs(atoms, cells)), brute(positions, types, cell, 8.0)
    assert len(got) == len(want)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_open_structure_has_no_images(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 0)
    rng = np.random.default_rng(5)
    positions = rng.random((60, 3)) * 40
    atoms, cells = frame(spark, "a", positions, np.zeros(60), np.eye(3) * 40, pbc=False)
    d = np.linalg.norm(positions[:, None] - positions[None], axis=-1)
    assert N.neighbor_pairs(atoms, cells).count() == int(((d < 8) & ~np.eye(60, dtype=bool)).sum())


def test_rocksalt_descriptor(spark):
    positions, types, cell = rocksalt()
    atoms, cells = frame(spark, "nacl", positions, types, cell)
    assert N.neighbor_pairs(atoms, cells).count() == 16000
    pairs, kinds = D.compute_features(atoms, cells)
    rows = {(r.type_a, r.type_b): r for r in pairs.collect()}
    same = [0, 2.56495, 2.56495, 4.00733, .37123, .37123, .36719, 2.02035]
    other = [1.94591, 1.94591, 2.70805, 3.66356, .26250, .26250, .25781, 2.03248]
    assert np.allclose(rows[0, 0].pair_extra, same, atol=1e-4)
    assert np.allclose(rows[0, 1].pair_extra, other, atol=1e-4)
    assert np.allclose(rows[0, 1].rdf[12:21], [.00388, .11006, 1.16229, 4.55879, 6.63300, 3.57659, .71412, .05276, .00144], atol=1e-4)
    for r in kinds.collect():
        assert math.isclose(r.frac, 0.5) and np.allclose(r.glob, [-2.225812, 1, 0.5], atol=1e-5)
        assert len(r.env) == 16
        for center in r.env:
            assert np.allclose([e.d for e in center[:6]], 2.1, atol=1e-5) and all(e.t != r.type_id for e in center[:6])
            assert np.allclose([e.d for e in center[6:]], 2.96985, atol=1e-5) and all(e.t == r.type_id for e in center[6:])


def test_descriptor_ignores_wrapping_order_and_partitioning(spark):
    rng = np.random.default_rng(11)
    cell = np.array([(9, 0, 0), (2, 8, 0), (1, -2, 10)], float)
    frac, types = rng.random((30, 3)), np.arange(30) % 3
    order = rng.permutation(30)

    def extras(positions, kinds, parts):
        atoms, cells = frame(spark, "a", positions, kinds, cell)
        pairs, _ = D.compute_features(atoms.repartition(parts), cells, with_env=False)
        return np.array([list(r.pair_extra) + list(r.rdf) for r in pairs.orderBy("type_a", "type_b").collect()])

    base = extras(frac @ cell, types, 1)
    assert np.allclose(base, extras((frac + rng.integers(-2, 3, (30, 3))) @ cell, types, 8), atol=1e-6)
    assert np.allclose(base, extras(frac[order] @ cell, types[order], 3), atol=1e-6)


def test_vacuum_box_molecule(spark):
    rng = np.random.default_rng(2)
    positions = rng.random((15, 3)) * 4
    atoms, cells = frame(spark, "m", positions, np.arange(15) % 3, None, pbc=False)
    moved, boxed = G.vacuum_box(atoms, cells)
    side = np.diag(np.array(boxed.first().cell))
    assert np.allclose(side, np.ptp(positions, axis=0) + 10)
    d = np.linalg.norm(positions[:, None] - positions[None], axis=-1)
    assert N.neighbor_pairs(moved, boxed).count() == int(((d < 8) & ~np.eye(15, dtype=bool)).sum())


def test_nearest_distances_of_large_structure(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 16)
    rng = np.random.default_rng(4)
    positions = rng.random((400, 3)) * [50, 20, 5]
    positions[0] = [500, 500, 500]  # far outlier: only the whole-structure fallback finds its neighbour
    atoms, _ = frame(spark, "a", positions, np.zeros(400), None)
    d = np.linalg.norm(positions[:, None] - positions[None], axis=-1) + np.diag(np.full(400, np.inf))
    got = {r.atom_id: r.d for r in N.nn_distance(atoms).collect()}
    assert len(got) == 400 and np.allclose([got[i] for i in range(400)], d.min(axis=1))


def test_interior_crop_keeps_full_statistics(spark):
    rng = np.random.default_rng(8)
    cell = np.array([(44, 0, 0), (3, 46, 0), (0, 4, 45)], float)
    positions, types = rng.random((9000, 3)) @ cell, (rng.random(9000) < .3).astype(int)
    atoms, cells = frame(spark, "big", positions, types, cell)
    points, boxes = S.interior_crop(atoms, cells, 5000, min_centers=50)
    assert points.count() < 7000 and not boxes.first().pbc
    full = {(r.i): r.n for r in N.neighbor_pairs(atoms, cells).groupBy("i").agg(F.count("*").alias("n")).collect()}
    centers = points.where("is_center")
    for r in N.neighbor_pairs(points, boxes, centers=centers).groupBy("i").agg(F.count("*").alias("n")).collect():
        assert r.n == full[r.i]
    _, kinds = D.compute_features(atoms, cells, with_env=False, max_atoms=5000)
    fracs = {r.type_id: r.frac for r in kinds.collect()}
    assert math.isclose(fracs[1], types.mean())


def test_zero_distance_pairs_count(spark):
    atoms, cells = frame(spark, "shell", [(1, 1, 1), (1, 1, 1), (5, 5, 5)], [0, 1, 0], np.eye(3) * 30)
    hist = D.pair_histogram(N.neighbor_pairs(atoms, cells)).where("bin = 0").collect()
    assert sorted((r.type_a, r.type_b, r.n) for r in hist) == [(0, 1, 1), (1, 0, 1)]


def test_pair_rows_are_complete_where_their_structure_was_gathered(spark):
    import random
    draw = random.Random(5)
    shapes = {1: ([[20.0, 0.0, 0.0], [0.0, 20.0, 0.0], [0.0, 0.0, 20.0]], True),
              2: ([[6.0, 0.0, 0.0], [2.0, 6.0, 0.0], [1.0, -1.5, 6.0]], True),
              3: ([[30.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 17.0]], False)}
    rows = [(s, i, i % 4, *[sum(u * v for u, v in zip(p, column)) for column in zip(*shapes[s][0])])
            for s in shapes for i in range(23) for p in [[draw.random() for _ in range(3)]]]
    atoms = spark.createDataFrame(rows, "structure_id long, atom_id long, type_id int, x double, y double, z double")
    cells = spark.createDataFrame([(s, c, p, 23) for s, (c, p) in shapes.items()],
                                  "structure_id long, cell array<array<double>>, pbc boolean, n_atoms long")
    found = D.pair_profiles(atoms, cells)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan[:plan.index("ArrowEvalPython")]
    got = {tuple(r[:3]): (r.rdf, r.pair_extra) for r in found.collect()}
    want = {tuple(r[:3]): (r.rdf, r.pair_extra) for r in D._grid_profiles(atoms, cells, None).collect()}
    assert got.keys() == want.keys() and len(got) == 48
    for key, pair in want.items():
        assert got[key][0] == pytest.approx(pair[0], rel=1e-9, abs=1e-12) and got[key][1] == pytest.approx(pair[1], rel=1e-9)


def test_packed_rows_are_not_moved_after_they_are_described(spark):
    from latticework.operators import tokens as T
    rng = np.random.default_rng(3)
    atoms, cells = frame(spark, "a", rng.random((30, 3)) * 20, np.arange(30) % 3, np.eye(3) * 20)
    packed = D.packed_features(atoms, cells, with_env=False, carry=cells.selectExpr("structure_id", "n_atoms AS size"))
    for shaped in (T.model_rows(packed), T.pooled_types(packed)):
        plan = shaped._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.index("ArrowEvalPython")] and "SortMergeJoin" not in plan[:plan.index("ArrowEvalPython")]
    row = T.model_rows(packed).first()
    assert (row.size, row.n_types, row.type_ids, len(row.rdf)) == (30, 3, [0, 1, 2], 9)


def test_crop_counts_points_on_its_margin_as_inside(spark):
    side = 61.2  # 8 / side and the fraction of 8 differ by rounding
    positions = np.vstack([[[8.0, 12.0, 12.0], [13.0, 13.0, 13.0]], np.full((298, 3), side - 1.0)])
    atoms, cells = frame(spark, "a", positions, np.zeros(300), np.eye(3) * side)
    points, _ = S.interior_crop(atoms, cells, 200, min_centers=1)
    assert [(r.atom_id, r.is_center) for r in points.where("x < 20").orderBy("atom_id").collect()] == [(0, True), (1, True)]


def test_environments_of_small_structures_are_ranked_in_place(spark, monkeypatch):
    """The batch function finds the rows of the grid join, with images and sampled centres, and packs them alike."""
    rng = np.random.default_rng(16)
    cell = np.array([(6, 0, 0), (2, 13, 0), (1, 1.5, 9)])
    positions = np.concatenate([rng.random((30, 3)) @ cell, rocksalt()[0][:8]])
    atoms, cells = frame(spark, "a", positions, rng.integers(0, 3, len(positions)), cell)
    more, boxes = frame(spark, "b", rng.random((20, 3)) * 30, rng.integers(0, 2, 20), np.eye(3) * 30, pbc=False)
    lone, box = frame(spark, "c", [(1, 1, 1)], [0], np.eye(3) * 30)
    atoms, cells = atoms.unionByName(more).unionByName(lone), cells.unionByName(boxes).unionByName(box)
    centers = atoms.where("atom_id % 3 > 0")

    def both():
        env = N.environment_sets(atoms, cells, centers)
        rows = sorted((r.structure_id, r.i, r.type_a, r["rank"], round(r.d, 9), r.type_b) for r in env.collect())
        packed = sorted((r.structure_id, r.type_id, str(r.env)) for r in N.packed_environments(atoms, cells, centers).collect())
        assert packed == sorted((r.structure_id, r.type_id, str(r.env)) for r in N.pack_environments(env).collect())
        return rows, packed

    small = both()
    assert any("ArrowEvalPython" in line for line in N.environment_sets(atoms, cells, centers)._jdf.queryExecution().toString().splitlines())
    monkeypatch.setattr(N, "SMALL", 0)
    assert both() == small and small[0]


def test_batch_functions_run_once(spark):
    """Spark filters on what it explodes; the function must not be run for that filter as well."""
    positions, types, cell = rocksalt()
    atoms, cells = frame(spark, "r", positions, types, cell)
    for rows in (D.pair_profiles(atoms, cells), N.environment_sets(atoms, cells, atoms)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("small", [0, 256])
def test_contacts_are_found_without_pair_rows(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rng = np.random.default_rng(5)
    parts, want = [], set()
    for k in range(24):  # thin, tilted and open cells; some points lie outside
        cell = np.array([(7, 0, 0), (1, 6, 0), (-1, .5, 8)] if k % 3 else [(1.2 if k % 2 else 1.8, 0, 0), (0, 9, 0), (0, 2, 9)], float)
        positions = (rng.random((5, 3)) * 2 - .5) @ cell
        parts.append(frame(spark, f"s{k}", positions, np.arange(5) % 2, cell, k % 4 != 2))
        if k % 4 == 2:
            gaps = np.linalg.norm(positions[:, None] - positions[None], axis=-1)[~np.eye(5, dtype=bool)]
            near = (gaps < 1.5).any()
        else:
            near = bool(brute(positions, None, cell, 1.5))
        want |= set() if near else {f"s{k}"}
    atoms, cells = parts[0]
    for a, c in parts[1:]:
        atoms, cells = atoms.union(a), cells.union(c)
    found_ = N.contact_free(atoms, cells, 1.5)
    assert {r.structure_id for r in found_.collect()} == want and 0 < len(want) < 24
    plan = found_._jdf.queryExecution().optimizedPlan().toString()
    assert small == 0 or "explode" not in plan.lower()
