"""Checks of geometry, neighbour and descriptor operators on structures built from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import R_MAX
from ..operators import descriptors as D
from ..operators import geometry as G
from ..operators import neighbors as N
from ..operators import gates as Q
from ..operators import sampling as S
from ..operators import units as U
from ..session import staged
from .base import add_view, atoms_view, query, table
from .base import typed_atoms as typed

PAIR = ["structure_id", "type_a", "type_b"]


def pairs(spark, sf_dir):
    return N.neighbor_pairs(*typed(spark, sf_dir))


def grid(spark, sf_dir):
    return D.type_grid(G.type_counts(typed(spark, sf_dir)[0]))


def density(spark, sf_dir):
    return D.density_grid(grid(spark, sf_dir), typed(spark, sf_dir)[1])


@query("relabel_types", "atoms", "SELECT structure_id, atom_id, label, type_id FROM atoms")
def relabel_types(spark, sf_dir):
    atoms, _ = atoms_view(spark, sf_dir)
    return G.relabel_types(atoms).select("structure_id", "atom_id", "label", "type_id")


@query("type_fractions", "counts", """
    SELECT structure_id, type_id, n, round(n / sum(n) OVER (PARTITION BY structure_id), 6) AS frac FROM counts""")
def type_fractions(spark, sf_dir):
    return G.type_fractions(typed(spark, sf_dir)[0]).withColumn("frac", F.round("frac", 6))


# the same fractions in a small tilted cell: neighbours lie in images of all directions
@query("neighbor_pairs_tilted", "atoms", """
    , f AS (SELECT structure_id, atom_id, type_id, xi::DOUBLE / edge AS u, yi::DOUBLE / edge AS v, zi::DOUBLE / edge AS w FROM atoms),
    s AS (SELECT a.range AS su, b.range AS sv, c.range AS sw FROM range(-1, 2) a, range(-1, 2) b, range(-1, 2) c),
    d AS (SELECT a.structure_id, a.type_id AS type_a, b.type_id AS type_b, b.u - a.u + su AS u, b.v - a.v + sv AS v, b.w - a.w + sw AS w
          FROM f a JOIN f b ON a.structure_id = b.structure_id, s
          WHERE NOT (a.atom_id = b.atom_id AND su = 0 AND sv = 0 AND sw = 0)),
    p AS (SELECT structure_id, type_a, type_b, sqrt(pow(6 * u + 2 * v + w, 2) + pow(6 * v - 1.5 * w, 2) + pow(6 * w, 2)) AS d FROM d)
    SELECT structure_id, type_a, type_b, count(*) AS n_pairs, round(sum(d), 3) AS sum_d, round(max(d), 5) AS max_d
    FROM p WHERE d < 3.93713 GROUP BY 1, 2, 3""")
def neighbor_pairs_tilted(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    edges = structures.select("structure_id", F.col("cell")[0][0].alias("edge"))
    u, v, w = (F.col(c) / F.col("edge") for c in "xyz")
    atoms = atoms.join(edges, "structure_id").withColumns({"x": 6 * u + 2 * v + w, "y": 6 * v - 1.5 * w, "z": 6 * w}).drop("edge")
    cell = F.expr("array(array(6D, 0D, 0D), array(2D, 6D, 0D), array(1D, -1.5D, 6D))")
    found = N.neighbor_pairs(atoms, structures.withColumn("cell", cell), 3.93713)
    return found.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("d"), 3).alias("sum_d"), F.round(F.max("d"), 5).alias("max_d"))


@query("neighbor_pairs", "pairs", """
    SELECT structure_id, type_a, type_b, count(*) AS n_pairs, round(sum(d), 4) AS sum_d, round(min(d), 6) AS min_d,
           round(max(d), 6) AS max_d FROM pairs GROUP BY structure_id, type_a, type_b""")
def neighbor_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("d"), 4).alias("sum_d"),
        F.round(F.min("d"), 6).alias("min_d"), F.round(F.max("d"), 6).alias("max_d"))


@query("pair_histogram", "hist", "SELECT structure_id, type_a, type_b, bin, n FROM hist")
def pair_histogram(spark, sf_dir):
    return D.pair_histogram(pairs(spark, sf_dir))


@query("coordination", "hist tgrid", """
    SELECT g.structure_id, g.type_a, g.type_b,
           round(coalesce(sum(n) FILTER (WHERE bin <= 16), 0) / max(g.n_a), 6) AS cn0,
           round(coalesce(sum(n) FILTER (WHERE bin <= 24), 0) / max(g.n_a), 6) AS cn1,
           round(coalesce(sum(n) FILTER (WHERE bin <= 32), 0) / max(g.n_a), 6) AS cn2,
           round(coalesce(sum(n) FILTER (WHERE bin <= 48), 0) / max(g.n_a), 6) AS cn3
    FROM tgrid g LEFT JOIN hist h ON h.structure_id = g.structure_id AND h.type_a = g.type_a AND h.type_b = g.type_b
    GROUP BY g.structure_id, g.type_a, g.type_b""")
def coordination(spark, sf_dir):
    cn = D.coordination(D.pair_histogram(pairs(spark, sf_dir)), grid(spark, sf_dir))
    return cn.select(*PAIR, *[F.round(f"cn{k}", 6).alias(f"cn{k}") for k in range(4)])


@query("nn_stats", "minima atoms counts", """
    SELECT t.structure_id, a.type_id AS type_a, t.type_id AS type_b,
           round(quantile_cont(coalesce(m.d, 8.0), 0.5), 6) AS nn_med,
           round(quantile_cont(coalesce(m.d, 8.0), 0.1), 6) AS nn_p10
    FROM atoms a JOIN counts t ON t.structure_id = a.structure_id
         LEFT JOIN minima m ON m.structure_id = a.structure_id AND m.i = a.atom_id AND m.type_b = t.type_id
    GROUP BY t.structure_id, a.type_id, t.type_id""")
def nn_stats(spark, sf_dir):
    found = D.pair_profiles(*typed(spark, sf_dir))
    return found.select(*PAIR, F.round(F.col("pair_extra")[4] * R_MAX, 6).alias("nn_med"), F.round(F.col("pair_extra")[5] * R_MAX, 6).alias("nn_p10"))


@query("partial_rdf", "rdf", "SELECT structure_id, type_a, type_b, bin, round(g, 6) AS g FROM rdf")
def partial_rdf(spark, sf_dir):
    return D.long_rdf(D.pair_profiles(*typed(spark, sf_dir))).withColumn("g", F.round("g", 6))


add_view("peaks", "rdf tgrid", """
    SELECT g.structure_id, g.type_a, g.type_b, (coalesce(p.bin, 0) + 0.5) / 64.0 AS peak_pos,
           ln(1 + coalesce(p.g, 0.0)) AS peak_h
    FROM tgrid g LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY structure_id, type_a, type_b ORDER BY g DESC, bin) AS rn FROM rdf) p
    ON p.structure_id = g.structure_id AND p.type_a = g.type_a AND p.type_b = g.type_b AND p.rn = 1""")


@query("rdf_peak", "peaks", """
    SELECT structure_id, type_a, type_b, round(peak_pos, 6) AS peak_pos, round(peak_h, 6) AS peak_h FROM peaks""")
def rdf_peak(spark, sf_dir):
    found = D.pair_profiles(*typed(spark, sf_dir))
    return found.select(*PAIR, F.round(F.col("pair_extra")[6], 6).alias("peak_pos"), F.round(F.col("pair_extra")[7], 6).alias("peak_h"))


@query("cell_geometry", "dims", """
    SELECT structure_id, round(l * l * l, 4) AS volume,
           round(l * l * l / sqrt(pow(l * l, 2) + pow(t * l, 2) + pow(t * v - l * u, 2)), 6) AS h1,
           round(l * l * l / sqrt(pow(l * l, 2) + pow(v * l, 2)), 6) AS h2, round(l, 6) AS h3,
           CAST(ceil(8.0 / (l * l * l / sqrt(pow(l * l, 2) + pow(t * l, 2) + pow(t * v - l * u, 2)))) AS INT) AS n1,
           CAST(ceil(8.0 / (l * l * l / sqrt(pow(l * l, 2) + pow(v * l, 2)))) AS INT) AS n2,
           CAST(ceil(8.0 / l) AS INT) AS n3
    FROM (SELECT structure_id, CAST(edge AS DOUBLE) / 400 AS l, CAST(structure_id % 7 AS DOUBLE) AS t,
                 CAST(structure_id % 5 AS DOUBLE) AS u, CAST(structure_id % 3 AS DOUBLE) AS v FROM dims) d""")
def cell_geometry(spark, sf_dir):
    _, structures = typed(spark, sf_dir)
    side, zero = F.col("cell")[0][0] / 4, F.lit(0.0)
    tilt = [(F.col("structure_id") % m).cast("double") for m in (7, 5, 3)]
    tilted = structures.withColumn("cell", F.array(F.array(side, zero, zero), F.array(tilt[0], side, zero),
                                                   F.array(tilt[1], tilt[2], side)))
    out = G.cell_geometry(tilted)
    return out.select("structure_id", F.round("volume", 4).alias("volume"),
                      *[F.round(f"h{k}", 6).alias(f"h{k}") for k in (1, 2, 3)], "n1", "n2", "n3")


@query("wrap_positions", "atoms", """
    SELECT structure_id, atom_id, round(((xi - 3125 + 2 * edge) % edge) / 100.0, 4) AS x,
           round(((yi + 875 + (label % 3) * edge) % edge) / 100.0, 4) AS y, round(((zi + 200) % edge) / 100.0, 4) AS z
    FROM atoms""")
def wrap_positions(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    moved = atoms.selectExpr("structure_id", "atom_id", "x - 30D AS x", "y + 8.75D AS y", "z AS z", "0 AS ix",
                             "label % 3 AS iy", "label - 4 AS iz")
    boxes = structures.selectExpr("structure_id", "cell", "array(1.25D, 0D, -2D) AS origin")
    edge = boxes.selectExpr("structure_id", "cell[0][0] AS edge")
    out = G.wrap_positions(moved, boxes).join(edge, "structure_id")
    # a point on the face may come back as 0 or as the full edge; both name the same place
    return out.select("structure_id", "atom_id", *[F.expr(f"round({c}, 4) % edge").alias(c) for c in "xyz"])


@query("vacuum_box", "atoms", """
    SELECT structure_id, round((max(xi) - min(xi)) / 100.0 + 10, 6) AS span_x, round((max(yi) - min(yi)) / 100.0 + 10, 6) AS span_y,
           round((max(zi) - min(zi)) / 100.0 + 10, 6) AS span_z, 5.0 AS min_x,
           round(sum(xi) / 100.0 + count(*) * (5 - min(xi) / 100.0), 4) AS sum_x
    FROM atoms GROUP BY structure_id""")
def vacuum_box(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    free = structures.withColumn("cell", F.lit(None).cast("array<array<double>>")).withColumn("pbc", F.lit(False))
    moved, boxed = G.vacuum_box(atoms, free)
    points = moved.groupBy("structure_id").agg(F.round(F.min("x"), 6).alias("min_x"), F.round(F.sum("x"), 4).alias("sum_x"))
    return boxed.select("structure_id", *[F.round(F.col("cell")[k][k], 6).alias(f"span_{c}")
                                          for k, c in enumerate("xyz")]).join(points, "structure_id")


@query("contact_guard", "pairs dims", """
    SELECT d.structure_id, d.n_atoms FROM dims d
    WHERE d.structure_id NOT IN (SELECT structure_id FROM pairs WHERE d2 < 22500)""")
def contact_guard(spark, sf_dir):
    return N.contact_free(*typed(spark, sf_dir), 1.5).select("structure_id", "n_atoms")


@query("empty_types", "atoms dims", """
    SELECT d.structure_id, CAST(l.label AS INT) AS label FROM dims d, (SELECT range AS label FROM range(1, 8)) l
    WHERE NOT EXISTS (SELECT 1 FROM atoms a WHERE a.structure_id = d.structure_id AND a.label = l.label)""")
def empty_types(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    declared = structures.select("structure_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("label"))
    return G.empty_types(declared, atoms)


@query("sample_centers", "atoms", """
    SELECT draw, structure_id, type_id, atom_id FROM (
        SELECT d.draw, structure_id, type_id, atom_id, row_number() OVER (
                   PARTITION BY d.draw, structure_id, type_id
                   ORDER BY md5((1000 + d.draw) || '|' || structure_id || '|' || atom_id), atom_id) AS rn
        FROM atoms, (SELECT CAST(range AS INT) AS draw FROM range(0, 4)) d) t
    WHERE rn <= 3""")
def sample_centers(spark, sf_dir):
    return S.sample_centers(typed(spark, sf_dir)[0], 3, 1000, draws=4)


add_view("env", "atoms pairs", """
    SELECT structure_id, i, type_a, rank, d, type_b FROM (
        SELECT p.*, row_number() OVER (PARTITION BY structure_id, i ORDER BY round(d, 7), type_b, j) AS rank
        FROM pairs p WHERE d2 <= 360000) t
    WHERE rank <= 16 AND i IN (
        SELECT atom_id FROM (SELECT structure_id AS s, atom_id, row_number() OVER (
            PARTITION BY structure_id, type_id ORDER BY md5('12345|' || structure_id || '|' || atom_id), atom_id) AS rn
            FROM atoms) c WHERE c.rn <= 16 AND c.s = t.structure_id)""")


def environments(spark, sf_dir, grouped=False):
    atoms, structures = typed(spark, sf_dir)
    return N.environment_sets(atoms, structures, S.sample_centers(atoms), grouped=grouped)


@query("environment_sets", "env", """
    SELECT structure_id, i, type_a, CAST(rank AS INT) AS rank, round(d, 6) AS d, type_b FROM env""")
def environment_sets(spark, sf_dir):
    return environments(spark, sf_dir).withColumn("d", F.round("d", 6))


add_view("nn", "atoms", """
    SELECT a.structure_id, a.atom_id, sqrt(min(pow(a.xi - b.xi, 2) + pow(a.yi - b.yi, 2) + pow(a.zi - b.zi, 2))) / 100.0 AS d
    FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_id <> b.atom_id
    GROUP BY a.structure_id, a.atom_id""")


@query("nn_distance", "nn", "SELECT structure_id, atom_id, round(d, 6) AS d FROM nn")
def nn_distance(spark, sf_dir):
    return N.nn_distance(typed(spark, sf_dir)[0]).withColumn("d", F.round("d", 6))


@query("unit_gate", "nn", """
    , stored AS (SELECT structure_id, d / (CASE structure_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 10.0 ELSE 0.529177 END) AS d FROM nn),
    units AS (SELECT * FROM (VALUES ('angstrom', 0, 1.0), ('bohr', 1, 0.529177), ('nm', 2, 10.0), ('um', 3, 1e4),
                                    ('cm', 4, 1e8), ('m', 5, 1e10)) u(unit, ord, scale)),
    scores AS (SELECT structure_id, unit, ord, scale,
                      avg(CASE WHEN d * scale BETWEEN 0.6 - 1e-9 AND 3.6 + 1e-9 THEN 1.0 ELSE 0.0 END) AS score
               FROM stored, units GROUP BY structure_id, unit, ord, scale),
    best AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY score DESC, ord) AS rn FROM scores)
    SELECT structure_id, CASE WHEN score >= 0.6 THEN 'atoms' ELSE 'not_atoms' END AS verdict,
           CASE WHEN score >= 0.6 THEN unit END AS unit, CASE WHEN score >= 0.6 THEN scale END AS scale,
           round(score, 6) AS score
    FROM best WHERE rn = 1""")
def unit_gate(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    factor = F.when(F.col("structure_id") % 3 == 0, 1.0).when(F.col("structure_id") % 3 == 1, 10.0).otherwise(0.529177)
    nn = N.nn_distance(atoms.withColumns({c: F.col(c) / factor for c in "xyz"}))
    return U.unit_gate(structures, nn).select("structure_id", "verdict", "unit", "scale", F.round("score", 6).alias("score"))


@query("quality_gate", "dims atoms", """
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (
        SELECT CASE WHEN n_atoms < 20 THEN 'too_few_atoms' WHEN n_atoms > 38 THEN 'too_many_atoms'
                    WHEN volume < 1 THEN 'tiny_volume' WHEN n_types < 7 THEN 'too_few_types'
                    WHEN z_min < 1 OR z_max > 94 THEN 'element_out_of_range' END AS reason
        FROM (SELECT structure_id, count(*) AS n_atoms, count(DISTINCT label) AS n_types, power(max(edge) / 100.0, 3) AS volume,
                     min((structure_id * 13 + label * 5) % 97) AS z_min, max((structure_id * 13 + label * 5) % 97) AS z_max
              FROM atoms GROUP BY structure_id) s) r
    GROUP BY 1""")
def quality_gate(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    marked = atoms.withColumn("zn", (F.col("structure_id") * 13 + F.col("label") * 5) % 97)
    rules = Q.Rules(min_atoms=20, max_atoms=38, min_volume=1.0, min_types=7)
    return Q.reject_reasons(Q.quality_gate(Q.structure_stats(marked, structures), rules))


add_view("pair_extra", "tgrid hist atoms counts minima peaks", """
    SELECT c.structure_id, c.type_a, c.type_b, ln(1 + cn0) AS e0, ln(1 + cn1) AS e1, ln(1 + cn2) AS e2, ln(1 + cn3) AS e3,
           nn_med / 8 AS e4, nn_p10 / 8 AS e5, peak_pos AS e6, peak_h AS e7
    FROM (SELECT g.structure_id, g.type_a, g.type_b,
                 coalesce(sum(n) FILTER (WHERE bin <= 16), 0) / max(g.n_a) AS cn0,
                 coalesce(sum(n) FILTER (WHERE bin <= 24), 0) / max(g.n_a) AS cn1,
                 coalesce(sum(n) FILTER (WHERE bin <= 32), 0) / max(g.n_a) AS cn2,
                 coalesce(sum(n) FILTER (WHERE bin <= 48), 0) / max(g.n_a) AS cn3
          FROM tgrid g LEFT JOIN hist h ON h.structure_id = g.structure_id AND h.type_a = g.type_a AND h.type_b = g.type_b
          GROUP BY 1, 2, 3) c
    JOIN (SELECT t.structure_id, a.type_id AS type_a, t.type_id AS type_b, quantile_cont(coalesce(m.d, 8.0), 0.5) AS nn_med,
                 quantile_cont(coalesce(m.d, 8.0), 0.1) AS nn_p10
          FROM atoms a JOIN counts t ON t.structure_id = a.structure_id
               LEFT JOIN minima m ON m.structure_id = a.structure_id AND m.i = a.atom_id AND m.type_b = t.type_id
          GROUP BY 1, 2, 3) q USING (structure_id, type_a, type_b)
    JOIN peaks USING (structure_id, type_a, type_b)""")


@query("pair_features", "pair_extra", """
    SELECT structure_id, type_a, type_b, round(e0, 7) AS e0, round(e1, 7) AS e1, round(e2, 7) AS e2, round(e3, 7) AS e3,
           round(e4, 7) AS e4, round(e5, 7) AS e5, round(e6, 7) AS e6, round(e7, 7) AS e7 FROM pair_extra""")
def pair_features(spark, sf_dir):
    pair_rows, _ = D.compute_features(*typed(spark, sf_dir), with_env=False)
    return pair_rows.select(*PAIR, *[F.round(F.col("pair_extra")[k], 7).alias(f"e{k}") for k in range(8)])


@query("global_features", "counts dims", """
    SELECT c.structure_id, c.type_id, round(c.n / d.n_atoms, 6) AS frac, round(ln(d.n_atoms / power(d.edge / 100.0, 3)), 6) AS ln_density,
           1.0 AS has_cell, round(1.0 / count(*) OVER (PARTITION BY c.structure_id), 6) AS inv_types
    FROM counts c JOIN dims d ON d.structure_id = c.structure_id""")
def global_features(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    out = D.global_features(G.type_counts(atoms), structures)
    return out.select("structure_id", "type_id", F.round("frac", 6).alias("frac"), F.round(F.col("glob")[0], 6).alias("ln_density"),
                      F.col("glob")[1].alias("has_cell"), F.round(F.col("glob")[2], 6).alias("inv_types"))


@query("average_frames", "rdf pair_extra counts dims", """
    , shared AS (SELECT structure_id // 10 AS system_id, count(*) AS n_frames FROM dims GROUP BY 1),
    g AS (SELECT structure_id // 10 AS system_id, type_a, type_b, sum(g) AS g FROM rdf GROUP BY 1, 2, 3),
    e AS (SELECT structure_id // 10 AS system_id, type_a, type_b, sum(e3) AS e3, sum(e4) AS e4 FROM pair_extra GROUP BY 1, 2, 3)
    SELECT e.system_id, e.type_a, e.type_b, round(coalesce(g.g, 0) / s.n_frames, 4) AS sum_g,
           round(e.e3 / s.n_frames, 6) AS cn6, round(e.e4 / s.n_frames, 8) AS nn_med
    FROM e JOIN shared s ON s.system_id = e.system_id
         LEFT JOIN g ON g.system_id = e.system_id AND g.type_a = e.type_a AND g.type_b = e.type_b""")
def average_frames(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    system = {"system_id": F.floor(F.col("structure_id") / 10).cast("long"), "frame_id": F.col("structure_id") % 10}
    # ten frames a system, reduced in the task that describes them
    pair_rows, type_rows = D.compute_features(atoms, structures.withColumns(system), with_env=False, near="system_id")
    fused, _ = D.average_frames(pair_rows, type_rows.withColumns(system))
    return fused.select("system_id", "type_a", "type_b", F.round(F.aggregate("rdf", F.lit(0.0), lambda a, v: a + v), 4).alias("sum_g"),
                        F.round(F.col("pair_extra")[3], 6).alias("cn6"), F.round(F.col("pair_extra")[4], 8).alias("nn_med"))


# larger structures, one per supplier in a cell of 60 A or more, for the crop
add_view("bulk", "base", """
    SELECT l_suppkey AS structure_id, count(*) OVER (PARTITION BY l_suppkey) AS n, edge, c % edge AS xi,
           (p * 7919 + o * 31 + c) % edge AS yi, (o * 104729 + label * 31 + p * 17) % edge AS zi
    FROM (SELECT l_suppkey, l_partkey AS p, l_orderkey AS o, l_linenumber AS label,
                 min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY 1, 2, 3, 4) b
    JOIN (SELECT l_suppkey AS s, CAST(6000 * ceil(round(cbrt(count(*) / 1000.0), 6)) AS BIGINT) AS edge
          FROM lineitem GROUP BY 1) d ON d.s = b.l_suppkey""")


@query("interior_crop", "bulk", """
    , q AS (SELECT *, least(1.0, greatest(pow(200.0 / n, 1.0 / 3), 20.0 / (edge / 100.0))) AS q, 8.0 / (edge / 100.0) AS m FROM bulk),
    k AS (SELECT structure_id, n, xi, (xi::DOUBLE / edge) >= m - 1e-9 AND (xi::DOUBLE / edge) < q - m - 1e-9
                 AND (yi::DOUBLE / edge) >= m - 1e-9 AND (yi::DOUBLE / edge) < q - m - 1e-9
                 AND (zi::DOUBLE / edge) >= m - 1e-9 AND (zi::DOUBLE / edge) < q - m - 1e-9 AS is_center
          FROM q WHERE n > 200 AND NOT (q >= 1.0 - 1e-9 AND q * q * q > 0.9) AND (xi::DOUBLE / edge) < q - 1e-9
                 AND (yi::DOUBLE / edge) < q - 1e-9 AND (zi::DOUBLE / edge) < q - 1e-9),
    done AS (SELECT structure_id, count(*) AS n_kept, count(*) FILTER (WHERE is_center) AS n_centers, round(sum(xi) / 100.0, 4) AS sum_x
             FROM k GROUP BY structure_id HAVING count(*) FILTER (WHERE is_center) >= 5)
    SELECT * FROM done UNION ALL
    SELECT structure_id, count(*), count(*), round(sum(xi) / 100.0, 4) FROM bulk
    WHERE structure_id NOT IN (SELECT structure_id FROM done) GROUP BY structure_id""")
def interior_crop(spark, sf_dir):
    atoms, structures = bulk(spark, sf_dir)
    points, _ = S.interior_crop(atoms, structures, 200, min_centers=5)
    return points.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if("is_center").alias("n_centers"),
                                              F.round(F.sum("x"), 4).alias("sum_x"))


def bulk(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    base = lines.groupBy("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").agg(
        F.min(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    dims = lines.groupBy("l_suppkey").agg((F.ceil(F.round(F.cbrt(F.count(F.lit(1)) / 1000.0), 6)) * 6000).cast("long").alias("edge"))
    atoms = staged(base.join(dims, "l_suppkey").selectExpr(
        "l_suppkey AS structure_id", "xxhash64(l_partkey, l_orderkey, l_linenumber) AS atom_id", "l_linenumber AS label",
        "edge", "c % edge / 100D AS x", "(l_partkey * 7919 + l_orderkey * 31 + c) % edge / 100D AS y",
        "(l_orderkey * 104729 + l_linenumber * 31 + l_partkey * 17) % edge / 100D AS z"), "bulk")
    sides = atoms.groupBy("structure_id", "edge").agg(F.count(F.lit(1)).alias("n_atoms"))
    structures = sides.select("structure_id", G.diagonal([F.col("edge") / 100.0] * 3).alias("cell"),
                              F.lit(True).alias("pbc"), "n_atoms")
    return atoms.drop("edge"), structures
