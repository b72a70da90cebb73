"""Checks of augmentation, feature records, tokens and batch scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import corpus as C
from ..operators import descriptors as D
from ..operators import geometry as G
from ..operators import scoring as P
from ..operators import tokens as T
from ..session import scratch_path, staged
from ..sources import store
from .base import add_view, query
from .base import typed_atoms as typed
from .structures import environments

_U = "(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def u(*parts: str) -> str:
    """SQL of the hash-uniform; quoted parts are text, others are columns."""
    return _U.format(key=" || '|' || ".join(f"CAST({p} AS VARCHAR)" if not p.startswith("'") else p for p in parts))


def normal_sql(*parts: str) -> str:
    return f"sqrt(-2.0 * ln(1.0 - {u(*parts, chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {u(*parts, chr(39) + 't' + chr(39))})"


@query("aug_jitter", "atoms", f"""
    SELECT structure_id, atom_id, round(xi / 100.0 + s * {normal_sql("'7'", "structure_id", "atom_id", "'x'")}, 5) AS x,
           round(yi / 100.0 + s * {normal_sql("'7'", "structure_id", "atom_id", "'y'")}, 5) AS y,
           round(zi / 100.0 + s * {normal_sql("'7'", "structure_id", "atom_id", "'z'")}, 5) AS z
    FROM (SELECT *, 0.02 + 0.33 * {u("'7'", "structure_id", "'sigma'")} AS s FROM atoms) a""")
def aug_jitter(spark, sf_dir):
    moved = A.jitter(typed(spark, sf_dir)[0], 7)
    return moved.select("structure_id", "atom_id", *[F.round(c, 5).alias(c) for c in "xyz"])


def _e(r: int, c: int) -> str:
    return f"(-0.03 + 0.06 * {u(chr(39) + '7' + chr(39), 'structure_id', chr(39) + f'e{r}{c}' + chr(39))})"


_S = {(r, c): f"(1.0 + {_e(r, r)})" if r == c else f"(({_e(min(r, c), max(r, c))} + {_e(max(r, c), min(r, c))}) * 0.5)"
      for r in range(3) for c in range(3)}


@query("aug_strain", "atoms", f"""
    , s AS (SELECT structure_id, edge / 100.0 AS edge, {", ".join(f"{v} AS s{r}{c}" for (r, c), v in _S.items())}
            FROM (SELECT DISTINCT structure_id, edge FROM atoms) d)
    SELECT a.structure_id, round(sum(xi * s00 + yi * s10 + zi * s20) / 100.0, 3) AS sum_x,
           round(sum(xi * s01 + yi * s11 + zi * s21) / 100.0, 3) AS sum_y,
           round(max(s.edge * s00), 6) AS c00, round(max(s.edge * s12), 6) AS c12
    FROM atoms a JOIN s ON s.structure_id = a.structure_id GROUP BY a.structure_id""")
def aug_strain(spark, sf_dir):
    moved, cells = A.strain(*typed(spark, sf_dir), 7)
    sums = moved.groupBy("structure_id").agg(F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y"))
    return sums.join(cells.select("structure_id", F.round(F.col("cell")[0][0], 6).alias("c00"),
                                  F.round(F.col("cell")[1][2], 6).alias("c12")), "structure_id")


@query("aug_subsample", "atoms counts", f"""
    , pick AS (SELECT structure_id, type_id, greatest(2, CAST(floor((0.05 + 0.45 * {u("'7'", "structure_id", "'keep'")}) * n) AS INT)) AS k
               FROM (SELECT *, row_number() OVER (PARTITION BY structure_id
                            ORDER BY md5('7|' || structure_id || '|' || type_id || '|dilute'), type_id) AS rn
                     FROM counts WHERE n >= 8) c WHERE rn = 1),
    gone AS (SELECT structure_id, atom_id FROM (
                SELECT a.structure_id, a.atom_id, p.k, row_number() OVER (PARTITION BY a.structure_id
                       ORDER BY {u("'7'", "a.structure_id", "a.atom_id", "'d'")}, a.atom_id) AS r
                FROM atoms a JOIN pick p ON p.structure_id = a.structure_id AND p.type_id = a.type_id) t WHERE r > k)
    SELECT structure_id, type_id, count(*) AS n, CAST(sum(atom_id) AS BIGINT) AS ids FROM atoms a
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.structure_id = a.structure_id AND g.atom_id = a.atom_id)
    GROUP BY structure_id, type_id""")
def aug_subsample(spark, sf_dir):
    thin = A.subsample_type(typed(spark, sf_dir)[0], 7)
    return thin.groupBy("structure_id", "type_id").agg(F.count(F.lit(1)).alias("n"), F.sum("atom_id").alias("ids"))


def _beta_sql(purpose: str, a: float, b: float) -> str:
    """SQL of a beta draw: the first of 16 hashed pairs whose sum is at most one."""
    def draw(letter: str, power: float) -> str:
        return f"pow({u(chr(39) + '7' + chr(39), 'structure_id', chr(39) + purpose + chr(39), 't', chr(39) + letter + chr(39))}, {1 / power!r})"
    pairs = f"list_transform(range(0, 16), lambda t: {{'x': {draw('u', a)}, 'y': {draw('v', b)}}})"
    return f"list_transform(list_filter({pairs}, lambda p: p.x + p.y <= 1 AND p.x + p.y > 0)[1:1], lambda p: p.x / (p.x + p.y))[1]"


_AHEAD = ("CAST(1 + CAST(f{1} - e{1} < f{0} - e{0} OR (f{1} - e{1} = f{0} - e{0} AND {1} < {0}) AS INT)"
          " + CAST(f{2} - e{2} < f{0} - e{0} OR (f{2} - e{2} = f{0} - e{0} AND {2} < {0}) AS INT) <= n - m - f0 - f1 - f2 AS INT)")


@query("aug_split", "atoms counts", f"""
    , sized AS (SELECT *, count(*) OVER (PARTITION BY structure_id) AS t FROM counts),
    pick AS (SELECT structure_id, type_id, n, t, 2 + CAST(floor({u("'7'", "structure_id", "'m'")} * (least(3, 9 - t) - 1)) AS INT) AS m,
                    1 + CAST(floor({u("'7'", "structure_id", "'c1'")} * (n - 1)) AS BIGINT) AS c1,
                    1 + CAST(floor({u("'7'", "structure_id", "'c2'")} * (n - 2)) AS BIGINT) AS c2,
                    {u("'7'", "structure_id", "'order'")} < 0.5 AS shuffled,
                    CAST(floor({u("'7'", "structure_id", "'axis'")} * 3) AS INT) AS axis
             FROM (SELECT *, row_number() OVER (PARTITION BY structure_id
                          ORDER BY md5('7|' || structure_id || '|' || type_id || '|split'), type_id) AS rn
                   FROM sized WHERE n >= 4 AND t < 8) c WHERE rn = 1),
    stick AS (SELECT *, {_beta_sql("stick20", 0.3, 0.3)} AS b2, {_beta_sql("stick30", 0.3, 0.6)} AS b3,
                     {_beta_sql("stick31", 0.3, 0.3)} AS b31 FROM pick),
    exact AS (SELECT *, (n - m) * CASE WHEN m = 2 THEN b2 ELSE b3 END AS e0,
                     (n - m) * CASE WHEN m = 2 THEN 1 - b2 ELSE (1 - b3) * b31 END AS e1,
                     CASE WHEN m = 2 THEN 0.0 ELSE (n - m) * ((1 - b3) * (1 - b31)) END AS e2 FROM stick),
    floors AS (SELECT *, CAST(floor(e0) AS BIGINT) AS f0, CAST(floor(e1) AS BIGINT) AS f1, CAST(floor(e2) AS BIGINT) AS f2 FROM exact),
    uneven AS (SELECT *, 1 + f0 + {_AHEAD.format(0, 1, 2)} AS u1, 2 + f0 + f1 + {_AHEAD.format(0, 1, 2)} + {_AHEAD.format(1, 0, 2)} AS u2
               FROM floors),
    cut AS (SELECT * REPLACE (CASE WHEN skew THEN u1 WHEN m = 2 THEN c1 ELSE least(c1, c2x) END AS c1),
                   CASE WHEN skew THEN u2 ELSE greatest(c1, c2x) END AS c3
            FROM (SELECT *, CASE WHEN c2 >= c1 THEN c2 + 1 ELSE c2 END AS c2x,
                         {u("'7'", "structure_id", "'sizes'")} < 0.5 AS skew FROM uneven) x),
    pos AS (SELECT a.structure_id, a.atom_id, p.t, p.m, p.c1, p.c3, row_number() OVER (PARTITION BY a.structure_id
                   ORDER BY CASE WHEN shuffled THEN {u("'7'", "a.structure_id", "a.atom_id", "'perm'")}
                                 WHEN axis = 0 THEN xi / 100.0 WHEN axis = 1 THEN yi / 100.0 ELSE zi / 100.0 END, a.atom_id) - 1 AS r
            FROM atoms a JOIN cut p ON p.structure_id = a.structure_id AND p.type_id = a.type_id),
    g AS (SELECT structure_id, atom_id, t, CASE WHEN m = 2 THEN CAST(c1 <= r AS INT)
                 ELSE CAST(c1 <= r AS INT) + CAST(c3 <= r AS INT) END AS g FROM pos)
    SELECT a.structure_id, CAST(CASE WHEN g.g > 0 THEN g.t + g.g - 1 ELSE a.type_id END AS INT) AS type_id, count(*) AS n,
           CAST(sum(a.atom_id) AS BIGINT) AS ids
    FROM atoms a LEFT JOIN g ON g.structure_id = a.structure_id AND g.atom_id = a.atom_id GROUP BY 1, 2""")
def aug_split(spark, sf_dir):
    split = A.type_split(typed(spark, sf_dir)[0], 7)
    return split.groupBy("structure_id", "type_id").agg(F.count(F.lit(1)).alias("n"), F.sum("atom_id").alias("ids"))


@query("make_variants", "dims", """
    SELECT structure_id AS parent_id, 3 AS n_variants, n_atoms AS clean_atoms FROM dims""")
def make_variants(spark, sf_dir):
    _, cells = A.make_variants(*typed(spark, sf_dir), n_aug=2, seed=7)
    return cells.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_variants"),
                                          F.max(F.when(F.col("variant") == 0, F.col("n_atoms"))).alias("clean_atoms"))


@query("test_time_variants", "atoms", f"""
    , v AS (SELECT * FROM atoms, (SELECT range AS variant FROM range(0, 3)) r),
    s AS (SELECT *, structure_id || '#' || variant AS sid FROM v)
    SELECT structure_id, CAST(variant AS INT) AS variant, count(*) AS n, round(sum(xi / 100.0 + CASE WHEN variant = 0 THEN 0 ELSE
           (0.02 + 0.13 * {u("'0'", "sid", "'sigma'")}) * {normal_sql("'0'", "sid", "atom_id", "'x'")} END), 4) AS sum_x
    FROM s GROUP BY structure_id, variant""")
def test_time_variants(spark, sf_dir):
    copies = A.test_time_variants(typed(spark, sf_dir)[0], 2)
    return copies.groupBy("structure_id", "variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sum_x"))


@query("pad_types", "counts dims", """
    SELECT d.structure_id, CAST(s.range AS INT) AS type_id, c.n IS NOT NULL AS mask, round(coalesce(c.n, 0) / d.n_atoms, 6) AS frac
    FROM dims d CROSS JOIN range(0, 8) s LEFT JOIN counts c ON c.structure_id = d.structure_id AND c.type_id = s.range""")
def pad_types(spark, sf_dir):
    return T.pad_types(G.type_fractions(typed(spark, sf_dir)[0])).withColumn("frac", F.round("frac", 6))


@query("rbf_env_features", "env", """
    SELECT structure_id, type_a AS type_id, """ + ", ".join(f"round(avg(r{k}), 6) AS r{k}" for k in range(16)) + """
    FROM (SELECT structure_id, type_a, i, """ + ", ".join(
        f"avg(exp(-0.5 / pow(6.0 / 16, 2) * pow(d - {k} * 6.0 / 15, 2))) AS r{k}" for k in range(16)) + """
          FROM env GROUP BY 1, 2, 3) t GROUP BY 1, 2""")
def rbf_env_features(spark, sf_dir):
    pooled = T.pool_environments(environments(spark, sf_dir, grouped=True))
    return pooled.select("structure_id", "type_id", *[F.round(F.col("rbf")[k], 6).alias(f"r{k}") for k in range(16)])


@query("type_tokens", "rdf pair_extra counts dims", """
    , r AS (SELECT structure_id, type_a, sum(s) AS total, sum(m) AS peak FROM (
                SELECT structure_id, type_a, bin, sum(ln(1 + g)) AS s, max(ln(1 + g)) AS m FROM rdf GROUP BY 1, 2, 3) b GROUP BY 1, 2),
    e AS (SELECT structure_id, type_a, sum(e0 + e1 + e2 + e3 + e4 + e5 + e6 + e7) AS total,
                 max(e0) + max(e1) + max(e2) + max(e3) + max(e4) + max(e5) + max(e6) + max(e7) AS peak FROM pair_extra GROUP BY 1, 2),
    f AS (SELECT c.structure_id, count(*) AS t, max(c.n) * 1.0 / max(d.n_atoms) AS top FROM counts c
          JOIN dims d ON d.structure_id = c.structure_id GROUP BY 1)
    SELECT e.structure_id, e.type_a AS type_id, round((coalesce(r.total, 0) + e.total + 2) / f.t, 4) AS sum_mean,
           round(coalesce(r.peak, 0) + e.peak + f.top + 1, 4) AS sum_max
    FROM e JOIN f ON f.structure_id = e.structure_id LEFT JOIN r ON r.structure_id = e.structure_id AND r.type_a = e.type_a""")
def type_tokens(spark, sf_dir):
    tokens = T.pooled_types(D.packed_features(*typed(spark, sf_dir), with_env=False))

    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 4)

    return tokens.select("structure_id", "type_id", total("mean").alias("sum_mean"), total("max").alias("sum_max"))


add_view("struct_gid", "atoms elements", """
    SELECT structure_id, count(*) AS n_types, CAST('0x' || substr(md5(string_agg(symbol, ',' ORDER BY symbol)), 1, 12) AS BIGINT) AS gid
    FROM (SELECT DISTINCT structure_id, (structure_id * 13 + label * 5) % 94 + 1 AS zn FROM atoms) a
    JOIN elements ON elements.zn = a.zn GROUP BY structure_id""")


@query("feature_roundtrip", "struct_gid counts dims", """
    SELECT s.structure_id, CAST(s.n_types AS INT) AS n_types, s.gid, round(max(c.n) * 1.0 / max(d.n_atoms), 5) AS top_frac
    FROM struct_gid s JOIN counts c ON c.structure_id = s.structure_id JOIN dims d ON d.structure_id = s.structure_id
    WHERE s.gid % 10 = 0 AND s.n_types <= 6 GROUP BY s.structure_id, s.n_types, s.gid""")
def feature_roundtrip(spark, sf_dir):
    from ..elements import elements
    atoms, _ = typed(spark, sf_dir)
    named = atoms.withColumn("zn", ((F.col("structure_id") * 13 + F.col("label") * 5) % 94 + 1).cast("int")).join(
        F.broadcast(elements(spark)), "zn")
    gids = C.group_id(named, ["structure_id"])
    fractions = G.type_fractions(atoms).groupBy("structure_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("type_id", "frac"))), lambda e: e["frac"]).alias("frac"))
    records = gids.join(fractions, "structure_id").select(
        "structure_id", F.lit("lines").alias("source"), F.col("n_elements").alias("n_types"), "gid", "frac")
    path = scratch_path(spark, "features")
    store.write_features(records, path)
    back = store.read_features(spark, [path], "val", max_types=6)
    return back.select("structure_id", "n_types", "gid", F.round(F.array_max("frac").cast("double"), 5).alias("top_frac"))


def tilted_softmax(batch):
    """A stand-in model: class scores grow with the type's fraction."""
    z = np.arange(1, 95) / 10.0
    tables = []
    for fractions in batch["frac"]:
        scores = np.outer(np.asarray(fractions), z)
        weights = np.exp(scores - scores.max(axis=1, keepdims=True))
        tables.append(weights / weights.sum(axis=1, keepdims=True))
    return tables


@query("score_batch", "counts dims", """
    , s AS (SELECT c.structure_id, c.type_id, z.range AS zn, exp(c.n * 1.0 / d.n_atoms * z.range / 10.0) AS w
            FROM counts c JOIN dims d ON d.structure_id = c.structure_id CROSS JOIN range(1, 95) z)
    SELECT structure_id, type_id, CAST(rank AS INT) AS rank, CAST(zn AS INT) AS zn, round(p, 5) AS p FROM (
        SELECT *, w / sum(w) OVER (PARTITION BY structure_id, type_id) AS p,
               row_number() OVER (PARTITION BY structure_id, type_id ORDER BY w DESC, zn) AS rank FROM s) t WHERE rank <= 3""")
def score_batch(spark, sf_dir):
    probs = P.score_batch(T.model_rows(D.packed_features(*typed(spark, sf_dir), with_env=False)), tilted_softmax)
    return P.top_candidates(probs, 3).select("structure_id", "type_id", "rank", "zn", F.round("p", 5).alias("p"))
