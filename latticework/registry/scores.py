"""Checks of fusion, ranking, calibration and joint decoding on dot-product models over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as K
from ..operators import decode as J
from ..operators import descriptors as D
from ..operators import scoring as P
from .base import add_view, model_probs_view, probs3_view, query
from .corpus import pmi_table

ITEM = ["structure_id", "type_id"]


def truth_of(probs):
    return probs.select(*ITEM, "true_zn").distinct()


def model_logs(spark, sf_dir):
    return model_probs_view(spark, sf_dir).withColumn("logp", P.log_of())


add_view("mlog", "model_probs", "SELECT *, ln(p + 1e-12) AS logp FROM model_probs")
_NORMAL = """
    SELECT structure_id, type_id, zn, round(l - mx - ln(sum(exp(l - mx)) OVER (PARTITION BY structure_id, type_id)), 6) AS logp
    FROM (SELECT *, max(l) OVER (PARTITION BY structure_id, type_id) AS mx FROM ({mix}) m) f"""
_MIX = {
    "logmean": "SELECT structure_id, type_id, zn, avg(logp) AS l FROM mlog GROUP BY 1, 2, 3",
    "probmean": "SELECT structure_id, type_id, zn, ln(sum(exp(logp))) - ln(count(*)) AS l FROM mlog GROUP BY 1, 2, 3",
    "conf": """SELECT structure_id, type_id, zn, ln(sum(w * exp(logp)) / sum(w) + 1e-12) AS l
               FROM (SELECT *, exp(4 * exp(max(logp) OVER (PARTITION BY structure_id, type_id, model))) AS w FROM mlog) t
               GROUP BY 1, 2, 3""",
    "median": """SELECT structure_id, type_id, zn, max(logp) AS l
                 FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, type_id, zn ORDER BY logp) AS rn,
                              count(*) OVER (PARTITION BY structure_id, type_id, zn) AS k FROM mlog) t
                 WHERE rn = (k + 1) // 2 GROUP BY 1, 2, 3""",
}


def _register_fusion(mode):
    @query(f"fuse_{mode}", "mlog", _NORMAL.format(mix=_MIX[mode]))
    def fuse(spark, sf_dir):
        return P.fuse(model_logs(spark, sf_dir), mode).withColumn("logp", F.round("logp", 6))

    return fuse


for _mode in _MIX:
    _register_fusion(_mode)


@query("temperature_softmax", "probs3", """
    SELECT structure_id, type_id, zn, round(exp(z - mx) / sum(exp(z - mx)) OVER (PARTITION BY structure_id, type_id), 6) AS p
    FROM (SELECT *, max(z) OVER (PARTITION BY structure_id, type_id) AS mx
          FROM (SELECT *, ln(p + 1e-12) / 2.5 AS z FROM probs3) a) b""")
def temperature_softmax(spark, sf_dir):
    return P.apply_temperature(probs3_view(spark, sf_dir), 2.5).select(*ITEM, "zn", F.round("p", 6).alias("p"))


@query("log_pool", "model_probs", """
    SELECT structure_id, type_id, zn, round(avg(ln(p + 1e-12)), 6) AS logp FROM model_probs GROUP BY 1, 2, 3""")
def log_pool(spark, sf_dir):
    return P.log_pool(model_probs_view(spark, sf_dir), [*ITEM, "zn"]).withColumn("logp", F.round("logp", 6))


@query("debias", "probs3", """
    SELECT structure_id, type_id, zn, round(ln(p + 1e-12) - 0.5 * ln(greatest(CASE WHEN zn % 4 = 0 THEN 0 ELSE zn / 5.0 END, 1e-6)), 6) AS logp
    FROM probs3""")
def debias(spark, sf_dir):
    probs = probs3_view(spark, sf_dir).withColumn("logp", P.log_of())
    weights = probs.select("zn").distinct().withColumn("weight", F.when(F.col("zn") % 4 == 0, 0.0).otherwise(F.col("zn") / 5.0))
    return P.debias(probs, weights, 0.5).select(*ITEM, "zn", F.round("logp", 6).alias("logp"))


add_view("ranks", "probs3", """
    SELECT *, row_number() OVER (PARTITION BY structure_id, type_id ORDER BY p DESC, zn) AS rank FROM probs3""")


@query("top_candidates", "ranks", """
    SELECT structure_id, type_id, CAST(rank AS INT) AS rank, zn, round(p, 6) AS p FROM ranks WHERE rank <= 5""")
def top_candidates(spark, sf_dir):
    return P.top_candidates(probs3_view(spark, sf_dir), 5).select(*ITEM, "rank", "zn", F.round("p", 6).alias("p"))


def true_ranks(spark, sf_dir):
    probs = probs3_view(spark, sf_dir)
    return P.join_truth(probs.drop("true_zn"), truth_of(probs))


@query("hits_at_k", "ranks", """
    SELECT true_zn AS case_id, count(*) FILTER (WHERE rank <= 1) AS top1, count(*) FILTER (WHERE rank <= 3) AS top3,
           count(*) FILTER (WHERE rank <= 5) AS top5, count(*) AS n
    FROM ranks WHERE zn = true_zn GROUP BY ROLLUP (true_zn)""")
def hits_at_k(spark, sf_dir):
    return P.hits_at_k(true_ranks(spark, sf_dir).withColumnRenamed("true_zn", "case_id"), "case_id")


@query("rank_report", "ranks", """
    SELECT CASE WHEN true_zn % 3 = 0 THEN 'unseen-set' ELSE 'seen-set' END AS bucket, count(*) AS n,
           round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS top3,
           round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS top5, quantile_cont(rank, 0.5) AS median_rank
    FROM ranks WHERE zn = true_zn GROUP BY 1""")
def rank_report(spark, sf_dir):
    bucket = F.when(F.col("true_zn") % 3 == 0, "unseen-set").otherwise("seen-set")
    report = P.rank_report(true_ranks(spark, sf_dir).withColumn("bucket", bucket), "bucket")
    return report.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("top1", "top3", "top5")], "median_rank")


@query("fit_temperature", "probs3", """
    , g AS (SELECT round(0.5 + 0.1 * range, 1) AS t FROM range(0, 76)),
    z AS (SELECT structure_id, type_id, t, zn, true_zn, ln(p + 1e-12) / t AS z FROM probs3, g),
    m AS (SELECT *, max(z) OVER (PARTITION BY structure_id, type_id, t) AS mx FROM z),
    s AS (SELECT structure_id, type_id, t, -ln(max(exp(z - mx)) FILTER (WHERE zn = true_zn) / sum(exp(z - mx)) + 1e-12) AS nll
          FROM m GROUP BY 1, 2, 3),
    a AS (SELECT t, avg(nll) AS nll FROM s GROUP BY t)
    SELECT CAST(t AS DOUBLE) AS temperature, round(nll, 6) AS nll, row_number() OVER (ORDER BY nll, t) = 1 AS best FROM a""")
def fit_temperature(spark, sf_dir):
    probs = probs3_view(spark, sf_dir)
    return K.fit_temperature(probs.drop("true_zn"), truth_of(probs)).withColumn("nll", F.round("nll", 6))


add_view("cum", "ranks", """
    SELECT *, c + 0.02 * greatest(0, rank - 4) AS score, c - p + 0.02 * greatest(0, rank - 5) AS before FROM (
        SELECT *, sum(p) OVER (PARTITION BY structure_id, type_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM ranks) t""")
add_view("qhat", "cum", """
    SELECT max(k) AS n, max(score) FILTER (WHERE rn = CAST(ceil(least(1.0, ceil((k + 1) * 0.9::DOUBLE) / k) * (k - 1)) AS BIGINT) + 1) AS qhat
    FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS k FROM cum WHERE zn = true_zn) t""")


def quantile_row(spark, sf_dir):
    probs = probs3_view(spark, sf_dir)
    return K.raps_quantile(K.raps_scores(probs.drop("true_zn"), truth_of(probs)), 0.9)


def sets(spark, sf_dir):
    calibration = quantile_row(spark, sf_dir).withColumns({"lam": F.lit(K.LAMBDA), "k_reg": F.lit(K.K_REG)})
    return K.raps_sets(probs3_view(spark, sf_dir).drop("true_zn"), calibration)


@query("raps_quantile", "qhat", "SELECT n, round(qhat, 6) AS qhat FROM qhat")
def raps_quantile(spark, sf_dir):
    return quantile_row(spark, sf_dir).withColumn("qhat", F.round("qhat", 6))


@query("raps_sets", "cum qhat", """
    SELECT structure_id, type_id, count(*) AS size, string_agg(CAST(zn AS VARCHAR), ',' ORDER BY rank) AS members
    FROM cum, qhat WHERE rank = 1 OR before < qhat - 1e-12 GROUP BY 1, 2""")
def raps_sets(spark, sf_dir):
    return sets(spark, sf_dir).withColumn("members", F.array_join(F.transform("members", lambda z: z.cast("string")), ","))


@query("coverage_report", "cum qhat", """
    SELECT count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(size), 6) AS mean_size,
           quantile_cont(size, 0.5) AS median_size, quantile_cont(size, 0.9) AS p90_size
    FROM (SELECT structure_id, type_id, CAST(count(*) AS DOUBLE) AS size, bool_or(zn = true_zn) AS hit
          FROM cum, qhat WHERE rank = 1 OR before < qhat - 1e-12 GROUP BY 1, 2) t""")
def coverage_report(spark, sf_dir):
    report = K.coverage_report(sets(spark, sf_dir), truth_of(probs3_view(spark, sf_dir)))
    return report.select("n", *[F.round(c, 6).alias(c) for c in ("coverage", "mean_size", "median_size", "p90_size")])


# four types per structure with fractions 0.1, 0.2, 0.3, 0.4; ten candidates each, the best 300 kept after every type
add_view("cand", "probs3", """
    SELECT structure_id, type_id, zn, ln(p + 1e-12) AS logp FROM (
        SELECT *, row_number() OVER (PARTITION BY structure_id, type_id ORDER BY ln(p + 1e-12) DESC, zn) AS rn FROM probs3) t WHERE rn <= 10""")
add_view("joint2", "cand", """
    SELECT a.structure_id, a.zn AS z0, b.zn AS z1, 0.0 - a.logp - b.logp AS cost
    FROM cand a JOIN cand b ON b.structure_id = a.structure_id AND b.type_id = 1 WHERE a.type_id = 0""")
add_view("joint3", "joint2 cand", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY cost, z0, z1, z2) AS rn FROM (
        SELECT j.structure_id, z0, z1, c.zn AS z2, j.cost - c.logp AS cost
        FROM joint2 j JOIN cand c ON c.structure_id = j.structure_id AND c.type_id = 2) t) r WHERE rn <= 300""")
add_view("joint", "joint3 cand", """
    SELECT structure_id, z0, z1, z2, z3, -cost AS s FROM (
        SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY cost, z0, z1, z2, z3) AS rn FROM (
            SELECT j.structure_id, z0, z1, z2, d.zn AS z3, j.cost - d.logp AS cost
            FROM joint3 j JOIN cand d ON d.structure_id = j.structure_id AND d.type_id = 3) t) r WHERE rn <= 300""")
# the same search over the types a structure has: the last one may have fewer than four, and nothing is left out for it
add_view("some_types", "cand", "SELECT structure_id, type_id, dense_rank() OVER (PARTITION BY structure_id ORDER BY type_id) AS place, zn, logp FROM cand")
add_view("some1", "some_types", "SELECT structure_id, [zn] AS zs, 0.0 - logp AS cost FROM some_types WHERE place = 1")
for _place in (2, 3, 4):
    add_view(f"some{_place}", f"some{_place - 1} some_types", f"""
        SELECT structure_id, zs, cost FROM (
            SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY cost, zs) AS rn FROM (
                SELECT a.structure_id, CASE WHEN c.zn IS NULL THEN a.zs ELSE list_append(a.zs, c.zn) END AS zs,
                       a.cost - coalesce(c.logp, 0) AS cost
                FROM some{_place - 1} a LEFT JOIN some_types c ON c.structure_id = a.structure_id AND c.place = {_place}) t) r
        WHERE rn <= 300""")
add_view("zsets", "joint", "SELECT DISTINCT z0, z1, z2, z3 FROM joint")
add_view("neutral", "zsets oxidation", """
    SELECT z0, z1, z2, z3, CASE WHEN min(abs(0.1 * o0.q + 0.2 * o1.q + 0.3 * o2.q + 0.4 * o3.q)) < 1e-9 THEN 0
                                ELSE min(abs(0.1 * o0.q + 0.2 * o1.q + 0.3 * o2.q + 0.4 * o3.q)) END AS imbalance
    FROM zsets JOIN oxidation o0 ON o0.zn = z0 JOIN oxidation o1 ON o1.zn = z1 JOIN oxidation o2 ON o2.zn = z2
         JOIN oxidation o3 ON o3.zn = z3 GROUP BY 1, 2, 3, 4""")
add_view("zpmi", "zsets pmi", """
    SELECT z0, z1, z2, z3, avg(pmi) AS pmi FROM (
        SELECT DISTINCT t.z0, t.z1, t.z2, t.z3, a.zn AS a, b.zn AS b
        FROM zsets t, UNNEST([t.z0, t.z1, t.z2, t.z3]) a(zn), UNNEST([t.z0, t.z1, t.z2, t.z3]) b(zn) WHERE a.zn < b.zn) d
    JOIN pmi ON pmi.z1 = d.a AND pmi.z2 = d.b GROUP BY 1, 2, 3, 4""".replace(
        "SELECT z0, z1, z2, z3, avg(pmi) AS pmi FROM", "SELECT d.z0, d.z1, d.z2, d.z3, avg(pmi.pmi) AS pmi FROM"))
add_view("scored", "joint neutral zpmi", """
    SELECT j.structure_id, j.z0, j.z1, j.z2, j.z3, j.s, 0.5 * coalesce(p.pmi, 0) - 1.5 * n.imbalance AS extra,
           j.s + 0.5 * coalesce(p.pmi, 0) - 1.5 * n.imbalance AS score
    FROM joint j JOIN neutral n ON n.z0 = j.z0 AND n.z1 = j.z1 AND n.z2 = j.z2 AND n.z3 = j.z3
         LEFT JOIN zpmi p ON p.z0 = j.z0 AND p.z1 = j.z1 AND p.z2 = j.z2 AND p.z3 = j.z3""")

_ZS = "CAST(z0 AS VARCHAR) || '-' || CAST(z1 AS VARCHAR) || '-' || CAST(z2 AS VARCHAR) || '-' || CAST(z3 AS VARCHAR)"


def joint_inputs(spark, sf_dir):
    logp = probs3_view(spark, sf_dir).withColumn("logp", P.log_of())
    fractions = logp.select("structure_id").distinct().withColumn("frac", F.array(*[F.lit(v) for v in (0.1, 0.2, 0.3, 0.4)]))
    return logp, fractions


def reranked(spark, sf_dir):
    logp, fractions = joint_inputs(spark, sf_dir)
    return J.beam_rerank(logp, fractions, pmi_table(spark, sf_dir))


def joined(zs):
    return F.array_join(F.transform(zs, lambda z: z.cast("string")), "-")


@query("beam_candidates", "some4", "SELECT structure_id, array_to_string(zs, '-') AS zs, round(-cost, 6) AS s FROM some4")
def beam_candidates(spark, sf_dir):
    found = J.beam_candidates(joint_inputs(spark, sf_dir)[0])
    return found.select("structure_id", joined("zs").alias("zs"), F.round("s", 6).alias("s"))


@query("neutrality", "joint neutral", f"""
    SELECT j.structure_id, {_ZS.replace('z', 'j.z')} AS zs, round(imbalance, 6) AS imbalance
    FROM joint j JOIN neutral n ON n.z0 = j.z0 AND n.z1 = j.z1 AND n.z2 = j.z2 AND n.z3 = j.z3""")
def neutrality(spark, sf_dir):
    logp, fractions = joint_inputs(spark, sf_dir)
    found = J.beam_candidates(logp).join(fractions, "structure_id")
    return found.select("structure_id", joined("zs").alias("zs"), F.round(J.neutrality(F.col("zs"), F.col("frac")), 6).alias("imbalance"))


@query("composition_score", "scored", f"SELECT structure_id, {_ZS} AS zs, round(extra, 6) AS extra FROM scored")
def composition_score(spark, sf_dir):
    logp, fractions = joint_inputs(spark, sf_dir)
    found = J.composition_score(J.beam_candidates(logp), fractions, pmi_table(spark, sf_dir))
    return found.select("structure_id", joined("zs").alias("zs"), F.round("extra", 6).alias("extra"))


@query("beam_rerank", "scored", f"SELECT structure_id, {_ZS} AS zs, round(score, 6) AS score FROM scored")
def beam_rerank(spark, sf_dir):
    return reranked(spark, sf_dir).select("structure_id", joined("zs").alias("zs"), F.round("score", 6).alias("score"))


_MARGINAL = """
    w AS (SELECT *, exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY structure_id) AS w
          FROM (SELECT *, max(v) OVER (PARTITION BY structure_id) AS mx FROM best) t),
    m AS (SELECT structure_id, CAST(0 AS INT) AS type_id, z0 AS zn, sum(w) AS w FROM w GROUP BY 1, 2, 3
          UNION ALL SELECT structure_id, 1, z1, sum(w) FROM w GROUP BY 1, 2, 3
          UNION ALL SELECT structure_id, 2, z2, sum(w) FROM w GROUP BY 1, 2, 3
          UNION ALL SELECT structure_id, 3, z3, sum(w) FROM w GROUP BY 1, 2, 3)
    SELECT s.structure_id, t.type_id, CAST(z.range AS INT) AS zn, round((coalesce(m.w, 0) + 1e-12) / (1 + 94e-12), 6) AS p
    FROM (SELECT DISTINCT structure_id FROM best) s, (SELECT CAST(range AS INT) AS type_id FROM range(0, 4)) t, range(1, 95) z
         LEFT JOIN m ON m.structure_id = s.structure_id AND m.type_id = t.type_id AND m.zn = z.range"""


@query("marginals", "scored", ", best AS (SELECT *, score AS v FROM scored)," + _MARGINAL)
def marginals(spark, sf_dir):
    return J.marginals(reranked(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query("rerank_external", "scored", """
    , best AS (SELECT *, score - 3.0 * ln(1 + ((z0 * 3 + z1 * 5 + z2 * 7 + z3 * 11) % 13) / 10.0) AS v FROM (
        SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY round(score, 9) DESC, z0, z1, z2, z3) AS rn FROM scored) t
        WHERE rn <= 12),""" + _MARGINAL)
def rerank_external(spark, sf_dir):
    found = reranked(spark, sf_dir)
    # a structure may have fewer than four types: those it lacks count nothing
    weighted = sum((F.coalesce(F.get("zs", F.lit(k)), F.lit(0)) * w for k, w in enumerate((3, 5, 7, 11))), F.lit(0))
    f = weighted % 13 / F.lit(10.0)
    external = found.select("structure_id", "zs", f.alias("f"))
    return J.rerank_external(found, external).withColumn("p", F.round("p", 6))


@query("feature_diff", "model_probs", """
    SELECT 'class_' || a.zn AS feature, round(max(abs(a.p - b.p)), 6) AS max_abs_diff, count(*) AS n, 0 AS n_unmatched,
           max(abs(a.p - b.p)) <= 0.5 AS passed
    FROM model_probs a JOIN model_probs b ON a.structure_id = b.structure_id AND a.type_id = b.type_id AND a.zn = b.zn
    WHERE a.model = 1 AND b.model = 2 GROUP BY a.zn""")
def feature_diff(spark, sf_dir):
    named = model_probs_view(spark, sf_dir).withColumn("feature", F.concat(F.lit("class_"), F.col("zn").cast("string")))
    diff = D.feature_diff(named.where("model = 1"), named.where("model = 2"), ITEM, "p", "feature", 0.5)
    return diff.withColumn("max_abs_diff", F.round("max_abs_diff", 6))
