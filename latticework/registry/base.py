"""Registration of queries and the table views they share."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..elements import ELEMENTS, OXIDATION
from ..functions.ordered import hot_groups, joined_safely
from ..session import staged, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("structures", "corpus", "scores", "records", "files", "workflows")


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query under `name`; `views` lists the SQL views its oracle text uses."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark, structures=True), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return run

    return register


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


# SQL views of the driver tables: name -> (views it needs, text).
VIEWS: dict[str, tuple[str, str]] = {
    "elements": ("", "SELECT * FROM (VALUES " + _values(ELEMENTS) + ") t(zn, symbol, mass)"),
    "oxidation": ("", "SELECT * FROM (VALUES " + _values(
        (z, q) for z, qs in sorted(OXIDATION.items()) for q in qs) + ") t(zn, q)"),
    "grid94": ("", "SELECT CAST(range AS INT) AS zn FROM range(1, 95)"),
    # one atom per (part, order, line); the cell grows with the atom count, so density stays bounded
    "base": ("", """
        SELECT l_partkey AS structure_id, l_orderkey * 8 + l_linenumber AS atom_id, l_linenumber AS label,
               l_orderkey AS o, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c
        FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber"""),
    "dims": ("base", """
        SELECT structure_id, count(*) AS n_atoms,
               CAST(2000 * ceil(round(cbrt(count(*) / 64.0), 6)) AS BIGINT) AS edge
        FROM base GROUP BY structure_id"""),
    "atoms": ("base dims", """
        SELECT b.structure_id, b.atom_id, b.label, d.edge, d.n_atoms, b.c % d.edge AS xi,
               (b.structure_id * 7919 + b.o * 31 + b.c) % d.edge AS yi,
               (b.o * 104729 + b.label * 31 + b.structure_id * 17) % d.edge AS zi,
               CAST(dense_rank() OVER (PARTITION BY b.structure_id ORDER BY b.label) - 1 AS INT) AS type_id
        FROM base b JOIN dims d ON b.structure_id = d.structure_id"""),
    "counts": ("atoms", "SELECT structure_id, type_id, count(*) AS n FROM atoms GROUP BY structure_id, type_id"),
    "tgrid": ("counts dims", """
        SELECT a.structure_id, a.type_id AS type_a, b.type_id AS type_b, a.n AS n_a, b.n AS n_b,
               power(d.edge / 100.0, 3) AS volume
        FROM counts a JOIN counts b ON a.structure_id = b.structure_id
             JOIN dims d ON d.structure_id = a.structure_id"""),
    "pairs": ("atoms", """
        SELECT structure_id, i, j, type_a, type_b, d2, sqrt(d2) / 100.0 AS d
        FROM (SELECT a.structure_id, a.atom_id AS i, b.atom_id AS j, a.type_id AS type_a, b.type_id AS type_b,
                     pow(least(abs(a.xi - b.xi), a.edge - abs(a.xi - b.xi)), 2)
                     + pow(least(abs(a.yi - b.yi), a.edge - abs(a.yi - b.yi)), 2)
                     + pow(least(abs(a.zi - b.zi), a.edge - abs(a.zi - b.zi)), 2) AS d2
              FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_id <> b.atom_id) t
        WHERE d2 < 640000"""),
    "hist": ("pairs", """
        SELECT structure_id, type_a, type_b, CAST(floor(sqrt(d2) / 12.5) AS INT) AS bin, count(*) AS n
        FROM pairs GROUP BY 1, 2, 3, 4"""),
    "rdf": ("hist tgrid", """
        SELECT s.structure_id, s.type_a, s.type_b, s.bin,
               least(s.h / greatest(g.n_a * (g.n_b / g.volume) * (4.0 / 3.0 * pi()
                     * (pow((s.bin + 1) * 0.125, 3) - pow(s.bin * 0.125, 3))), 1e-12), 1e4) AS g
        FROM (SELECT h.structure_id, h.type_a, h.type_b, CAST(h.bin + k.o AS INT) AS bin, sum(h.n * k.w) AS h
              FROM hist h, (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w
                            FROM (SELECT range AS o FROM range(-4, 5)) q) k
              WHERE h.bin + k.o BETWEEN 0 AND 63 GROUP BY 1, 2, 3, 4) s
        JOIN tgrid g ON g.structure_id = s.structure_id AND g.type_a = s.type_a AND g.type_b = s.type_b"""),
    "minima": ("pairs", "SELECT structure_id, type_a, i, type_b, min(d) AS d FROM pairs GROUP BY 1, 2, 3, 4"),
    # every order is a set of element numbers (brand 1..25)
    "element_sets": ("", """
        SELECT DISTINCT l_orderkey AS set_id, CAST(substr(p_brand, 7) AS INT) AS zn
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "set_gid": ("element_sets elements", """
        SELECT set_id, count(*) AS n_elements,
               CAST('0x' || substr(md5(string_agg(symbol, ',' ORDER BY symbol)), 1, 12) AS BIGINT) AS gid
        FROM element_sets JOIN elements ON element_sets.zn = elements.zn GROUP BY set_id"""),
    # three models score ten classes by integer dot products with class sums of quantised embeddings
    "quantised": ("", """
        SELECT vec_id, label, CAST(d.i AS INT) AS dim, CAST(round(CAST(embedding[d.i] AS DOUBLE) * 1000) AS BIGINT) AS q
        FROM embeddings, (SELECT range AS i FROM range(1, 65)) d"""),
    "class_sums": ("quantised", """
        SELECT label AS class_label, dim, sum(q) AS cq, count(*) AS cn FROM quantised GROUP BY label, dim"""),
    "logits": ("quantised class_sums", """
        SELECT vec_id, label, class_label + 1 AS zn, m.model,
               CAST(sum(q * cq) AS DOUBLE) / max(cn) / 20000.0 AS logit
        FROM quantised JOIN class_sums ON quantised.dim = class_sums.dim,
             (VALUES (1, 1, 32), (2, 33, 64), (3, 1, 64)) m(model, lo, hi)
        WHERE quantised.dim BETWEEN m.lo AND m.hi GROUP BY vec_id, label, class_label, m.model"""),
    "model_probs": ("logits", """
        SELECT CAST(vec_id // 4 AS BIGINT) AS structure_id, CAST(vec_id % 4 AS INT) AS type_id, model, zn,
               label + 1 AS true_zn,
               exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY vec_id, model) AS p
        FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id, model) AS mx FROM logits) t"""),
    "probs3": ("model_probs", "SELECT structure_id, type_id, zn, true_zn, p FROM model_probs WHERE model = 3"),
}


def with_views(names: str, body: str) -> str:
    """Prefix `body` with the named views and everything they depend on."""
    done: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0].split():
            visit(need)
        if name not in done:
            done.append(name)

    for name in names.split():
        visit(name)
    if not done:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in done) + "\n" + body.strip()


def add_view(name: str, needs: str, text: str) -> None:
    VIEWS[name] = (needs, text)


# The same views as DataFrames.

def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("structure_id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("label"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))


def _edge(n_atoms) -> Column:
    return (F.ceil(F.round(F.cbrt(n_atoms / 64.0), 6)) * 2000).cast("long")


def _points() -> list[Column]:
    edge = F.col("edge")
    return [(F.col("c") % edge / 100.0).alias("x"),
            ((F.col("structure_id") * 7919 + F.col("o") * 31 + F.col("c")) % edge / 100.0).alias("y"),
            ((F.col("o") * 104729 + F.col("label") * 31 + F.col("structure_id") * 17) % edge / 100.0).alias("z")]


def _cubes(dims: DataFrame) -> DataFrame:
    side, zero = F.col("edge") / 100.0, F.lit(0.0)
    return dims.select(
        "structure_id", F.array(F.array(side, zero, zero), F.array(zero, side, zero), F.array(zero, zero, side))
        .alias("cell"), F.lit(True).alias("pbc"), "n_atoms", "n_types")


def _view(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = lines.groupBy("structure_id", "o", "label").agg(F.min("c").alias("c")).withColumn("atom_id", F.col("o") * 8 + F.col("label"))
    dims = base.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.countDistinct("label").alias("n_types"),
                                            _edge(F.count(F.lit(1))).alias("edge"))
    atoms = base.join(dims.select("structure_id", "edge"), "structure_id", "left").select(
        "structure_id", "atom_id", "label", *_points())
    return atoms, _cubes(dims)


def atoms_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(atoms, structures) in Angstrom from lineitem: one structure per part."""
    return _view(_lines(spark, sf_dir))


# Lines of whole structures that one task ranks: its sorts stay in memory, however many lines there are.
TASK_LINES = 200_000


def _gathered(lines: DataFrame, count: int) -> DataFrame:
    """Typed atoms with their structure's `edge`, `n_atoms`, `n_types` and a flag on its first atom, from one shuffle.

    Lines meet by structure, so counts, ranks and duplicates need no further shuffle; for structures that fit one task.
    `count` lines give the number of tasks: bytes as shuffled say too little, since they are compressed.
    """
    whole = W.partitionBy("structure_id")
    rank = F.dense_rank().over(whole.orderBy(F.asc_nulls_last("label"))) - 1
    base = (lines.where("structure_id IS NOT NULL").repartition(max(1, -(-count // TASK_LINES)), "structure_id")
                 .groupBy("structure_id", "o", "label").agg(F.min("c").alias("c")))
    sized = (base.withColumn("type_id", rank.cast("int")).withColumn("first", F.row_number().over(whole.orderBy(F.asc_nulls_last("label"))) == 1)
                 .withColumns({"n_atoms": F.count(F.lit(1)).over(whole),
                               "n_types": F.max(F.when(F.col("label").isNotNull(), F.col("type_id"))).over(whole).cast("long") + 1}))
    return sized.withColumn("edge", _edge(F.col("n_atoms"))).select(
        "structure_id", "label", (F.col("o") * 8 + F.col("label")).alias("atom_id"), *_points(), "type_id", "edge",
        "n_atoms", "n_types", "first")


_STAGED: dict[tuple[str, str, str], tuple[DataFrame, DataFrame]] = {}


def typed_atoms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The atoms view with type ids and its structures, written once per session and table version."""
    from ..operators.geometry import relabel_types

    version = table(spark, sf_dir, "lineitem").agg(
        F.max("_metadata.file_modification_time").alias("t"), F.count(F.lit(1)).alias("n")).first()
    slot = (spark.sparkContext.applicationId, sf_dir, f"{version.t}/{version.n}")
    if slot not in _STAGED:
        lines = _lines(spark, sf_dir)
        hot = hot_groups(lines, ["structure_id"])
        rest = lines if hot is None else joined_safely(lines, F.broadcast(hot.select("structure_id")), ["structure_id"], "left_anti")
        gathered = staged(_gathered(rest, version.n), "gathered")
        atoms = gathered.where("label IS NOT NULL").drop("edge", "n_atoms", "n_types", "first")
        structures = _cubes(gathered.where("first"))
        if hot is not None:
            large, boxes = _view(joined_safely(lines, F.broadcast(hot.select("structure_id")), ["structure_id"], "left_semi"))
            atoms = atoms.unionByName(staged(relabel_types(large), "atoms"))
            structures = structures.unionByName(boxes)
        _STAGED[slot] = (atoms, staged(structures, "structures"))
    return _STAGED[slot]


def element_sets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("zn"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (lines.join(brands, lines.l_partkey == brands.p_partkey)
                 .select(F.col("l_orderkey").alias("set_id"), "zn").distinct())


def model_probs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(structure_id, type_id, model, zn, true_zn, p) of three dot-product models over ten classes."""
    flat = (table(spark, sf_dir, "embeddings")
            .select("vec_id", "label", F.posexplode("embedding").alias("dim", "e"))
            .select("vec_id", "label", "dim", F.round(F.col("e").cast("double") * 1000).cast("long").alias("q")))
    sums = (flat.groupBy(F.col("label").alias("class_label"), "dim")
                .agg(F.sum("q").alias("cq"), F.count(F.lit(1)).alias("cn")))
    # class table: at most 94 classes x 64 dimensions
    dots = (flat.join(F.broadcast(sums), "dim").groupBy("vec_id", "label", "class_label")
                .agg(F.sum(F.when(F.col("dim") < 32, F.col("q") * F.col("cq")).otherwise(0)).alias("m1"),
                     F.sum(F.when(F.col("dim") >= 32, F.col("q") * F.col("cq")).otherwise(0)).alias("m2"),
                     F.max("cn").alias("cn")))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.alias("s")) for m, s in (
        (1, F.col("m1")), (2, F.col("m2")), (3, F.col("m1") + F.col("m2")))]))
    logits = dots.withColumn("_m", models).select(
        (F.floor(F.col("vec_id") / 4)).cast("long").alias("structure_id"), (F.col("vec_id") % 4).cast("int").alias("type_id"),
        F.col("_m.model").alias("model"), (F.col("class_label") + 1).cast("int").alias("zn"),
        (F.col("label") + 1).cast("int").alias("true_zn"),
        (F.col("_m.s").cast("double") / F.col("cn") / 20000.0).alias("logit"))
    from ..operators.scoring import softmax
    return softmax(logits, "logit", ["structure_id", "type_id", "model"]).drop("logit")


def probs3_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_probs_view(spark, sf_dir).where(F.col("model") == 3).drop("model")
