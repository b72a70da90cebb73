"""Round trips through text formats: the atoms view is written as files, read back and compared."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import nested, text
from .base import add_view, query, table
from .base import typed_atoms as typed

# Frames that one JSON object of the checks may hold.
FRAMES_PER_FILE = 2_000_000

_ATOMS = "SELECT structure_id, {extra}label, round(xi / 100.0, 4) AS x, round(yi / 100.0, 4) AS y, round(zi / 100.0, 4) AS z FROM {view}"


add_view("bulk_atoms", "base", """
    SELECT l_suppkey AS structure_id, label, c % edge AS xi, (p * 7919 + o * 31 + c) % edge AS yi,
           (o * 104729 + label * 31 + p * 17) % edge AS zi
    FROM (SELECT l_suppkey, l_partkey AS p, l_orderkey AS o, l_linenumber AS label,
                 min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY 1, 2, 3, 4) b
    JOIN (SELECT l_suppkey AS s, CAST(6000 * ceil(round(cbrt(count(*) / 1000.0), 6)) AS BIGINT) AS edge
          FROM lineitem GROUP BY 1) d ON d.s = b.l_suppkey""")


def grouped_text(lines, path, one_file_each=True):
    """Write (structure_id, ord, value) lines in order, one folder per structure or many structures per file."""
    ordered = lines.repartition("structure_id").sortWithinPartitions("structure_id", "ord")
    if one_file_each:
        ordered.select("structure_id", "value").write.partitionBy("structure_id").text(path)
    else:
        ordered.select("value").write.text(path)
    return path


def supplier_atoms(spark, sf_dir):
    from .structures import bulk
    atoms, structures = bulk(spark, sf_dir)
    return atoms, structures


def number(column):
    return F.regexp_replace(F.format_number(column, 4), ",", "")


# every supplier is one data file; coordinates carry image flags and a shifted origin to exercise wrapping
@query("ingest_lammps", "bulk", """
    SELECT structure_id, count(*) AS n_atoms, min(n) AS declared, round(sum(xi) / 100.0, 3) AS sum_x, round(sum(yi) / 100.0, 3) AS sum_y,
           round(max(zi) / 100.0, 3) AS max_z FROM bulk GROUP BY structure_id""".replace("min(n) AS declared, ", ""))
def ingest_lammps(spark, sf_dir):
    back, _ = lammps_back(spark, sf_dir)
    return back.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.sum("x"), 3).alias("sum_x"),
                                            F.round(F.sum("y"), 3).alias("sum_y"), F.round(F.max("z"), 3).alias("max_z"))


# every atom with its label and the mass of its type, where the file states one
@query("ingest_lammps_atoms", "bulk_atoms", """
    SELECT structure_id, label, CASE label WHEN 1 THEN 15.9994 WHEN 2 THEN 6.94 END AS mass, round(xi / 100.0, 4) AS x,
           round(yi / 100.0, 4) AS y, round(zi / 100.0, 4) AS z FROM bulk_atoms""")
def ingest_lammps_atoms(spark, sf_dir):
    back, masses = lammps_back(spark, sf_dir)
    return back.join(masses, ["structure_id", "label"], "left").select(
        "structure_id", F.col("label").cast("long").alias("label"), "mass", *[F.round(c, 4).alias(c) for c in "xyz"])


def lammps_back(spark, sf_dir):
    """(atoms, masses) of the data files written and read."""
    atoms, structures = supplier_atoms(spark, sf_dir)
    edge = structures.select("structure_id", "n_atoms", F.col("cell")[0][0].alias("edge"))
    span = F.concat(number(F.lit(-1.5)), F.lit(" "), number(F.col("edge") - 1.5))
    head = edge.select("structure_id", F.posexplode(F.array(
        F.lit("generated"), F.lit(""), F.concat(F.col("n_atoms").cast("string"), F.lit(" atoms")), F.lit("7 atom types"),
        F.concat(span, F.lit(" xlo xhi")), F.concat(span, F.lit(" ylo yhi")), F.concat(span, F.lit(" zlo zhi")), F.lit(""),
        F.lit("Masses"), F.lit(""), F.lit("1 15.9994 # o"), F.lit("2 6.94"), F.lit(""), F.lit("Atoms # charge"), F.lit(""))).alias("k", "value"))
    head = head.select("structure_id", (F.col("k") - 100).cast("double").alias("ord"), "value")
    # x - origin + images * edge must land on the original point
    body = atoms.join(edge.select("structure_id", "edge"), "structure_id").select(
        "structure_id", F.abs(F.col("atom_id")).cast("double").alias("ord"), F.concat_ws(
            " ", F.col("atom_id").cast("string"), F.col("label").cast("string"), F.lit("0.5"), number(F.col("x") - 1.5 - F.col("edge")),
            number(F.col("y") - 1.5), number(F.col("z") - 1.5), F.lit("1"), (F.col("label") % 2).cast("string"), F.lit("0")).alias("value"))
    path = grouped_text(head.unionByName(body), scratch_path(spark, "lammps"))
    _, back, masses = text.read_lammps(spark, path, recursive=True)
    sid = F.regexp_extract("structure_id", r"structure_id=(\d+)", 1).cast("long")
    edges = edge.select(F.col("structure_id").alias("k"), "edge")
    back = back.withColumn("structure_id", sid).join(edges, F.col("structure_id") == F.col("k"))
    back = back.withColumns({c: F.expr(f"round({c}, 4) % edge") for c in "xyz"})
    return back, masses.withColumn("structure_id", sid)


@query("ingest_extxyz", "atoms", _ATOMS.format(extra="'T' || atoms.label AS ", view="atoms"))
def ingest_extxyz(spark, sf_dir):
    atoms, structures = typed(spark, sf_dir)
    edge = number(F.col("cell")[0][0])
    head = structures.select("structure_id", F.posexplode(F.array(F.col("n_atoms").cast("string"), F.concat(
        F.lit('Lattice="'), edge, F.lit(" 0 0 0 "), edge, F.lit(" 0 0 0 "), edge, F.lit('" Properties=tag:I:1:species:S:1:pos:R:3 pbc="T T T" db_label=part_'),
        F.col("structure_id").cast("string")))).alias("k", "value"))
    head = head.select("structure_id", (F.col("k") - 10).cast("double").alias("ord"), "value")
    body = atoms.select("structure_id", F.col("atom_id").cast("double").alias("ord"), F.concat_ws(
        " ", F.lit("3"), F.concat(F.lit("T"), F.col("label")), number("x"), number("y"), number("z")).alias("value"))
    path = grouped_text(head.unionByName(body), scratch_path(spark, "extxyz"), one_file_each=False)
    frames, back = text.read_extxyz(spark, path)
    named = frames.select("structure_id", F.regexp_extract("info", r"db_label=part_(\d+)", 1).cast("long").alias("part"))
    return back.join(named, "structure_id").select(F.col("part").alias("structure_id"), "label",
                                                   *[F.round(c, 4).alias(c) for c in "xyz"])


@query("ingest_poscar", "bulk", """
    SELECT structure_id, 'E' || (xi % 3) AS label, count(*) AS n, round(sum(yi) / 100.0, 3) AS sum_y FROM bulk GROUP BY 1, 2""")
def ingest_poscar(spark, sf_dir):
    return poscar_back(spark, sf_dir).groupBy("structure_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("y", 4)), 3).alias("sum_y"))


@query("ingest_poscar_atoms", "bulk", """
    SELECT structure_id, 'E' || (xi % 3) AS label, round(xi / 100.0, 4) AS x, round(yi / 100.0, 4) AS y, round(zi / 100.0, 4) AS z FROM bulk""")
def ingest_poscar_atoms(spark, sf_dir):
    return poscar_back(spark, sf_dir).select("structure_id", "label", *[F.round(c, 4).alias(c) for c in "xyz"])


def poscar_back(spark, sf_dir):
    """Atoms of the POSCAR files written and read."""
    atoms, structures = supplier_atoms(spark, sf_dir)
    kind = F.round(F.col("x") * 100).cast("long") % 3
    atoms = atoms.withColumn("kind", kind)
    tally = atoms.groupBy("structure_id").agg(*[F.count_if(F.col("kind") == k).alias(f"c{k}") for k in range(3)])
    edge = number(F.col("cell")[0][0] / 2)
    zero = F.lit("0.0")
    head = structures.join(tally, "structure_id").select("structure_id", F.posexplode(F.array(
        F.lit("generated"), F.lit("2.0"), F.concat_ws(" ", edge, zero, zero), F.concat_ws(" ", zero, edge, zero),
        F.concat_ws(" ", zero, zero, edge), F.lit("E0 E1 E2"), F.concat_ws(" ", *[F.col(f"c{k}").cast("string") for k in range(3)]),
        F.lit("Direct"))).alias("k", "value"))
    head = head.select("structure_id", (F.col("k") - 10).cast("double").alias("ord"), "value")
    body = atoms.join(structures.select("structure_id", F.col("cell")[0][0].alias("edge")), "structure_id").select(
        "structure_id", F.col("kind").cast("double").alias("ord"),
        F.concat_ws(" ", *[F.format_string("%.9f", F.col(c) / F.col("edge")) for c in "xyz"]).alias("value"))
    path = grouped_text(head.unionByName(body), scratch_path(spark, "poscar"))
    _, back = text.read_poscar(spark, path, recursive=True)
    sid = F.regexp_extract("structure_id", r"structure_id=(\d+)", 1).cast("long")
    return back.withColumn("structure_id", sid)


@query("ingest_nested_json", "", """
    SELECT 'mp-' || user_id AS material_id, count(*) AS n_frames, CAST(sum(event_id % 5 + 1) AS BIGINT) AS n_sites,
           count(*) FILTER (WHERE event_type = 'error') AS n_mismatch, round(sum(value), 4) AS sum_x
    FROM (SELECT * FROM events) e GROUP BY user_id""")
def ingest_nested_json(spark, sf_dir):
    # one line per frame: the same material may appear on several lines
    lines = event_frames(spark, sf_dir).select(F.to_json(F.create_map("m", F.create_map("f", "v"))).alias("value"))
    path = scratch_path(spark, "nested")
    lines.write.text(path)
    found, sites = nested.read_nested_json(spark, path)
    points = sites.groupBy("structure_id").agg(F.count(F.lit(1)).alias("s"), F.sum("x").alias("x"))
    return found.join(points, "structure_id").groupBy("material_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum("s").alias("n_sites"),
        F.count_if(F.col("inner_id") != F.col("material_id")).alias("n_mismatch"), F.round(F.sum("x"), 4).alias("sum_x"))


# every file is one JSON object without a line break, its materials and frames in order
@query("ingest_json_object", "", """
    SELECT 'mp-' || user_id || '#f' || event_id AS structure_id, 'mp-' || user_id AS material_id, 'f' || event_id AS frame_key,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index,
           CASE WHEN event_type = 'error' THEN 'other' ELSE 'mp-' || user_id END AS inner_id, event_id % 5 + 1 AS n_atoms,
           value AS first_x, CAST(event_id % 5 AS DOUBLE) AS last_y
    FROM events""")
def ingest_json_object(spark, sf_dir):
    frames = event_frames(spark, sf_dir)
    part = F.pmod(F.xxhash64("m"), F.lit(1 + frames.count() // FRAMES_PER_FILE)).alias("part")
    frames = frames.select(part, "m", "at", F.concat(F.lit('"'), "f", F.lit('"')).alias("f"), F.to_json("v").alias("v"))
    inside, file = W.partitionBy("part", "m").orderBy("at"), W.partitionBy("part").orderBy("m", "at")
    first, last = F.lag("at").over(inside).isNull(), F.lead("at").over(inside).isNull()
    text = F.concat(F.when(F.lag("at").over(file).isNull(), "{").otherwise(","),
                    F.when(first, F.concat(F.lit('"'), "m", F.lit('":{'))).otherwise(""), "f", F.lit(":"), "v",
                    F.when(last, "}").otherwise(""), F.when(F.lead("at").over(file).isNull(), "}").otherwise(""))
    path = scratch_path(spark, "object")
    lines = frames.select("part", "m", "at", text.alias("value")).repartition("part").sortWithinPartitions("part", "m", "at")
    lines.select("part", "value").write.partitionBy("part").option("lineSep", " ").text(path)
    found, sites = nested.read_nested_json(spark, path, recursive=True)
    ends = sites.groupBy("structure_id").agg(F.min_by("x", "atom_id").alias("first_x"), F.max("y").alias("last_y"))
    return found.join(ends, "structure_id").select(
        "structure_id", "material_id", "frame_key", F.col("frame_index").cast("long").alias("frame_index"), "inner_id", "n_atoms",
        "first_x", "last_y")


def event_frames(spark, sf_dir):
    """Events as frames (m, f, at, v): material, frame key, order in the material, frame."""
    events = table(spark, sf_dir, "events")
    site = ("transform(sequence(0, CAST(event_id % 5 AS INT)), k -> named_struct('species', array(named_struct('element', "
            "if(k = 0, 'Li', 'O'), 'occu', 1D)), 'xyz', array(if(k = 0, value, 0D), CAST(k AS DOUBLE), 0D)))")
    return events.select(
        F.concat(F.lit("mp-"), F.col("user_id").cast("string")).alias("m"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("f"),
        F.col("event_id").alias("at"),
        F.expr("named_struct('mp_id', if(event_type = 'error', 'other', concat('mp-', CAST(user_id AS STRING))), 'structure', "
               "named_struct('charge', CAST(null AS DOUBLE), 'lattice', named_struct('matrix', array(array(9D,0D,0D), array(0D,9D,0D), array(0D,0D,9D))), "
               f"'sites', {site}))").alias("v"))


@query("ingest_sites", "", """
    SELECT CAST(l_orderkey AS VARCHAR) AS structure_id, count(*) AS n_atoms, round(sum(l_quantity), 4) AS sum_x,
           round(min(1 - l_discount), 4) AS min_occupancy FROM lineitem GROUP BY l_orderkey""")
def ingest_sites(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    site = F.struct(F.lit("O").alias("symbol"), F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
                    F.round(1 - F.col("l_discount"), 4).alias("occupancy"))
    rows = lines.groupBy(F.col("l_orderkey").cast("string").alias("structure_id")).agg(F.collect_list(site).alias("sites"))
    rows = rows.withColumn("cell", F.expr("array(array(9D,0D,0D), array(0D,9D,0D), array(0D,0D,9D))"))
    path = scratch_path(spark, "sites")
    rows.write.json(path)
    _, sites = nested.read_sites(spark, path)
    return sites.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.sum("x"), 4).alias("sum_x"),
                                             F.round(F.min("occupancy"), 4).alias("min_occupancy"))
