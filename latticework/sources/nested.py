"""Nested JSON corpora, expanded site tables, array trees and in-memory rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..functions.ordered import row_index
from ..operators.gates import drop_virtual
from ..operators.geometry import relabel_types, wrap_positions
from ..session import staged
from .jsonscan import json_entries

SITE = "STRUCT<species: ARRAY<STRUCT<element: STRING, occu: DOUBLE>>, xyz: ARRAY<DOUBLE>>"
SITE_ROW = ("structure_id STRING, cell ARRAY<ARRAY<DOUBLE>>, "
            "sites ARRAY<STRUCT<symbol: STRING, x: DOUBLE, y: DOUBLE, z: DOUBLE, occupancy: DOUBLE>>")
FRAME = (f"STRUCT<mp_id: STRING, structure: STRUCT<charge: DOUBLE, lattice: STRUCT<matrix: ARRAY<ARRAY<DOUBLE>>>, "
         f"sites: ARRAY<{SITE}>>>")


def read_nested_json(spark: SparkSession, path: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, sites) of objects {material: {frame: {structure: ...}}}: one object of any size per file, or JSON lines.

    frames: structure_id, material_id, frame_key, frame_index (place in the material, in order of files and places in them),
    inner_id, charge, cell, pbc, n_atoms. sites: one row per site and species entry, ordered by pos. A null frame has
    null fields and no sites. A malformed file fails the query.
    """
    entries = json_entries(spark, path, recursive)
    parsed = entries.select("file", "block", "k", F.from_json("json", f"MAP<STRING, MAP<STRING, {FRAME}>>", {"mode": "FAILFAST"}).alias("m"))
    materials = parsed.select("file", "block", "k", F.explode("m").alias("material_id", "frames"))
    opened = materials.select("file", "block", "k", "material_id", F.posexplode("frames").alias("place", "frame_key", "f"))
    # parsed once: the count of frames, frames and sites all read this table
    opened = staged(opened.select(
        "file", "block", "k", "place", F.concat_ws("#", "material_id", "frame_key").alias("structure_id"), "material_id", "frame_key",
        F.col("f.mp_id").alias("inner_id"), F.col("f.structure.charge").alias("charge"),
        F.col("f.structure.lattice.matrix").alias("cell"), F.lit(True).alias("pbc"),
        F.size("f.structure.sites").cast("long").alias("n_atoms"), F.col("f.structure.sites").alias("_sites")), "frames")
    frames = row_index(opened.drop("_sites"), ["material_id"], ["file", "block", "k", "place"], "frame_index").select(
        "structure_id", "material_id", "frame_key", "frame_index", "inner_id", "charge", "cell", "pbc", "n_atoms")
    sites = (opened.select("structure_id", F.posexplode("_sites").alias("atom_id", "s"))
                   .select("structure_id", F.col("atom_id").cast("long").alias("atom_id"), F.col("s.xyz").alias("p"),
                           F.posexplode("s.species").alias("pos", "e"))
                   .select("structure_id", "atom_id", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")], "pos",
                           F.col("e.element").alias("symbol"), F.col("e.occu").alias("occupancy")))
    return frames, sites


def first_species(sites: DataFrame) -> DataFrame:
    """Atoms labelled by the first species of each site."""
    return sites.where("pos = 0").select("structure_id", "atom_id", F.col("symbol").alias("label"), "symbol", "x", "y", "z")


def frame_keys(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(structure_id, keys): which keys every frame carries, for completeness reports."""
    kind = "MAP<STRING, MAP<STRING, MAP<STRING, STRING>>>"
    parsed = json_entries(spark, path).select(F.from_json("json", kind, {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias("material_id", "frames")).select(
        "material_id", F.explode("frames").alias("frame_key", "f")).select(
        F.concat_ws("#", "material_id", "frame_key").alias("structure_id"), F.map_keys("f").alias("keys"))


def id_mismatches(frames: DataFrame, k: int = 10) -> DataFrame:
    """Up to k frames whose inner id contradicts their material."""
    return (frames.where(~F.col("inner_id").eqNullSafe(F.col("material_id")))
                  .select("material_id", "frame_key", "inner_id").orderBy("material_id", "frame_key").limit(k))


def read_sites(spark: SparkSession, path: str | list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(structures, sites) of expanded crystal tables: JSON rows (structure_id, cell, sites[symbol,x,y,z,occupancy]).

    A malformed row fails the query; `site_rejects` lists such rows.
    """
    rows = spark.read.schema(SITE_ROW).option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    if limit is not None:
        rows = rows.limit(limit)
    sites = rows.select("structure_id", F.posexplode("sites").alias("atom_id", "s")).select(
        "structure_id", F.col("atom_id").cast("long").alias("atom_id"), "s.*")
    structures = rows.select("structure_id", "cell", F.lit(True).alias("pbc"), F.size("sites").cast("long").alias("n_atoms"))
    return structures, sites


def site_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row) of the rows of site tables that cannot be parsed."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{SITE_ROW}, _row STRING", {"columnNameOfCorruptRecord": "_row"})
    return lines.select(F.col("_metadata.file_path").alias("file"), parsed.alias("r")).where(F.col("r._row").isNotNull()).select(
        "file", F.col("r._row").alias("row"))


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per array row of each .npy file."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            table = np.load(io.BytesIO(content), allow_pickle=False)
            table = table.reshape(len(table), -1).astype(float)
            for start in range(0, len(table), 256):
                part = table[start:start + 256]
                yield pd.DataFrame({"path": path, "row": np.arange(start, start + len(part)), "v": list(part)})


def read_array_tree(spark: SparkSession, root: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(structures, atoms) of array-tree systems: type_map.raw, type.raw, set.*/coord.npy and optional box.npy.

    Each array file is decoded where it is read and emits one row per frame; systems are put together by
    joins, so a system with many sets is never gathered. A mixed-type set holds its types per frame.
    """
    def arrays(name: str) -> DataFrame:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
                      .load(root).select("path", "content"))
        rows = files.mapInPandas(_decode, "path string, row long, v array<double>")
        return rows.select(F.regexp_extract("path", r"^(.*)/(set\.[^/]*)/[^/]*$", 1).alias("system_id"),
                           F.regexp_extract("path", r"/(set\.[^/]*)/[^/]*$", 1).alias("set"), "row", "v")

    def words(name: str) -> DataFrame:
        texts = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
                      .text(root, wholetext=True))
        return texts.select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("system_id"),
                            F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("w"))

    names = words("type_map.raw").withColumnRenamed("w", "names")
    fixed = words("type.raw").select("system_id", F.col("w").cast("array<int>").alias("types"))
    frame = ["system_id", "set", "row"]
    frames = arrays("coord.npy").withColumnRenamed("v", "coord")
    frames = frames.join(arrays("box.npy").withColumnRenamed("v", "box"), frame, "left")
    frames = frames.join(arrays("real_atom_types.npy").select(*frame, F.col("v").cast("array<int>").alias("mixed")), frame, "left")
    frames = frames.join(names, "system_id").join(fixed, "system_id")
    frames = frames.withColumn("types", F.coalesce("mixed", "types")).where(F.size("coord") == 3 * F.size("types"))
    sets = frames.groupBy("system_id", "set").agg(F.count(F.lit(1)).alias("c"))
    earlier = W.partitionBy("system_id").orderBy("set").rowsBetween(W.unboundedPreceding, -1)
    offsets = sets.select("system_id", "set", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    frames = frames.join(offsets, ["system_id", "set"]).withColumn("frame_id", F.col("offset") + F.col("row"))
    frames = frames.withColumn("structure_id", F.concat_ws("#", "system_id", F.col("frame_id").cast("string")))
    cell = F.when(F.size("box") == 9, F.array(*[F.slice("box", 3 * k + 1, 3) for k in range(3)]))
    boxed = frames.withColumn("_cell", cell)
    periodic = F.col("_cell").isNotNull() & (L.volume(F.col("_cell")) >= 1e-6)
    structures = boxed.select("structure_id", "system_id", "frame_id", F.when(periodic, F.col("_cell")).alias("cell"),
                              F.coalesce(periodic, F.lit(False)).alias("pbc"))
    atoms = frames.select("structure_id", "coord", "names", F.posexplode("types").alias("k", "t"))
    atoms = drop_virtual(atoms, "t").select(
        "structure_id", F.col("k").cast("long").alias("atom_id"), F.get("names", F.col("t")).alias("label"),
        *[F.get("coord", 3 * F.col("k") + i).alias(c) for i, c in enumerate("xyz")])
    sizes = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    structures = structures.join(sizes, "structure_id")
    return structures, relabel_types(wrap_positions(atoms, structures))


def from_rows(spark: SparkSession, positions, type_ids, cell=None, structure_id: str = "input") -> tuple[DataFrame, DataFrame]:
    """(structures, atoms) of one structure already in memory; labels may be ints or strings."""
    labels = [str(t) if isinstance(t, str) else int(t) for t in type_ids]
    kind = "string" if labels and isinstance(labels[0], str) else "long"
    rows = [(structure_id, i, t, *map(float, p)) for i, (t, p) in enumerate(zip(labels, positions))]
    atoms = spark.createDataFrame(rows, f"structure_id string, atom_id long, label {kind}, x double, y double, z double")
    box = None if cell is None else [[float(v) for v in row] for row in cell]
    structures = spark.createDataFrame([(structure_id, box, cell is not None, len(rows))],
                                       "structure_id string, cell array<array<double>>, pbc boolean, n_atoms long")
    return structures, relabel_types(atoms)
