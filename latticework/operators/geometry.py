"""Labels, cells, units and compositions of structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import R_MAX
from ..functions import lattice as L

XYZ = ["x", "y", "z"]


def diagonal(sides: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.array(*[F.array(*[sides[i] if i == j else zero for j in range(3)]) for i in range(3)])


def relabel_types(atoms: DataFrame) -> DataFrame:
    """Add type_id 0..T-1 in sort order of `label` (numbers numerically, strings lexically)."""
    kinds = atoms.select("structure_id", "label").distinct()
    order = W.partitionBy("structure_id").orderBy("label")
    ids = kinds.withColumn("type_id", (F.dense_rank().over(order) - 1).cast("int"))
    return atoms.drop("type_id").join(ids, ["structure_id", "label"])


def type_counts(atoms: DataFrame) -> DataFrame:
    """(structure_id, type_id, n): one small row per type, everything else is derived from it."""
    return atoms.groupBy("structure_id", "type_id").agg(F.count(F.lit(1)).alias("n"))


def type_fractions(atoms: DataFrame) -> DataFrame:
    share = F.col("n") / F.sum("n").over(W.partitionBy("structure_id"))
    return type_counts(atoms).withColumn("frac", share)


def empty_types(declared: DataFrame, atoms: DataFrame) -> DataFrame:
    """Declared (structure_id, label) pairs no atom uses; nothing can be inferred for them."""
    return declared.join(atoms.select("structure_id", "label").distinct(), ["structure_id", "label"], "left_anti")


def map_elements(atoms: DataFrame, elements: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Add the atomic number `zn`; unknown symbols become 0. The element table has 94 rows."""
    known = elements.select(F.col("symbol").alias(symbol), "zn")
    return (atoms.join(F.broadcast(known), symbol, "left")
                 .withColumn("zn", F.coalesce("zn", F.lit(0)).cast("int")))


def wrap_positions(atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """Unwrap by image flags, then wrap into the cell. Uses origin and ix/iy/iz where present."""
    keep = ["structure_id"]
    if "origin" in structures.columns:
        structures = structures.selectExpr("structure_id", "cell", "origin[0] AS ox", "origin[1] AS oy", "origin[2] AS oz")
        keep += ["ox", "oy", "oz"]
    others = [c for c in atoms.columns if c not in (*XYZ, "ix", "iy", "iz")]
    joined = atoms.join(L.expand_cells(structures, keep), "structure_id")
    point = [f"{c} - o{c}" if len(keep) > 1 else c for c in XYZ]
    if "ix" in atoms.columns:
        point = [f"{p} + coalesce(ix, 0) * a0{k} + coalesce(iy, 0) * a1{k} + coalesce(iz, 0) * a2{k}"
                 for k, p in enumerate(point)]
    cells = [f"{n}{r}{k}" for n in "av" for r in range(3) for k in range(3)]
    # a structure without a cell has null cell columns and keeps its raw coordinates
    step = joined.selectExpr(*others, *[f"{c} AS raw_{c}" for c in XYZ], *cells, *[f"{p} AS p{k}" for k, p in enumerate(point)])
    step = step.selectExpr("*", *[f"{L.fraction_sql(k, 'p0', 'p1', 'p2')} AS u{k}" for k in range(3)])
    step = step.selectExpr("*", *[f"{L.wrap_sql(f'u{k}')} AS f{k}" for k in range(3)])
    return step.selectExpr(*others, *[f"coalesce({L.cartesian_sql(k)}, raw_{c}) AS {c}" for k, c in enumerate(XYZ)])


def cell_geometry(structures: DataFrame, reach: float = R_MAX) -> DataFrame:
    """Volume, face-to-face heights h1..h3 and images needed per direction n1..n3."""
    high = L.heights(F.col("cell"))
    return (structures.withColumn("volume", L.volume(F.col("cell")))
                      .withColumns({f"h{k + 1}": h for k, h in enumerate(high)})
                      .withColumns({f"n{k + 1}": F.ceil(F.lit(reach) / F.col(f"h{k + 1}")).cast("int")
                                    for k in range(3)}))


def vacuum_box(atoms: DataFrame, structures: DataFrame, padding: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Give every non-periodic structure a periodic box of its extent + 10 A, atoms centred in it."""
    open_ids = structures.where(F.col("cell").isNull() | ~F.col("pbc")).select("structure_id")
    extent = (atoms.join(open_ids, "structure_id", "left_semi").groupBy("structure_id")
                   .agg(*[f(c).alias(f"_{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]))
    moved = atoms.join(extent.select("structure_id", *[f"_lo{c}" for c in XYZ]), "structure_id", "left")
    moved = moved.withColumns({c: F.col(c) - F.coalesce(F.col(f"_lo{c}") - padding / 2, F.lit(0.0)) for c in XYZ})
    spans = [F.col(f"_hi{c}") - F.col(f"_lo{c}") + padding for c in XYZ]
    boxes = extent.select("structure_id", diagonal(spans).alias("_box"))
    boxed = (structures.join(boxes, "structure_id", "left")
                       .withColumn("cell", F.coalesce("_box", "cell"))
                       .withColumn("pbc", F.col("pbc") | F.col("_box").isNotNull()).drop("_box"))
    return moved.drop(*[f"_lo{c}" for c in XYZ]), boxed


def rescale(atoms: DataFrame, structures: DataFrame, scales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multiply positions and cells by each structure's `scale`; structures without one are dropped."""
    factor = scales.select("structure_id", "scale")
    moved = atoms.join(factor, "structure_id").withColumns({c: F.col(c) * F.col("scale") for c in XYZ})
    cells = structures.join(factor, "structure_id").withColumn(
        "cell", F.transform("cell", lambda row: F.transform(row, lambda v: v * F.col("scale"))))
    return moved.drop("scale"), cells.drop("scale")


def majority_species(sites: DataFrame, site_key: list[str]) -> DataFrame:
    """One element per site: highest occupancy, the earlier entry on ties."""
    pick = F.max(F.struct(F.coalesce("occupancy", F.lit(0.0)), (-F.col("pos")).alias("p"), F.col("symbol")))
    return sites.groupBy(*site_key).agg(pick.alias("_best")).select(*site_key, F.col("_best.symbol").alias("symbol"))
