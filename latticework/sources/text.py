"""Simulation text formats. Files are read line by line and split by byte range, so one huge trajectory is parsed by many
tasks: every split is summed up as what it does to the reader's section or place in a frame, and parsed from there."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.geometry import relabel_types, wrap_positions
from ..session import staged
from .blocks import by_unit, pieces, with_state

# Section headings of a simulation data file.
SECTIONS = ("Masses", "Atoms", "Velocities", "Bonds", "Angles", "Dihedrals", "Impropers", "Pair Coeffs",
            "PairIJ Coeffs", "Bond Coeffs", "Angle Coeffs", "Dihedral Coeffs", "Improper Coeffs", "Atom Type Labels")

# Fixed values per atom style: index of the type column, of x, and the column count without image flags.
STYLES = {"atomic": (1, 2, 5), "charge": (1, 3, 6), "molecular": (2, 3, 6), "full": (2, 4, 7)}


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, value, mark, heading): the section of every line; `mark` runs on from the state at the start of the block."""
    carry = None
    for new, rows in by_unit(batches):
        mark = rows.column("mark")
        own = mark.is_valid().to_numpy(zero_copy_only=False).copy()
        if new:
            carry = rows.column("entry")[0].as_py()
            own[0] &= rows.column("block")[0].as_py() > 0  # the title of a file is no heading
        last = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))
        filled = mark.take(pa.array(np.maximum(last, 0)))
        if last[0] < 0:
            filled = pc.if_else(pa.array(last < 0), pa.scalar(carry, pa.string()), filled)
        carry = filled[-1].as_py()
        yield pa.RecordBatch.from_arrays([rows.column("file"), rows.column("value"), filled, pa.array(own)],
                                         ["file", "value", "mark", "heading"])


def read_lammps(spark: SparkSession, path: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(structures, atoms, masses) of simulation data files, plain or gzipped; structure_id is the file path.

    A missing header, a wrong atom count or an unknown atom style fails the query.
    """
    lines = pieces(spark, path, recursive)
    raw = F.trim("value")
    heading = F.regexp_extract(raw, "^(" + "|".join(SECTIONS) + r")\b", 1)
    style = F.lower(F.trim(F.regexp_extract(raw, r"#\s*(.*)$", 1)))
    lines = lines.withColumn("mark", F.when(heading != "", F.concat_ws("|", heading, style)))
    # what a block does to the section: its last heading, if any
    found = F.max(F.when(F.col("mark").isNotNull(), F.struct("ord", "mark")))
    blocks = lines.groupBy("unit", "file", "block").agg(found.alias("l"), F.min("ord").alias("first"))
    title = (F.col("block") == 0) & (F.col("l.ord") == F.col("first"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    states = staged(blocks.withColumn("m", F.when(~title, F.col("l.mark"))).select(
        "unit", "file", "block", F.last("m", ignorenulls=True).over(before).alias("entry")), "blocks")
    tagged = with_state(lines.select("unit", "ord", "value", "mark"), states).mapInArrow(
        _sections, "file string, value string, mark string, heading boolean")
    # parsed once: structures, atoms and masses all read this table
    parts = F.split("mark", r"\|")
    tagged = staged(tagged.select("file", "value", F.trim(F.regexp_replace("value", r"#.*$", "")).alias("text"), F.when(
        F.col("mark").isNotNull(), F.struct(parts[0].alias("section"), F.nullif(parts[1], F.lit("")).alias("style"))).alias("tag"),
        F.col("heading").alias("marked")), "sections")
    body = tagged.where(~F.col("marked") & (F.col("text") != "")).withColumn("parts", F.split("text", r"\s+"))

    def header(ending: str, index: int):
        return F.max(F.when(F.col("text").endswith(ending), F.col("parts")[index].cast("double")))

    head = body.where(F.col("tag").isNull()).groupBy("file").agg(
        header("atoms", 0).cast("long").alias("n"), *[header(f"{a}lo {a}hi", k).alias(f"{a}{e}")
                                                      for a in "xyz" for k, e in ((0, "lo"), (1, "hi"))],
        *[F.coalesce(header("xy xz yz", k), F.lit(0.0)).alias(t) for k, t in enumerate(("xy", "xz", "yz"))])
    rows = body.where(F.col("tag.section") == "Atoms")
    n = F.size("parts")
    guessed = F.coalesce(F.col("tag.style"), F.when(n.isin(5, 8), "atomic").when(n.isin(6, 9), "charge").when(n.isin(7, 10), "full"))
    rows = rows.withColumn("_style", guessed)

    def by_style(pick):
        out = F.raise_error(F.concat(F.lit("cannot infer atom style: "), F.col("value"), F.lit(" in "), F.col("file")))
        for name, layout in STYLES.items():
            out = F.when(F.col("_style") == name, F.lit(layout[pick])).otherwise(out)
        return out.cast("int")

    rows = rows.withColumns({"_t": by_style(0), "_x": by_style(1), "_k": by_style(2)})
    flagged = (n == F.col("_k") + 3) & F.forall(F.slice("parts", F.col("_k") + 1, 3), lambda p: p.rlike(r"^[+-]?\d+$"))
    atoms = rows.select(
        F.col("file").alias("structure_id"), F.col("parts")[0].cast("long").alias("atom_id"),
        F.get("parts", F.col("_t")).cast("int").alias("label"),
        *[F.get("parts", F.col("_x") + k).cast("double").alias(c) for k, c in enumerate("xyz")],
        *[F.when(flagged, F.get("parts", F.col("_k") + k).cast("int")).otherwise(0).alias(c) for k, c in enumerate(("ix", "iy", "iz"))])
    found = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_found"))
    zero = F.lit(0.0)
    cell = F.array(F.array(F.col("xhi") - F.col("xlo"), zero, zero), F.array(F.col("xy"), F.col("yhi") - F.col("ylo"), zero),
                   F.array(F.col("xz"), F.col("yz"), F.col("zhi") - F.col("zlo")))
    problem = F.when(F.col("n").isNull() | F.col("xlo").isNull(), F.lit(": header not found")).when(
        F.col("n") != F.coalesce("n_found", F.lit(0)), F.lit(": wrong number of atoms"))
    files = tagged.select("file").distinct().join(head, "file", "left").join(found, "file", "left")
    # the check sits in `cell`, which every later step needs
    structures = files.select(
        F.col("file").alias("structure_id"), F.when(problem.isNull(), cell).otherwise(
            F.raise_error(F.concat("file", problem)).cast("array<array<double>>")).alias("cell"),
        F.array("xlo", "ylo", "zlo").alias("origin"), F.lit(True).alias("pbc"), F.col("n").alias("n_atoms"))
    masses = body.where((F.col("tag.section") == "Masses") & (n >= 2)).select(
        F.col("file").alias("structure_id"), F.col("parts")[0].cast("int").alias("label"), F.col("parts")[1].cast("double").alias("mass"))
    placed = relabel_types(wrap_positions(atoms, structures))
    return structures.drop("origin"), placed, masses


_COUNT = re.compile(r"\s*\d+\s*")
_PROPERTIES = re.compile(r'Properties="?([^\s"]+)')
_SHORT = "{}: wrong number of atoms in a frame"


def _layout(info: str | None) -> tuple[int, int]:
    """Columns where the species and the position start, by name:kind:count descriptions; -1 where absent."""
    found = _PROPERTIES.search(info or "")
    parts = (found.group(1) if found else "species:S:1:pos:R:3").split(":")
    at, places = 0, {}
    for name, width in zip(parts[::3], parts[2::3]):
        places.setdefault(name, at)
        at += int(width)
    return places.get("species", -1), places.get("pos", -1)


def _frame_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block of lines does to the place in a frame, as a function of the lines of an open frame left at its start.

    If the open frame ends inside the block, a count or a blank line stands behind it; `at` lists all lines that may be
    such a one, and `way` which of the few `ends` each leads to: lines left, frame start, count, and info if seen.
    """
    names = ["unit", "file", "block", "n_lines", "first", "at", "way", "ends"]
    end = pa.struct([("left", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("info", pa.string())])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(end)]
    key, first, lines, counts, infos = None, None, 0, [], {}

    def row() -> pa.RecordBatch:
        way: dict[int, int] = {}
        ends: dict[tuple, int] = {}
        for i, n in reversed(counts):  # a blank line has no count
            then = i + 1 if n is None else i + 2 + n
            if then < lines:
                if then in way:
                    way[i] = way[then]
            else:
                left = then - lines
                way[i] = ends.setdefault((left, i, n, infos.get(i)) if left else (0, None, None, None), len(ends))
        at = sorted(way)
        values = [*key, lines, first, at, [way[i] for i in at], [dict(zip(("left", "start", "n", "info"), e)) for e in ends]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    for new, rows in by_unit(batches):
        value = rows.column("value")
        if new:
            if key:
                yield row()
            key, first = tuple(rows.column(c)[0].as_py() for c in names[:3]), value[0].as_py()
            lines, counts, infos = 0, [], {}
        if counts and counts[-1][0] == lines - 1:
            infos[lines - 1] = value[0].as_py()
        for k in np.flatnonzero(rows.column("mark").to_numpy(zero_copy_only=False)).tolist():
            text = value[k].as_py().strip()
            counts.append((lines + k, int(text) if text else None))
            if text and k + 1 < rows.num_rows:
                infos[lines + k] = value[k + 1].as_py()
        lines += rows.num_rows
        if counts:
            numbers = dict(counts)
            infos = {i: v for i, v in infos.items() if numbers.get(i) is not None and i + 2 + numbers[i] >= lines}
    if key:
        yield row()


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the start of every block, from moves sorted by file and block."""
    names = ["unit", "file", "block", "left", "start", "n", "info"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    file, state, out = None, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["file"] != file:
                if state and state[0]:
                    raise ValueError(_SHORT.format(file))
                file, state = r["file"], (0, None, None, None)
            out.append((r["unit"], file, r["block"], *state))
            left, start, n, info = state
            if left and left == (n or 0) + 1:
                info = r["first"]
            if left >= r["n_lines"]:
                state = (left - r["n_lines"], start, n, info)
                continue
            k = bisect_left(r["at"], left)
            if k == len(r["at"]) or r["at"][k] != left:
                raise ValueError(_SHORT.format(file))
            e = r["ends"][r["way"][k]]
            state = (e["left"], None if e["start"] is None else r["block"] + e["start"] + 1, e["n"], e["info"])
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)
        out = []
    if state and state[0]:
        raise ValueError(_SHORT.format(file))


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, line, n, species, position, value): atom lines (line from 0) and info lines (line -1) of all frames."""
    names = ["file", "start", "line", "n", "species", "position", "value"]
    seen = left = start = n = 0
    layout = (-1, -1)
    for new, rows in by_unit(batches):
        value, size = rows.column("value"), rows.num_rows
        if new:
            block, seen = rows.column("block")[0].as_py(), 0
            left, start, n, info = (rows.column(c)[0].as_py() for c in ("left", "start_", "n_", "info"))
            layout = _layout(info)
        table = np.full((5, size), -2, np.int64)  # start, line, n, species, position
        k = 0
        while k < size:
            if not left:
                text = value[k].as_py()
                if text.strip():
                    if not _COUNT.fullmatch(text):
                        raise ValueError(_SHORT.format(rows.column("file")[0].as_py()))
                    n, start = int(text), block + seen + k + 1
                    left = n + 1
                k += 1
                continue
            take = 1 if left == n + 1 else min(left, size - k)
            if left == n + 1:
                layout = _layout(value[k].as_py())
            first = n - left
            table[:, k: k + take] = np.array([[start], [0], [n], [layout[0]], [layout[1]]])
            table[1, k: k + take] = np.arange(first, first + take)
            left -= take
            k += take
        seen += size
        keep = table[1] > -2
        kept = rows.filter(pa.array(keep))
        table = table[:, keep]
        yield pa.RecordBatch.from_arrays([kept.column("file"), *[pa.array(c) for c in table], kept.column("value")], names)


def read_extxyz(spark: SparkSession, path: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(structures, atoms) of extended-XYZ trajectories; every frame is one structure 'file#start'.

    structures also carries the raw info line, file and frame_start for profiling. The count of a frame decides where the
    next one begins; blank lines may stand between frames. A file where no count follows a frame, or whose last frame is
    short, fails the query.
    """
    lines = pieces(spark, path, recursive)
    moves = lines.select("unit", "file", "block", "value", F.col("value").rlike(r"^\s*\d*\s*$").alias("mark")).mapInArrow(
        _frame_moves, "unit long, file string, block long, n_lines long, first string, at array<long>, way array<int>, "
                      "ends array<struct<left: long, start: long, n: long, info: string>>")
    states = staged(moves.repartition("file").sortWithinPartitions("file", "block").mapInArrow(
        _chain_blocks, "unit long, file string, block long, left long, start long, n long, info string"), "blocks")
    rows = with_state(lines.select("unit", "ord", "value"), states.withColumnsRenamed({"start": "start_", "n": "n_"}))
    framed = staged(rows.mapInArrow(_frame_rows, "file string, start long, line long, n long, species long, position long, value string"),
                    "frames")
    sid = F.concat_ws("#", "file", F.col("start").cast("string")).alias("structure_id")
    heads = framed.where("line = -1").withColumn("info", F.col("value"))
    listed = F.nullif(F.trim(F.regexp_extract("info", r'[Ll]attice="([^"]*)"', 1)), F.lit(""))
    lattice = F.split(listed, r"\s+").cast("array<double>")
    flags = F.regexp_extract("info", r'pbc="([^"]*)"', 1)
    heads = heads.withColumn("_cell", lattice)
    cell = F.when(F.size("_cell") == 9, F.array(*[F.slice("_cell", 3 * k + 1, 3) for k in range(3)]))
    structures = heads.select("file", F.col("start").alias("frame_start"), sid, "info", F.col("n").alias("n_atoms"), cell.alias("cell"),
                              (cell.isNotNull() & ((flags == "") | ~F.contains(F.upper(flags), F.lit("F")))).alias("pbc"))
    rows = framed.where("line >= 0").withColumn("parts", F.split(F.trim("value"), r"\s+"))

    def column(place):
        return F.when(place >= 0, F.get("parts", place.cast("int")))

    atoms = rows.select(sid, F.col("line").alias("atom_id"), column(F.col("species")).alias("label"),
                        *[column(F.col("position") + k).cast("double").alias(c) for k, c in enumerate("xyz")])
    return structures, atoms


def read_poscar(spark: SparkSession, path: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(structures, atoms) of POSCAR files, one small structure per file; trailing blocks are ignored.

    A file with fewer atom lines than it declares fails the query.
    """
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("structure_id"), F.split("value", r"\r?\n").alias("l"))

    def numbers(index: int):
        return F.slice(F.split(F.trim(F.col("l")[index]), r"\s+"), 1, 3).cast("array<double>")

    selective = F.upper(F.substring(F.trim(F.col("l")[7]), 1, 1)) == "S"
    parsed = files.select(
        "structure_id", "l", F.trim(F.col("l")[1]).cast("double").alias("scale"),
        F.array(numbers(2), numbers(3), numbers(4)).alias("raw"), F.split(F.trim(F.col("l")[5]), r"\s+").alias("symbols"),
        F.split(F.trim(F.col("l")[6]), r"\s+").cast("array<int>").alias("counts"), F.when(selective, 9).otherwise(8).alias("first"))
    parsed = parsed.withColumn("_det", F.expr("""abs(raw[0][0] * (raw[1][1] * raw[2][2] - raw[1][2] * raw[2][1])
        - raw[0][1] * (raw[1][0] * raw[2][2] - raw[1][2] * raw[2][0]) + raw[0][2] * (raw[1][0] * raw[2][1] - raw[1][1] * raw[2][0]))"""))
    # a negative scale states the cell volume
    parsed = parsed.withColumn("_s", F.expr("if(scale < 0, cbrt(-scale / _det), scale)"))
    parsed = parsed.select(
        "structure_id", "l", "first", "_s", "symbols", F.expr("transform(raw, r -> transform(r, v -> v * _s))").alias("cell"),
        F.expr("transform(sequence(1, size(counts)), k -> aggregate(slice(counts, 1, k), 0, (a, c) -> a + c))").alias("upto"),
        F.upper(F.substring(F.trim(F.get("l", F.col("first") - 1)), 1, 1)).isin("C", "K").alias("cartesian"))
    parsed = parsed.withColumn("n_atoms", F.element_at("upto", -1).cast("long"))
    parsed = parsed.withColumn("n_atoms", F.when(F.size("l") >= F.col("first") + F.col("n_atoms"), F.col("n_atoms")).otherwise(
        F.raise_error(F.concat("structure_id", F.lit(": fewer atom lines than declared"))).cast("long")))
    rows = parsed.select("structure_id", "first", "_s", "symbols", "cell", "upto", "cartesian", "n_atoms",
                         F.posexplode(F.expr("slice(l, first + 1, CAST(n_atoms AS INT))")).alias("k", "text"))
    rows = rows.withColumn("p", F.slice(F.split(F.trim("text"), r"\s+"), 1, 3).cast("array<double>"))
    rows = rows.withColumn("p", F.when(F.exists("p", lambda v: v.isNull()) | (F.size("p") < 3), F.raise_error(
        F.concat("structure_id", F.lit(": not an atom line: "), "text")).cast("array<double>")).otherwise(F.col("p")))
    place = {c: f"if(cartesian, p[{i}] * _s, p[0] * cell[0][{i}] + p[1] * cell[1][{i}] + p[2] * cell[2][{i}])"
             for i, c in enumerate("xyz")}
    atoms = rows.select("structure_id", F.col("k").cast("long").alias("atom_id"),
                        F.expr("symbols[size(filter(upto, u -> u <= k))]").alias("label"),
                        *[F.expr(e).alias(c) for c, e in place.items()])
    return parsed.select("structure_id", "cell", F.lit(True).alias("pbc"), "n_atoms"), atoms
