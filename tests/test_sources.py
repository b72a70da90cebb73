"""Readers on hand-written files, including splits, bad input and every layout variant."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import corpus as C
from latticework.operators import gates as Q
from latticework.operators import geometry as G
from latticework.sources import blocks, nested, store, text

HEADER = """made for a test

{n} atoms
2 atom types

-1.0 9.0 xlo xhi
0.0 12.0 ylo yhi
0.0 8.0 zlo zhi
2.0 0.0 1.0 xy xz yz

Masses

1 6.94 # Li
2 15.9994

"""


def by_id(atoms):
    return {r.atom_id: (r.label, r.type_id, round(r.x, 4), round(r.y, 4), round(r.z, 4)) for r in atoms.collect()}


@pytest.mark.parametrize("title,line", [
    ("Atoms", "{i} {t} {x} {y} {z}"), ("Atoms # charge", "{i} {t} 0.5 {x} {y} {z} 0 1 0"),
    ("Atoms  #full", "{i} 1 {t} 0.5 {x} {y} {z} # Li"), ("Atoms # molecular", "{i} 1 {t} {x} {y} {z}"),
    ("Atoms # atomic", "{i} {t} {x} {y} {z} 0 0 0")])
def test_data_file_styles(spark, tmp_path, title, line):
    rows = [(3, 2, 0.0, 1.0, 2.0), (1, 1, 3.0, 4.0, 5.0)]
    body = "\n".join(line.format(i=i, t=t, x=x, y=y, z=z) for i, t, x, y, z in rows)
    content = HEADER.format(n=2) + title + "\n\n" + body + "\n\nVelocities\n\n1 9 9 9\n3 9 9 9\n"
    (tmp_path / "a.data").write_text(content)
    with gzip.open(tmp_path / "b.data.gz", "wt") as out:
        out.write(content)
    structures, atoms, masses = text.read_lammps(spark, str(tmp_path))
    assert structures.count() == 2 and masses.count() == 4
    assert np.allclose(structures.first().cell, [[10, 0, 0], [2, 12, 0], [0, 1, 8]])
    for name in ("a.data", "b.data.gz"):
        got = by_id(atoms.where(F.col("structure_id").endswith(name)))
        assert got == {3: (2, 1, 1.0, 1.0, 2.0), 1: (1, 0, 4.0, 4.0, 5.0)}


def test_data_file_errors(spark, tmp_path):
    for name, content in {"few": HEADER.format(n=3) + "Atoms\n\n1 1 0 0 0\n", "none": "title\n\nAtoms\n\n1 1 0 0 0\n",
                          "odd": HEADER.format(n=1) + "Atoms\n\n1 1 0 0\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.data").write_text(content)
        with pytest.raises(Exception, match="wrong number|header not found|atom style"):
            text.read_lammps(spark, str(tmp_path / name))[1].collect()


def test_trajectory_split_over_many_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = [rng.random((int(n), 3)).round(4) for n in rng.integers(1, 12, 60)]
    with open(tmp_path / "t.xyz", "w") as out:
        for k, points in enumerate(frames):
            out.write(f'{len(points)}\nLattice="9 0 0 0 9 0 0 0 9" Properties=species:S:1:pos:R:3:forces:R:3 '
                      f'pbc="T T T" db_label=part_{k}\n')
            out.writelines(f"E{i % 3} {p[0]} {p[1]} {p[2]} 7 7 7\n" for i, p in enumerate(points))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        structures, atoms = text.read_extxyz(spark, str(tmp_path / "t.xyz"))
        assert blocks.pieces(spark, str(tmp_path / "t.xyz")).select("block").distinct().count() > 5
        labelled = {r.structure_id: r.number for r in C.parse_info(structures).collect()}
        got = {}
        for r in atoms.collect():
            got.setdefault(labelled[r.structure_id], {})[r.atom_id] = (r.label, r.x, r.y, r.z)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 60 and structures.where("pbc AND cell[0][0] = 9").count() == 60
    for k, points in enumerate(frames):
        assert got[k] == {i: (f"E{i % 3}", *p) for i, p in enumerate(points)}


def test_poscar_modes(spark, tmp_path):
    base = "t\n{s}\n2 0 0\n0 2 0\n0 0 4\nLi O\n1 2\n{mode}\n.5 .5 .25\n.25 0 0\n0 .25 .5\n\n9 9 9\n"
    (tmp_path / "a").write_text(base.format(s="2.0", mode="Direct"))
    (tmp_path / "b").write_text(base.format(s="-128.0", mode="Selective dynamics\nCartesian"))
    structures, atoms = text.read_poscar(spark, str(tmp_path))
    assert np.allclose([np.array(r.cell).diagonal() for r in structures.collect()], [[4, 4, 8]] * 2)
    got = {(r.structure_id[-1], r.atom_id): (r.label, r.x, r.y, r.z) for r in atoms.collect()}
    assert got["a", 0] == ("Li", 2, 2, 2) and got["a", 2] == ("O", 0, 1, 4)
    assert got["b", 0] == ("Li", 1, 1, .5) and got["b", 1] == ("O", .5, 0, 0) and len(got) == 6


def test_nested_json(spark, tmp_path):
    site = {"species": [{"element": "Fe", "occu": .4}, {"element": "Mn", "occu": .6}], "xyz": [1, 2, 3], "label": "Fe"}
    frame = {"mp_id": "mp-1", "energy": 1.0, "structure": {"charge": None, "lattice": {"matrix": np.eye(3).tolist()}, "sites": [site, site]}}
    (tmp_path / "c.json").write_text(json.dumps({"mp-1": {"f0": frame, "f1": frame}, "mp-2": {"f0": frame}}) + "\n")
    frames, sites = nested.read_nested_json(spark, str(tmp_path))
    assert frames.count() == 3 and [r.frame_index for r in frames.where("material_id = 'mp-1'").orderBy("frame_index").collect()] == [0, 1]
    assert [r.inner_id for r in nested.id_mismatches(frames).collect()] == ["mp-1"]
    assert nested.first_species(sites).select("label").distinct().first().label == "Fe"
    assert G.majority_species(sites, ["structure_id", "atom_id"]).select("symbol").distinct().first().symbol == "Mn"
    assert C.null_report(frames, "charge").first().nulls == 3
    keys = C.completeness(nested.frame_keys(spark, str(tmp_path)))
    assert {r.key: r.n_present for r in keys.collect()} == {"mp_id": 3, "energy": 3, "structure": 3}


def make_system(folder, types, sets, boxes=True, mixed=None):
    folder.mkdir(parents=True)
    (folder / "type_map.raw").write_text("O Li\n")
    (folder / "type.raw").write_text("\n".join(map(str, types)) + "\n")
    for k, coords in enumerate(sets):
        (folder / f"set.{k:03d}").mkdir()
        np.save(folder / f"set.{k:03d}" / "coord.npy", coords.reshape(len(coords), -1))
        if boxes:
            np.save(folder / f"set.{k:03d}" / "box.npy", np.tile(np.eye(3).ravel() * 10, (len(coords), 1)))
        if mixed is not None:
            np.save(folder / f"set.{k:03d}" / "real_atom_types.npy", np.tile(mixed, (len(coords), 1)))


def test_array_tree(spark, tmp_path):
    rng = np.random.default_rng(0)
    sets = [rng.random((2, 3, 3)) * 10, rng.random((3, 3, 3)) * 10 + 10]
    make_system(tmp_path / "plain", [0, 1, 1], sets)
    make_system(tmp_path / "open", [0, 1, 1], sets[:1], boxes=False)
    make_system(tmp_path / "deep" / "mixed", [0, 0, 0], sets[:1], mixed=[1, -1, 0])
    make_system(tmp_path / "broken", [0, 1], sets[:1])
    structures, atoms = nested.read_array_tree(spark, str(tmp_path))
    names = {r.structure_id: (r.system_id.rsplit("/", 1)[1], r.frame_id, r.pbc, r.n_atoms) for r in structures.collect()}
    assert sorted(names.values()) == sorted([("plain", i, True, 3) for i in range(5)] + [("open", i, False, 3) for i in range(2)]
                                            + [("mixed", i, True, 2) for i in range(2)])
    rows = {(*names[r.structure_id][:2], r.atom_id): r for r in atoms.collect()}
    assert np.allclose([rows["plain", 3, 1][c] for c in "xyz"], sets[1][1, 1] % 10)
    assert (rows["plain", 0, 0].label, rows["plain", 0, 0].type_id, rows["plain", 0, 1].label) == ("O", 1, "Li")
    assert rows["mixed", 0, 0].label == "Li" and ("mixed", 0, 1) not in rows


def test_site_table_gates(spark, tmp_path):
    def entry(sid, n, occupancy=1.0, symbol="O"):
        return {"structure_id": sid, "cell": (np.eye(3) * 20).tolist(), "sites": [
            {"symbol": symbol if i else "Li", "x": i, "y": 0, "z": 0, "occupancy": occupancy} for i in range(n)]}

    rows = [entry("ok", 4), entry("partial", 4, .94), entry("dummy", 4, 1.0, "X"), entry("single", 1), entry("huge", 2001)]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    structures, sites = nested.read_sites(spark, str(tmp_path))
    from latticework.elements import elements
    atoms = G.map_elements(Q.reject_disordered(sites), elements(spark)).withColumn("label", F.col("symbol"))
    gated = Q.quality_gate(Q.structure_stats(atoms, structures), Q.CRYSTALS)
    assert {r.structure_id: r.reason for r in gated.collect()} == {
        "ok": None, "dummy": "element_out_of_range", "single": "too_few_atoms", "huge": "too_many_atoms"}
    assert nested.read_sites(spark, str(tmp_path), limit=2)[0].count() == 2


def test_labels_sort_by_kind(spark):
    _, atoms = nested.from_rows(spark, np.zeros((3, 3)), ["10", "2", "x"])
    assert {r.label: r.type_id for r in atoms.collect()} == {"10": 0, "2": 1, "x": 2}
    _, atoms = nested.from_rows(spark, np.zeros((3, 3)), [10, 2, 7])
    assert {r.label: r.type_id for r in atoms.collect()} == {2: 0, 7: 1, 10: 2}


def test_feature_store(spark, tmp_path):
    records = spark.range(100).selectExpr("CAST(id AS STRING) AS structure_id", "if(id % 2 = 0, 'a', 'b') AS source",
                                          "CAST(id % 3 + 2 AS INT) AS n_types", "id AS gid", "array(array(id / 3D)) AS rdf")
    path = str(tmp_path / "store")
    store.write_features(records, path, records_per_file=10)
    val = store.read_features(spark, [path], "val", max_types=3)
    assert sorted(r.gid for r in val.collect()) == [g for g in range(0, 100, 10) if g % 3 < 2]
    assert dict(val.dtypes)["rdf"] == "array<array<float>>"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.read_features(spark, [str(tmp_path / "missing")])
    store.save_stats(records.limit(3), str(tmp_path / "stats"))
    assert store.load_stats(spark, str(tmp_path / "stats")).count() == 3


def _corpus(rng, n):
    """{material: {frame: structure}} with braces, quotes and escapes in strings, and odd entries."""
    out = {}
    for m in range(n):
        frames = {}
        for f in range(int(rng.integers(0, 6))):
            sites = [{"species": [{"element": "O", "occu": 1}], "xyz": [float(k), float(f), float(m)], "label": 'a}"{]'}
                     for k in range(int(rng.integers(1, 4)))]
            frames[f'f"{f}}}'] = {"mp_id": f"m{m}", "note": "}}{{\\" if f % 2 else 'end\\"}', "nested": {"a": {"b": {}}, "c": [{}, [1, {"d": 2}]]},
                                  "structure": {"charge": None, "lattice": {"matrix": [[1, 0, 0], [0, 2, 0], [0, 0, 3]]}, "sites": sites}}
        out[f"m{m}\\{{" if m % 3 == 0 else f"m{m}"] = frames
    return out


def _expected_frames(corpus):
    return sorted((m, f, k, v["mp_id"], len(v["structure"]["sites"])) for m, frames in corpus.items() for k, (f, v) in enumerate(frames.items()))


@pytest.mark.parametrize("layout", ["compact", "indented", "lines", "unended"])
@pytest.mark.parametrize("split", ["900", "100000000"])
def test_one_json_object_over_many_splits(spark, tmp_path, layout, split):
    corpus = _corpus(np.random.default_rng(5), 9)
    written = {"compact": json.dumps(corpus, separators=(",", ":")), "indented": json.dumps(corpus, indent=1) + "\n",
               "lines": "".join(json.dumps({m: {f: v}}) + "\n" for m, frames in corpus.items() for f, v in frames.items()),
               "unended": json.dumps(corpus) + " \n "}[layout]
    (tmp_path / "c.json").write_text(written)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        frames, sites = nested.read_nested_json(spark, str(tmp_path))
        got = sorted((r.material_id, r.frame_key, r.frame_index, r.inner_id, r.n_atoms) for r in frames.collect())
        assert got == _expected_frames(corpus)
        assert sites.count() == sum(r[-1] for r in got)
        assert nested.frame_keys(spark, str(tmp_path)).count() == len(got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_scans_join_blocks_by_shuffle_beyond_the_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BROADCAST_BLOCKS", 3)
    corpus = _corpus(np.random.default_rng(6), 8)
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    with gzip.open(tmp_path / "d.json.gz", "wt") as out:
        out.write(json.dumps({"z": {"f": None, "g": corpus["m1"].get('f"0}')}}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        frames, _ = nested.read_nested_json(spark, str(tmp_path))
        got = sorted((r.material_id, r.frame_key, r.frame_index, r.inner_id, r.n_atoms) for r in frames.where("material_id != 'z'").collect())
        assert got == _expected_frames(corpus)
        assert [r.frame_key for r in frames.where("material_id = 'z'").orderBy("frame_index").collect()] == ["f", "g"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("content", ['{"m": {"f": {"structure": {}}}', '{"m": {"f": {"structure": {}}}\n', '{"m": {"f": {"a": "x}}}', '{"m": {"f": {"a": oops}}}'])
def test_malformed_json_objects_fail(spark, tmp_path, content):
    (tmp_path / "c.json").write_text(content)
    with pytest.raises(Exception, match="not a complete JSON object|MALFORMED|malformed"):
        nested.read_nested_json(spark, str(tmp_path))[0].collect()


def test_empty_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.json").write_text('{"m": {}}\n\n')
    frames, sites = nested.read_nested_json(spark, str(tmp_path))
    assert frames.count() == 0 and sites.count() == 0


@pytest.mark.parametrize("split", ["60", "700", "100000000"])
def test_counts_decide_the_frames(spark, tmp_path, split):
    """Comments that are numbers, blank lines between frames, empty frames, other layouts, several files."""
    rng = np.random.default_rng(3)
    want = []
    for name in ("a.xyz", "b.xyz"):
        with open(tmp_path / name, "w") as out:
            for k in range(25):
                n = int(rng.integers(0, 6))
                info = ["7", "3", f'Properties=pos:R:3:tag:I:1:species:S:1 pbc="T F T" db_label=x_{k}', ""][k % 4]
                out.write(f" {n} \n{info}\n")
                points = rng.integers(0, 99, (n, 3)).tolist()
                out.writelines(f"{p[0]} {p[1]} {p[2]} 5 E{i}\n" if k % 4 == 2 else f"E{i} {p[0]} {p[1]} {p[2]}\n" for i, p in enumerate(points))
                out.write("\n" * (k % 3))
                want.append((name, k, info, n, [(i, f"E{i}", *map(float, p)) for i, p in enumerate(points)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        structures, atoms = text.read_extxyz(spark, str(tmp_path))
        rows = {}
        for r in atoms.collect():
            rows.setdefault(r.structure_id, []).append(tuple(r)[1:])
        got, place = [], {}
        for r in sorted(structures.collect(), key=lambda r: (r.file, r.frame_start)):
            name = r.file.rsplit("/", 1)[1]
            got.append((name, place.get(name, 0), r.info, r.n_atoms, sorted(rows.get(r.structure_id, []))))
            place[name] = place.get(name, 0) + 1
        assert got == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("content", ["2\nx\nH 0 0 0\n", "1\nx\nH 0 0 0\nH 1 1 1\n", "x\n1\n", "3\nx\nH 0 0 0\n1\ny\nO 0 0 0\n"])
def test_trajectories_with_wrong_counts_fail(spark, tmp_path, content):
    (tmp_path / "t.xyz").write_text(content)
    with pytest.raises(Exception, match="wrong number of atoms"):
        text.read_extxyz(spark, str(tmp_path / "t.xyz"))[1].collect()


def test_data_file_over_many_splits(spark, tmp_path):
    rows = [(i, 1 + i % 2, i * .001, .5, .25) for i in range(300)]
    body = "\n".join("{} {} {} {} {}".format(*r) for r in rows)
    for name in "ab":
        (tmp_path / f"{name}.data").write_text("Atoms of a title\n" + HEADER.format(n=300).split("\n", 1)[1] + f"Atoms # atomic\n\n{body}\n\nBonds\n\n1 9 9 9 9\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        structures, atoms, masses = text.read_lammps(spark, str(tmp_path))
        assert atoms.count() == 600 and masses.count() == 4 and structures.count() == 2
        assert {r.atom_id: round(r.x - -1.0 if r.x < 0 else r.x, 3) for r in atoms.where(F.col("structure_id").endswith("a.data")).collect()}.keys() == set(range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_malformed_site_rows_are_listed_and_fail(spark, tmp_path):
    good = json.dumps({"structure_id": "a", "cell": np.eye(3).tolist(), "sites": [{"symbol": "O", "x": 0, "y": 0, "z": 0, "occupancy": 1}]})
    (tmp_path / "s.json").write_text(good + '\n{"structure_id": "b", "cell": [[\n')
    assert [r.row for r in nested.site_rejects(spark, str(tmp_path)).collect()] == ['{"structure_id": "b", "cell": [[']
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        nested.read_sites(spark, str(tmp_path))[1].collect()


def test_nested_json_is_parsed_once(spark, tmp_path):
    site = '{"species":[{"element":"Li","occu":1}],"xyz":[0,1,2]}'
    (tmp_path / "a.json").write_text('{"m":{"f":{"mp_id":"m","structure":{"charge":null,"lattice":{"matrix":[]},"sites":[' + site + ']}},"g":null}}')
    frames, sites = nested.read_nested_json(spark, str(tmp_path))
    for df in (frames, sites):
        assert "from_json" not in df._jdf.queryExecution().analyzed().toString()
    assert [(r.structure_id, r.frame_index) for r in frames.orderBy("frame_index").collect()] == [("m#f", 0), ("m#g", 1)]
    assert [(r.structure_id, r.atom_id, r.z, r.symbol) for r in sites.collect()] == [("m#f", 0, 2.0, "Li")]
