"""The structure data source: no atoms for metadata, residues as those of atoms, files chosen before they are opened."""

import gzip

import pytest

from helixframe.operators import topology
from helixframe.sources import coordinates, tables
from helixframe.sources.structure_source import read_structures, without_atoms

HEAD = "data_x\n_entry.id X{n}\n_exptl.method 'X-RAY'\n"
TABLE = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in "group_PDB label_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z occupancy pdbx_PDB_model_num".split())
ROWS = "".join(f"ATOM {a} {alt} {r} {c} {i} {x} {i}.5 0.25 {o} {m}\n" for m in (1, 2) for c in "AB" for i, r in enumerate(("ALA", "GLY", "HOH", "SER")) for a in ("N", "CA", "CB") for alt, x, o in ((".", i, 1.0),) + ((("B", i + 9, 0.3),) if i == 1 else ()) if (r, a) != ("GLY", "CB"))
TAIL = "#\n_struct.title 'after the atoms'\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.cif").write_text(HEAD.format(n=1) + TABLE + ROWS + TAIL)
    with gzip.open(tmp_path / "sub" / "b.mmcif.gz", "wt") as f:
        f.write(HEAD.format(n=2) + TABLE + ROWS)
    (tmp_path / "broken.cif").write_text(HEAD.format(n=3) + TABLE + "ATOM CA . ALA A 1 oops 0 0 1.0 1\n")
    pdb = "HEADER    HYDROLASE                               01-FEB-99   1ABC\nTITLE     A TITLE\n"
    pdb += "".join(f"ATOM  {i:5d}  CA  ALA A{i:4d}    {i:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{0:6.2f}\n" for i in range(1, 9))
    (tmp_path / "c.pdb").write_text(pdb)
    (tmp_path / "notes.txt").write_text("no structure")
    (tmp_path / "bad.pdb.gz").write_bytes(b"no gzip")
    return tmp_path


def test_metadata_parses_no_atom(spark, folder):
    got = {r["source_path"].rpartition("/")[2]: r for r in read_structures(spark, str(folder)).collect()}
    assert sorted(got) == ["a.cif", "b.mmcif.gz", "bad.pdb.gz", "broken.cif", "c.pdb"]
    assert [got[n]["structure_id"] for n in ("a.cif", "b.mmcif.gz", "broken.cif", "c.pdb")] == ["x1", "x2", "x3", "1abc"]
    assert got["a.cif"]["title"] == "after the atoms" and got["a.cif"]["experimental_method"] == "X-RAY" and got["bad.pdb.gz"]["error"]
    assert sum(r["atoms_parsed"] or 0 for r in got.values()) == 0
    parsed = {r["source_path"]: r for r in coordinates.scan_structures(spark, str(folder)).filter("error is null").collect()}
    for r in parsed.values():
        for c in ("structure_id", "experimental_method", "resolution", "deposition_date", "release_date", "title"):
            assert r[c] == got[r["source_path"].rpartition("/")[2]][c]


def test_a_text_block_among_atoms_is_read():
    text = HEAD + TABLE + "ATOM CA .\n;A\n_struct.title no\n;\nA 1 0 0 0 1.0 1\n" + TAIL
    assert without_atoms(text)[0] == text and without_atoms(text)[1] > 0
    assert without_atoms(HEAD) == (HEAD, 0)
    assert without_atoms(HEAD + TABLE + ROWS) == (HEAD, 0) and without_atoms(HEAD + TABLE + ROWS + TAIL) == (HEAD + TAIL, 0)


@pytest.mark.parametrize("size", [1, 64 << 20])
def test_residues_and_atoms_equal_the_scan(spark, folder, size):
    atoms = coordinates.atoms_of(coordinates.scan_structures(spark, str(folder)))
    found = read_structures(spark, str(folder), "atoms", bytes_per_partition=size)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, (tuple(r) for r in atoms.select(found.columns).collect())))
    want = topology.residues(atoms)
    found = read_structures(spark, str(folder), "residues", bytes_per_partition=size)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(found.columns).collect()))
    assert found.rdd.getNumPartitions() == (5 if size == 1 else 1)


def test_filters_choose_files(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = read_structures(spark, str(folder), "metadata", bytes_per_partition=1).filter("file_format = 'pdb' and structure_id is not null")
        assert [r["structure_id"] for r in found.collect()] == ["1abc"] and found.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_unknown_tables_and_empty_folders(spark, folder):
    with pytest.raises(Exception, match="bonds"):
        read_structures(spark, str(folder), "bonds").collect()
    assert read_structures(spark, str(folder / "sub")).count() == 1
    (folder / "empty").mkdir()
    assert read_structures(spark, str(folder / "empty")).count() == 0


def test_schemes(monkeypatch):
    asked = []
    monkeypatch.setattr(tables, "pafs", type("Fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(asked.append)})}))
    for uri in ("s3a://b/k", "dbfs:/x/y", "hdfs://h/p", "/local/p", "file:///p"):
        tables.store_of(uri)
    assert asked == ["s3://b/k", "file:///dbfs/x/y", "hdfs://h/p", "file:///local/p", "file:///p"]
