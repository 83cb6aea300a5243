"""Incremental ingest against the batch steps, with replaced files and a batch that is run again."""

import os
import time

from helixframe.sources import coordinates
from helixframe.operators import manifests
from helixframe.streaming import ingest

ATOM = "ATOM CA . {name} {chain} {seq} ? 1.0 0.0 0.0 1.0 1\n"
HEAD = "data_x\n_entry.id {id}\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in "group_PDB label_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy pdbx_PDB_model_num".split())


def put(path, sid, chains, name="ALA"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(HEAD.format(id=sid) + "".join(ATOM.format(name=name, chain=c, seq=i) for c, n in chains.items() for i in range(n)))
    time.sleep(0.02)


def run(spark, tmp_path):
    ingest.ingest_versions(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()


def batch_of(spark, paths):
    """The manifests of some files, by the batch operators."""
    files = spark.read.format("binaryFile").load([str(p) for p in paths]).withColumn("format", coordinates.structure_format(coordinates.F.col("path")))
    parsed = coordinates.parse_files(files.select("path", "format", "content"))
    atoms = coordinates.atoms_of(parsed)
    return {"structures": manifests.structure_manifest(parsed, atoms), "chains": manifests.chain_manifest(atoms), "failures": manifests.ingest_failures(parsed)}


def same(spark, tmp_path, paths):
    for table, want in batch_of(spark, paths).items():
        got = ingest.versions(spark, str(tmp_path / "state"), table)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), table


def test_versions_follow_the_files(spark, tmp_path):
    d = tmp_path / "in"
    put(d / "a.cif", "1AAA", {"A": 3, "B": 2})
    put(d / "b.cif", "1BBB", {"A": 4})
    put(d / "c.cif", "1CCC", {"A": 1}, "HOH")  # no protein
    run(spark, tmp_path)
    same(spark, tmp_path, [d / "a.cif", d / "b.cif", d / "c.cif"])
    run(spark, tmp_path)  # nothing new
    same(spark, tmp_path, [d / "a.cif", d / "b.cif", d / "c.cif"])
    put(d / "new" / "a.cif", "1AAA", {"A": 9})
    put(d / "new" / "c.cif", "1CCC", {"A": 2})
    put(d / "d.pdb", "x", {})
    run(spark, tmp_path)
    same(spark, tmp_path, [d / "new" / "a.cif", d / "b.cif", d / "new" / "c.cif", d / "d.pdb"])
    put(d / "z" / "b.cif", "1BBB", {"A": 2}, "HOH")  # a version that fails
    old = d / "y" / "a.cif"  # one that comes late, but was changed before the present one
    put(old, "1AAA", {"A": 5})
    os.utime(old, (1, 1))
    run(spark, tmp_path)
    same(spark, tmp_path, [d / "new" / "a.cif", d / "z" / "b.cif", d / "new" / "c.cif", d / "d.pdb"])


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    d = tmp_path / "in"
    put(d / "a.cif", "1AAA", {"A": 3})
    run(spark, tmp_path)
    put(d / "b.cif", "1BBB", {"A": 4})
    run(spark, tmp_path)
    # as if the driver had been lost before the last batch was committed
    commits = tmp_path / "checkpoint" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink(missing_ok=True)
    run(spark, tmp_path)
    same(spark, tmp_path, [d / "a.cif", d / "b.cif"])
    assert spark.read.parquet(str(tmp_path / "state" / "files")).count() == 2
