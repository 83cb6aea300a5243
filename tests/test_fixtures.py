"""Hand-made files in the formats that are read, and what must come of them."""

import gzip
import itertools
import random

import numpy as np
import pytest

from helixframe import __main__ as command
from helixframe.config import PipelineConfig
from helixframe.operators import occupancy, topology
from helixframe.operators.atlas import build_atlas
from helixframe.plans import steps
from helixframe.schemas import ATLAS, DOMAIN_MAPPING
from helixframe.sources import classifications as c
from helixframe.sources import coordinates, downloads, tables
from helixframe.streaming.ingest import ingest_new

TAB = "\t"


@pytest.fixture
def folder(tmp_path):
    hier = "cl=1,cf=2,sf=3,fa=4,dm=5,sp={},px=1"
    cla = [["d1aaaa_", "1AAA", "A:", "a.1.1.1", "1", hier.format(900)], ["d1bbba1", "1bbb", "A:-3-95", "b.2.1.1", "2", hier.format(901)], ["d1cccb_", "1ccc", "B:5-50,B:60-99", "c.3.1.2", "3", hier.format(902)], ["d1ddd_", "1ddd", "-", "a.1.1.1", "4", hier.format(999)], ["d1eeea_", "1eee", "A:10P-80", "d.4.1.1", "5", hier.format(903)], ["d1fffa_", "1fff", "A:", "a.1.1.1", "6"]]
    (tmp_path / "scope_cla.txt").write_text("# comment\n" + "\n".join(map(TAB.join, cla)) + "\n")
    des = [["900", "sp", "a.1.1.1", "-", "Escherichia coli"], ["901", "sp", "b.2.1.1", "-", "Human (Homo sapiens)"], ["902", "sp", "c.3.1.2", "-", "Pyrococcus furiosus"], ["903", "sp", "d.4.1.1", "-", "Human papillomavirus type 16"], ["904", "dm", "a.1.1.1", "-", "Some human protein"], ["905", "sp", "e.1.1.1", "-", ""]]
    (tmp_path / "scope_des.txt").write_text("\n".join(map(TAB.join, des)) + "\n")
    (tmp_path / "scope_astral_40.fa").write_text("junk\n>d1aaaa_ a.1.1.1 (A:)\n" + "a" * 40 + "\n" + "b" * 20 + " \n>d1bbba1 x\n" + "c" * 180 + "\n>d1cccb_\n" + "d" * 181 + "\n>d1ddd_ y\n" + "e" * 100 + "\n")
    (tmp_path / "cath_domain_list.txt").write_text('{"data":[{"domain_id":"1aaaA01","pdb_code":"1AAA","superfamily_id":"1.10.8.10","atom_length":"60"},{"domain_id":"1aaaA02","pdb_code":"1AAA","superfamily_id":"2.40.50.140"},{"domain_id":"","pdb_code":"1bbb","superfamily_id":"9.9.9.9"}]}')
    ecod = ["#free comment", TAB.join("#uid ecod_domain_id f_id pdb chain pdb_range architecture_name x_name t_name".split()), TAB.join(["1", "e1bbbA1", "2004.1.1.1", "1BBB", "A", "A:1-95", "arch", "x", "t"]), TAB.join(["2", "e1aaaA1", "11.1.1.1", "1aaa", "A", "A:1-60", "arch", "x", ""])]
    (tmp_path / "ecod_domains.txt").write_text("\n".join(ecod) + "\n")
    return str(tmp_path)


def test_domain_mapping(spark, folder):
    mapping, told = steps.map_domains(spark, folder)
    got = {r["domain_id"]: tuple(r)[1:] for r in mapping.collect()}
    assert got == {"d1aaaa_": ("1aaa", "A", None, None, 60, "bacteria", "a.1.1.1", "1.10.8.10", None), "d1bbba1": ("1bbb", "A", -3, 95, 180, "eukaryotes", "b.2.1.1", None, "2004.1.1.1"), "d1ddd_": ("1ddd", None, None, None, 100, None, "a.1.1.1", None, None)}
    counts = {(r["section"], r["key"]): r["value"] for r in told.collect()}
    read = {"scope domains": 5, "scope descriptions": 5, "sequences": 4, "cath domains": 2, "cath chains": 1, "ecod domains": 1, "ecod chains": 1}
    kept = {"without length": 1, "outside window": 1, "rows": 3, "with cath": 1, "with ecod": 1}
    kingdoms = {"bacteria": 1, "eukaryotes": 1, "unknown": 1}
    assert counts == {("read", k): v for k, v in read.items()} | {("mapping", k): v for k, v in kept.items()} | {("kingdoms", k): v for k, v in kingdoms.items()}
    scope = {r["sid"]: (r["chain_id"], r["residue_start"], r["residue_end"]) for r in c.read_scope_cla(spark, f"{folder}/scope_cla.txt").collect()}
    assert scope["d1cccb_"] == ("B", 5, 50) and scope["d1eeea_"] == ("A", None, None)
    path = f"{folder}/out"
    tables.write_csv(mapping, path)
    back = tables.read_csv(spark, path, DOMAIN_MAPPING)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, mapping.collect()))
    files = spark.createDataFrame([("file:/x/1aaa.cif.gz", 500), ("file:/x/1bbb.cif.gz", 50)], "path string, length long")
    assert [r["pdb_id"] for r in downloads.pending(mapping, files).collect()] == ["1bbb", "1ddd"]
    assert downloads.registry(spark).count() == 5


CIF = """data_1TST
_entry.id 1TST
_exptl.method 'X-RAY DIFFRACTION'
_refine.ls_d_res_high ?
_em_3d_reconstruction.resolution 3.2
_pdbx_database_status.recvd_initial_deposition_date 2000-12-01
loop_
_pdbx_audit_revision_history.ordinal
_pdbx_audit_revision_history.revision_date
1 2001-02-03
2 2010-01-01
_struct.title
;A title, with "quotes"
;
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.pdbx_PDB_model_num
"""
ATOMS = "".join(f"{g} {a} . {n} {ch} {s} ? {x} 0.0 0.0 1.0 {m}\n" for m in (1, 2) for g, a, n, ch, s, x in (("ATOM", "CA", "ALA", "A", 1, 1.0), ("ATOM", "CB", "ALA", "A", 1, 2.0), ("ATOM", "CA", "GLY", "A", 2, 3.0), ("HETATM", "CA", "MSE", "A", 3, 4.0), ("HETATM", "O", "HOH", "W", 1, 5.0)))


def _pdb(serial, name, res, chain, seq, icode, x):
    return f"ATOM  {serial:5d} {name:<4s} {res:3s} {chain}{seq:4d}{icode:1s}   {x:8.3f}{0.0:8.3f}{0.0:8.3f}{1.0:6.2f}{0.0:6.2f}"


def test_ingest(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "1tst.cif").write_text(CIF + ATOMS)
    pdb = "HEADER    HYDROLASE                               01-FEB-99   2PDB              \nTITLE     A TITLE\nEXPDTA    X-RAY DIFFRACTION\nREMARK   2 RESOLUTION.    1.90 ANGSTROMS.\n" + "\n".join([_pdb(1, " CA ", "ALA", "B", 52, " ", 1), _pdb(2, " CA ", "SER", "B", 52, "A", 2)]) + "\nEND\n"
    with gzip.open(root / "sub" / "x.ent.gz", "wt") as f:
        f.write(pdb)
    (root / "het.cif").write_text(CIF + "".join(x + "\n" for x in ATOMS.splitlines() if x.startswith("HETATM")))
    (root / "X.CIF.GZ").write_bytes(gzip.compress((CIF + ATOMS).encode()))
    (root / "cut.cif.gz").write_bytes(gzip.compress((CIF + ATOMS).encode())[:60])
    (root / "notes.txt").write_text("no")
    found = steps.parse(spark, str(root), str(tmp_path / "parsed"))
    s = {r["structure_id"]: r for r in found["structures"].collect()}
    t = s["1tst"]
    assert (t["experimental_method"], t["resolution"], t["deposition_date"], t["release_date"], t["title"]) == ("X-RAY DIFFRACTION", "3.2", "2000-12-01", "2001-02-03", 'A title, with "quotes"')
    assert (t["model_count"], t["protein_chain_count"], t["protein_residue_count"], t["protein_chain_ids"]) == (2, 1, 2, "A")
    assert (s["2pdb"]["resolution"], s["2pdb"]["deposition_date"], s["2pdb"]["protein_residue_count"]) == ("1.90", "1999-02-01", 2)
    chains = {r["structure_id"]: r for r in found["chains"].collect()}
    assert (chains["1tst"]["residue_count"], chains["1tst"]["min_resseq"], chains["1tst"]["max_resseq"]) == (2, 1, 2)
    failed = {r["source_path"].rsplit("/", 1)[1]: r["error"] for r in found["failures"].collect()}
    assert set(failed) == {"het.cif", "X.CIF.GZ", "cut.cif.gz"} and failed["het.cif"] == "No protein chains detected in first model."
    points = {(r["structure_id"], r["seq"]): r["x"] for r in topology.residues(found["atoms"]).collect()}
    assert points[("1tst", 1)] == 2.0 and points[("1tst", 2)] == 3.0
    top = steps.topologies(spark, found["atoms"], found["chains"]).collect()
    assert len(top) == 2 and all(r["contact_count"] == 0 and r["s_fraction"] is None for r in top)
    q = ingest_new(spark, str(root), str(tmp_path / "stream"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 5


def test_padded_lines(spark, tmp_path):
    hier = "cl=1,sp=1"
    cla = [["d1", "1AAA", " A:1-5 ", "a.1", "1", hier], ["d2", "1aaa", "A:1-99999999999", "a.1", "2", hier]]
    (tmp_path / "cla").write_text("\n".join(map(TAB.join, cla)) + "\n")
    found = {r["sid"]: (r["chain_id"], r["residue_start"], r["residue_end"]) for r in c.read_scope_cla(spark, str(tmp_path / "cla")).collect()}
    assert found == {"d1": ("A", 1, 5), "d2": ("A", 1, None)}
    for head in ("uid", "#uid", "# uid", "##  uid"):
        (tmp_path / "ecod").write_text(TAB.join([head, "f_id", "pdb", "chain"]) + "\n" + TAB.join(["1", "2004.1", "1BBB", "A"]) + "\n")
        (row,) = c.read_ecod(spark, str(tmp_path / "ecod")).collect()
        assert (row["structure_id"], row["chain_id"], row["ecod_id"], row["ecod_domain_id"]) == ("1bbb", "A", "2004.1", "")


def test_more_residues_and_local_paths(spark, tmp_path):
    (tmp_path / "odd.cif").write_text(CIF + "ATOM CA . ZZZ A 1 ? 1.0 0.0 0.0 1.0 1\n")
    usual = coordinates.scan_structures(spark, str(tmp_path)).first()
    more = coordinates.scan_structures(spark, str(tmp_path), PipelineConfig(more_residues=("ZZZ",))).first()
    assert usual["error"] and more["error"] is None and more["source_path"] == str(tmp_path / "odd.cif")
    assert coordinates.local_path("file:///a/b") == coordinates.local_path("file:/a/b") == "/a/b"
    assert coordinates.local_path("s3a://x/y") == "s3a://x/y"


def test_command_line(spark, folder, tmp_path, capsys):
    """All steps in order over small files, by their arguments; the registry and structures come from local addresses."""
    out = str(tmp_path / "tables")
    run = lambda *a: command.run(spark, [*a, "--tables", out])
    assert run("build-domain-mapping", "--classifications-dir", folder, "--min-length", "50").code == 0
    mapping = tables.read_csv(spark, f"{out}/domain_mapping.csv", DOMAIN_MAPPING)
    assert mapping.count() == 3
    (tmp_path / "in").mkdir()
    assert run("ingest-structures", "--input-dir", str(tmp_path / "in")).code == 1
    (tmp_path / "in" / "1aaa.cif").write_text(CIF.replace("1TST", "1AAA") + ATOMS)
    told = run("ingest-structures", "--input-dir", str(tmp_path / "in"))
    assert told.code == 0 and {r["key"]: r["value"] for r in told.report.collect()} == {"structures": 1, "chains": 1, "failures": 0}
    assert run("compute-topology", "--contact-distance", "9").report.first()["value"] == 1
    told = run("build-atlas-table")
    assert {r["key"]: r["value"] for r in told.report.collect()} == {"atlas rows": 1, "join failures": 2}
    assert run("summarise-occupancy", "--common-from", "1", "--rare-from", "1").code == 0
    assert [r["occupancy_tier"] for r in tables.read_csv(spark, f"{out}/domain_atlas_table.csv", ATLAS).collect()] == ["common"]
    with pytest.raises(SystemExit):
        command.main(["ingest-structures"])
    assert "--input-dir" in capsys.readouterr().err


def test_fetch_by_pieces_and_failures(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 200_000)
    plan = spark.createDataFrame([("one", f"file://{tmp_path}/a"), ("two", f"file://{tmp_path}/none"), ("three", "nonsense")], "name string, url string")
    found = {r["name"]: r for r in downloads.fetch(plan, str(tmp_path / "out"), 5, 2).collect()}
    assert found["one"]["ok"] and found["one"]["length"] == 200_000 and (tmp_path / "out" / "one").read_bytes() == b"x" * 200_000
    assert not found["two"]["ok"] and found["two"]["error"] and not found["three"]["ok"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one"]


def test_cif_quotes():
    items = coordinates.cif_items("data_x\n_a.b 'it''s'\n_a.c \"x y\" # note\nloop_\n_l.a\n_l.b\n1 'p q'\n2 ?\n_z.z .\n")
    assert items["_a.c"] == ["x y"] and items["_l.b"] == ["p q", "?"] and items["_z.z"] == ["."]


def test_contacts_and_relations(spark):
    at = {1: 0, 2: 100, 4: 200, 6: 108, 10: 5, 14: 204, 20: 300, 30: 305, 33: 309.5}
    kinds = "structure_id string, chain_id string, pos int, seq int, x float, y float, z float"
    points = spark.createDataFrame([("s", "A", i, k, float(x), 0.0, 0.0) for i, (k, x) in enumerate(at.items())], kinds)
    found = topology.contacts(points)
    assert sorted((r["lo"], r["hi"]) for r in found.collect()) == [(1, 10), (2, 6), (4, 14), (20, 30)]
    want = (4, 6, 3, 1, 2)
    for f in (topology.relation_counts, topology.relation_counts_sql):
        assert tuple(f(found).first())[2:] == want
    pairs = {(r["a_lo"], r["b_lo"]): r["relation"] for r in topology.contact_relations(found).collect()}
    assert pairs == {(1, 2): "parallel", (1, 4): "cross", (1, 20): "series", (2, 4): "cross", (2, 20): "series", (4, 20): "series"}


def test_contacts_across_cells(spark):
    r = np.random.default_rng(5)
    xyz = np.concatenate([r.uniform(-20, 20, (150, 3)), np.array([[8.0 * i, 0, 0] for i in range(-4, 5)])]).astype(np.float32)
    rows = [("s", "A", i, i, *map(float, p)) for i, p in enumerate(xyz)]
    points = spark.createDataFrame(rows, "structure_id string, chain_id string, pos int, seq int, x float, y float, z float")
    squares = ((xyz[:, None] - xyz[None]) ** 2).astype(np.float64).sum(2)
    want = [(i, j) for i in range(len(xyz)) for j in range(i + 4, len(xyz)) if squares[i, j] <= 64]
    found = [(x["lo"], x["hi"]) for x in topology.contacts(points).collect()]
    assert sorted(found) == want and len(want) > 50


def test_kernel_equals_definition():
    r = random.Random(3)

    def brute(c):
        out = [0, 0, 0]
        for (i, j), (k, l) in itertools.combinations(c, 2):
            if len({i, j, k, l}) == 4:
                out[0 if j < k or l < i else 1 if i < k < l < j or k < i < j < l else 2] += 1
        return tuple(out)

    for _ in range(200):
        c = [tuple(sorted(r.sample(range(r.choice([6, 30])), 2))) for _ in range(r.randrange(0, 25))]
        lo, hi = np.array([x for x, _ in c], int), np.array([y for _, y in c], int)
        assert topology.count_relations(lo, hi) == brute(c)
    c = [tuple(sorted(r.sample(range(800), 2))) for _ in range(1500)]
    lo, hi = np.array(c).T
    assert topology.count_relations(lo, hi) == brute(c) and min(brute(c)) > 0
    v = np.array([r.randrange(50) for _ in range(300)])
    assert topology.inversions(v) == sum(a > b for a, b in itertools.combinations(v.tolist(), 2)) and topology.inversions(v[:0]) == 0


def test_atlas_and_occupancy(spark, tmp_path):
    domain = lambda i, s, ch, scope: (i, s, ch, None, None, 60, "bacteria", scope, None, None)
    mapping = spark.createDataFrame([domain("d1", "1aaa", "A", "a.1.1.1"), domain("d2", "1bbb", "A", "b.1.1.1"), domain("d3", "1ddd", None, "b.1.1.1"), domain("d4", "1aaa", "a", "c.1")], DOMAIN_MAPPING)
    top = spark.createDataFrame([("1aaa", "A", 0.1, 0.2, 0.7, 1), ("1aaa", "A", 1 / 128, 0.5, None, 2)], "structure_id string, chain_id string, s_fraction double, p_fraction double, x_fraction double, pos int")
    atlas, failed = build_atlas(mapping, top)
    (row,) = atlas.collect()
    assert row["domain_id"] == "d1" and row["topology_representation"] == "S=0.007812;P=0.500000;X="
    assert sorted(r["domain_id"] for r in failed.collect()) == ["d2", "d3", "d4"]
    folds = ["a.1.1.1"] * 10 + ["b.1.1.1"] * 9 + ["c.1.1.1"] * 3 + ["a.2.1.1"] * 2 + [None]
    full = spark.createDataFrame([(f"d{i}", "s", "A", None, None, 60, None if i % 2 else "archaea", f, "x" if i < 5 else None, None, "", 0.5 if i == 0 else None, None, None, None) for i, f in enumerate(folds)], ATLAS)
    assert {r["scope_id"]: r["occupancy_tier"] for r in occupancy.fold_counts(full).collect()} == {"a.1.1.1": "common", "b.1.1.1": "rare", "c.1.1.1": "rare", "a.2.1.1": "ultra-rare"}
    assert [tuple(r) for r in occupancy.tier_counts(occupancy.fold_counts(full)).collect()] == [("common", 1), ("rare", 2), ("ultra-rare", 1)]
    tiers = occupancy.with_tiers(full)
    assert tiers.columns == full.columns and tiers.filter("scope_id is null and occupancy_tier is null").count() == 1
    report = {(r["section"], r["key"]): r["value"] for r in occupancy.report(full).collect()}
    assert report["class domains", "a"] == 12 and report["class folds", "a"] == 2 and report["coverage", "cath_id"] == 20.0
    assert report["fraction std", "ps_fraction"] is None and ("class domains", "d") not in report
    summary = occupancy.occupancy_summary(full)
    assert summary.first()["kingdoms"] == {"archaea": 5, "unknown": 5}
    tables.write_csv(summary, str(tmp_path / "s"))
    assert "{'archaea': 5, 'unknown': 5}" in "".join(p.read_text() for p in (tmp_path / "s").glob("part*"))
    tables.replace_table(tiers, str(tmp_path / "t"))
    tables.replace_table(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 25 and not tables.write_failures(failed.limit(0), str(tmp_path / "none"))
    assert PipelineConfig().max_length == 180
