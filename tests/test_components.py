"""Amino acids by a dictionary of chemical components."""

import pytest

from helixframe.config import PipelineConfig
from helixframe.operators import topology
from helixframe.plans import steps
from helixframe.sources import components, coordinates

from test_fixtures import CIF

DICTIONARY = """data_ALA
#
_chem_comp.id                                    ALA
_chem_comp.name                                  "a 'PEPTIDE' in a name"
_chem_comp.type                                  "L-PEPTIDE LINKING"
loop_
_chem_comp_atom.comp_id
_chem_comp_atom.type
ALA C
data_zzz
_chem_comp.id zzz
_chem_comp.type 'D-peptide NH3 amino terminus'
data_HOH
_chem_comp.id HOH
_chem_comp.type NON-POLYMER
data_LIK
_chem_comp.id LIK
_chem_comp.type peptide-like
data_UNK
_chem_comp.id UNK
_chem_comp.type ?
data_list
loop_
_chem_comp.id
_chem_comp.type
GLX 'L-PEPTIDE LINKING'
DA "DNA LINKING"
BAL peptide
#
"""


@pytest.mark.parametrize("split", ["64m", "300b"])
def test_components(spark, tmp_path, split):
    (tmp_path / "components.cif").write_text(DICTIONARY)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = components.read_components(spark, str(tmp_path / "components.cif"))
        kinds = {r["name"]: r["kind"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert kinds == {"ALA": "L-PEPTIDE LINKING", "ZZZ": "D-PEPTIDE NH3 AMINO TERMINUS", "HOH": "NON-POLYMER", "LIK": "PEPTIDE-LIKE", "GLX": "L-PEPTIDE LINKING", "DA": "DNA LINKING", "BAL": "PEPTIDE"}
    assert sorted(r["resname"] for r in components.amino_acids(found).collect()) == ["ALA", "BAL", "GLX", "ZZZ"]


def test_steps_take_the_names(spark, tmp_path):
    (tmp_path / "components.cif").write_text(DICTIONARY)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "odd.cif").write_text(CIF + "ATOM CA . ZZZ A 1 ? 1.0 0.0 0.0 1.0 1\nATOM CA . BAL A 2 ? 1.0 0.0 0.0 1.0 1\nATOM CA . LIK A 3 ? 1.0 0.0 0.0 1.0 1\n")
    config = steps.with_components(spark, str(tmp_path / "components.cif"), PipelineConfig(more_residues=("MORE",)))
    assert config.more_residues == ("ALA", "BAL", "GLX", "MORE", "ZZZ")
    atoms = coordinates.atoms_of(coordinates.scan_structures(spark, str(tmp_path / "in"), config))
    known = components.amino_acids(components.read_components(spark, str(tmp_path / "components.cif")))
    for found in (topology.chain_stats(atoms, config), topology.chain_stats(atoms, known=known)):
        assert found.first()["residue_count"] == 2
    assert topology.residues(atoms, known=known).count() == 2
    assert topology.chain_stats(atoms, PipelineConfig(more_residues=("LIK",)), known).first()["residue_count"] == 3
