"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations


def names(schema: str) -> list[str]:
    """The column names of a schema without nested fields."""
    return [f.split()[0] for f in schema.split(", ")]



DOMAIN_MAPPING = (
    "domain_id string, structure_id string, chain_id string, residue_start int, residue_end int, "
    "domain_length int, kingdom string, scope_id string, cath_id string, ecod_id string"
)
STRUCTURE_MANIFEST = (
    "structure_id string, source_path string, file_format string, experimental_method string, "
    "resolution string, deposition_date string, release_date string, title string, model_count int, "
    "protein_chain_count int, protein_residue_count int, protein_chain_ids string"
)
CHAIN_MANIFEST = (
    "structure_id string, chain_id string, source_path string, file_format string, residue_count int, "
    "resolved_residue_count int, min_resseq int, max_resseq int"
)
FAILURES = "source_path string, error string"
CHAIN_TOPOLOGY = (
    "structure_id string, chain_id string, source_path string, file_format string, "
    "eligible_residue_count int, contact_count int, contact_pair_count bigint, series_pair_count bigint, "
    "parallel_pair_count bigint, cross_pair_count bigint, s_fraction double, p_fraction double, "
    "x_fraction double"
)
ATLAS = DOMAIN_MAPPING + ", topology_representation string, ps_fraction double, pp_fraction double, x_fraction double, occupancy_tier string"
JOIN_FAILURES = "domain_id string, structure_id string, chain_id string, error string"
OCCUPANCY = "scope_id string, domain_count bigint, occupancy_tier string, kingdoms map<string,bigint>"
DOWNLOAD_FAILURES = "pdb_id string, error string"
REGISTRY = "url string, dest string, label string"
#: One row an atom; coordinates are single precision.
ATOMS = (
    "structure_id string, source_path string, file_format string, model_idx int, chain_id string, "
    "chain_pos int, het_flag string, resseq int, icode string, resname string, res_pos int, "
    "atom_name string, altloc string, occupancy float, x float, y float, z float"
)
