"""Parameters of the steps."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    #: Lengths of domains that are mapped.
    min_length: int = 60
    max_length: int = 180
    #: Contacts: the greatest distance, the least separation in sequence, and the atoms that stand for a residue.
    contact_distance: float = 8.0
    min_separation: int = 4
    representative_atoms: tuple[str, ...] = ("CB", "CA")
    #: Residue names that count as amino acids besides the usual ones.
    more_residues: tuple[str, ...] = ()
    #: Domains of a fold from which it is common, or rare.
    common_from: int = 10
    rare_from: int = 3
    #: Downloads: tasks at once, the size above which a file is there, time limits, and files of the registry that suffice.
    download_workers: int = 4
    downloaded_above_bytes: int = 100
    registry_timeout_s: int = 300
    structure_timeout_s: int = 60
    registry_least_ok: int = 2
    #: Folder of the steps' tables.
    output: str = "data/processed"
