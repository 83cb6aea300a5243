"""Coordinate files: parsers in plain Python, and the scan that runs them over files."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.scalar import NO_CHAIN_ERROR, structure_format
from ..operators.topology import AMINO_ACIDS
from ..schemas import ATOMS, names

MISSING = (None, "?", ".")
_META = {
    "method": ["_exptl.method"],
    "resolution": ["_refine.ls_d_res_high", "_em_3d_reconstruction.resolution"],
    "release": ["_pdbx_audit_revision_history.revision_date"],
    "deposition": ["_pdbx_database_status.recvd_initial_deposition_date"],
    "title": ["_struct.title"],
    "id": ["_entry.id"],
}
_MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}


def cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """Tokens of a CIF file, and whether each was quoted."""
    token = re.compile(r"""'(.*?)'(?=\s|$)|"(.*?)"(?=\s|$)|(#.*)|(\S+)""")
    block: list[str] | None = None
    for line in text.splitlines():
        if block is not None:
            if line.startswith(";"):
                yield "\n".join(block), True
                block, line = None, line[1:]
            else:
                block.append(line)
                continue
        elif line.startswith(";"):
            block = [line[1:]]
            continue
        for m in token.finditer(line):
            if m[3] is not None:
                break
            if m[4] is not None:
                yield m[4], False
            else:
                yield (m[1] if m[1] is not None else m[2]), True
    if block is not None:
        raise ValueError("CIF text block without an end")


def cif_items(text: str) -> dict[str, list[str]]:
    """Values by item name, in lower case; those of loops by column."""
    out: dict[str, list[str]] = {}
    names: list[str] | None = None
    header, at, pending = False, 0, None
    for value, quoted in cif_tokens(text):
        low = value.lower()
        if not quoted and low == "loop_":
            names, header, at, pending = [], True, 0, None
        elif not quoted and value.startswith("_") and (header or pending is None):
            if header:
                names.append(low)
                out[low] = []
            else:
                names, pending = None, low
        elif not quoted and low.startswith(("data_", "save_")) and pending is None:
            names, header = None, False
        elif pending is not None:
            out[pending] = [value]
            pending = None
        elif names:
            header = False
            out[names[at % len(names)]].append(value)
            at += 1
        if not header and names is not None and pending is None and not names:
            names = None
    return out


def _cif_meta(items: dict[str, list[str]]) -> dict[str, str | None]:
    meta = {}
    for key, sources in _META.items():
        found = [v for s in sources for v in items.get(s, []) if v not in MISSING]
        if key == "method":
            meta[key] = ";".join(found) or None
        else:
            meta[key] = found[0] if found else None
    return meta


def parse_cif(text: str) -> tuple[dict[str, str | None], list[tuple]]:
    items = cif_items(text)
    meta = _cif_meta(items)
    column = lambda *names: next((items[f"_atom_site.{n}"] for n in names if f"_atom_site.{n}" in items), None)
    xs = column("cartn_x")
    if xs is None:
        return meta, []
    n = len(xs)
    take = lambda default, *names: column(*names) or [default] * n
    cols = [
        take("ATOM", "group_pdb"),
        take("?", "auth_asym_id", "label_asym_id"),
        take("?", "auth_seq_id", "label_seq_id"),
        take("?", "pdbx_pdb_ins_code"),
        take("?", "auth_comp_id", "label_comp_id"),
        take("?", "label_atom_id"),
        take(".", "label_alt_id"),
        take("1", "occupancy"),
        xs,
        take("0", "cartn_y"),
        take("0", "cartn_z"),
        take("1", "pdbx_pdb_model_num"),
    ]
    if any(len(c) != n for c in cols):
        raise ValueError("CIF atom table is cut short")
    rows = []
    for group, chain, seq, icode, name, atom, alt, occ, x, y, z, model in zip(*cols):
        shown = ["" if v in MISSING else v for v in (icode, alt)]
        share = float(occ) if occ not in MISSING else 1.0
        rows.append((model, chain, group == "HETATM", int(seq), shown[0], name, atom, shown[1], share, float(x), float(y), float(z)))
    return meta, rows


def _date(text: str) -> str | None:
    m = re.fullmatch(r"(\d\d)-([A-Z]{3})-(\d\d)", text.strip().upper())
    if not m or m[2] not in _MONTHS:
        return None
    year = int(m[3])
    return f"{1900 + year if year > 60 else 2000 + year}-{_MONTHS[m[2]]:02d}-{m[1]}"


def residue_number(cell: str) -> int:
    """The number in the four columns of a PDB file. Above 9999 it is hybrid-36: A000 to ZZZZ go on from 10000, then a000 to zzzz."""
    cell = cell.strip()
    if len(cell) == 4 and re.fullmatch(r"[A-Z][0-9A-Z]{3}", cell):
        return int(cell, 36) - 10 * 36**3 + 10_000
    if len(cell) == 4 and re.fullmatch(r"[a-z][0-9a-z]{3}", cell):
        return int(cell, 36) + 16 * 36**3 + 10_000
    return int(cell)


def parse_pdb(text: str) -> tuple[dict[str, str | None], list[tuple]]:
    meta: dict[str, str | None] = dict.fromkeys(("id", "method", "resolution", "release", "deposition", "title"))
    rows, model, title, method = [], "0", [], []
    for line in text.splitlines():
        kind = line[:6].strip()
        if kind in ("ATOM", "HETATM"):
            cell = lambda a, b, line=line: line[a:b].strip()
            place = [float(line[at : at + 8]) for at in (30, 38, 46)]
            share = float(line[54:60]) if cell(54, 60) else 1.0
            named = (cell(26, 27), cell(17, 20), cell(12, 16), cell(16, 17))
            rows.append((model, cell(21, 22), kind == "HETATM", residue_number(line[22:26]), *named, share, *place))
        elif kind == "MODEL":
            model = line[10:14].strip() or str(len(rows))
        elif kind == "HEADER":
            meta["id"], meta["deposition"] = line[62:66].strip() or None, _date(line[50:59])
        elif kind == "TITLE":
            title.append(line[10:80].strip())
        elif kind == "EXPDTA":
            method.append(line[10:80].strip())
        elif kind == "REVDAT":
            meta["release"] = _date(line[13:22]) or meta["release"]  # the last is the first release
        elif kind == "REMARK" and line[9:10] == "2" and meta["resolution"] is None and (m := re.search(r"RESOLUTION\.\s+([\d.]+)\s+ANGSTROM", line)):
            meta["resolution"] = m[1]
    meta["title"], meta["method"] = " ".join(title).strip().lower() or None, " ".join(method).strip().lower() or None
    return meta, rows


def _best_atoms(rows: list[tuple]) -> list[tuple]:
    """Of alternative locations of an atom, the one of the highest occupancy, the first among equals."""
    best: dict[tuple, int] = {}
    for i, r in enumerate(rows):
        key = (r[0], r[1], r[2], r[3], r[4], r[6])
        if key not in best or r[8] > rows[best[key]][8]:
            best[key] = i
    return [rows[i] for i in sorted(best.values())]


def _structure_id(path: str, own: str | None) -> str:
    plain = PurePosixPath(path).name.removesuffix(".gz")
    stem = plain[: plain.rfind(".")] if plain.rfind(".") > 0 else plain
    return (own or stem).lower()


def metadata_of(path: str, kind: str, text: str) -> dict[str, str | None]:
    """What stands outside the coordinates; of a PDB file its other lines alone are read."""
    if kind == "mmcif":
        meta = _cif_meta(cif_items(text))
    else:
        meta, _ = parse_pdb("\n".join(x for x in text.splitlines() if not x.startswith(("ATOM", "HETATM"))))
    meta["structure_id"] = _structure_id(path, meta.pop("id"))
    return meta


def parse_structure(path: str, raw: bytes, residues: frozenset[str] = frozenset(AMINO_ACIDS)) -> tuple[dict, list[tuple]]:
    """A row of metadata, and atom rows in the order of schemas.ATOMS after file_format. Gzip by the name's .gz, in lower
    case. Without any of ``residues`` in the first model the file is no protein's, which is an error."""
    name = PurePosixPath(path).name
    text = (gzip.decompress(raw) if name.endswith(".gz") else raw).decode("utf-8")
    is_cif = re.search(r"\.(cif|mmcif)(\.gz)?$", name.lower()) is not None
    meta, rows = (parse_cif if is_cif else parse_pdb)(text)
    meta["structure_id"] = _structure_id(path, meta.pop("id"))
    models: dict[str, int] = {}
    chains: dict[tuple, int] = {}
    places: dict[tuple, int] = {}
    out = []
    for model, chain, het, seq, icode, resname, atom, alt, occ, x, y, z in _best_atoms(rows):
        m = models.setdefault(model, len(models))
        c = chains.setdefault((m, chain), len(chains))
        flag = ("W" if resname in ("HOH", "WAT") else f"H_{resname}") if het else " "
        r = places.setdefault((m, chain, flag, seq, icode), len(places))
        out.append((m, chain, c, flag, seq, icode, resname, r, atom, alt, occ, x, y, z))
    meta["model_count"] = len(models)
    if not any(r[0] == 0 and r[3] == " " and r[6] in residues for r in out):
        raise ValueError(NO_CHAIN_ERROR)
    return meta, out


_KINDS = {"string": pa.string(), "int": pa.int32(), "float": pa.float32()}
_ATOM_FIELDS = [tuple(f.split()) for f in ATOMS.split(", ")][3:]
_ATOM = pa.struct([(name, _KINDS[kind]) for name, kind in _ATOM_FIELDS])
_META_FIELDS = (
    "structure_id string, source_path string, file_format string, experimental_method string, resolution string, "
    "deposition_date string, release_date string, title string, model_count int, error string"
)
_PARSED = _META_FIELDS + ", atoms array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in _ATOM_FIELDS) + ">>"
#: Atoms that a batch of parsed files holds at most, but for its last file.
_BATCH_ATOMS = 200_000


def _batch(rows: list[list], atoms: list[list[tuple]]) -> pa.RecordBatch:
    """Parsed files as columns; atoms are built by column, too."""
    ends = np.cumsum([0, *map(len, atoms)]).astype(np.int32)
    flat = list(zip(*[a for part in atoms for a in part])) or [()] * len(_ATOM_FIELDS)
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _ATOM)], fields=list(_ATOM))
    kinds = [_KINDS[f.split()[1]] for f in _META_FIELDS.split(", ")]
    cells = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    return pa.record_batch([*cells, pa.ListArray.from_arrays(pa.array(ends), structs)], [*names(_META_FIELDS), "atoms"])


def _parser(residues: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        atoms: list[list[tuple]] = []
        for batch in batches:
            for path, fmt, raw in zip(batch.column("path"), batch.column("format"), batch.column("content")):
                shown = local_path(path.as_py())
                try:
                    meta, found = parse_structure(shown, raw.as_py(), residues)
                    told = [meta[k] for k in ("method", "resolution", "deposition", "release", "title", "model_count")]
                    row = [meta["structure_id"], shown, fmt.as_py(), *told, None]
                except Exception as e:  # any file may be broken in any way; it is routed to the failures
                    row, found = [None, shown, fmt.as_py(), *[None] * 6, str(e) or type(e).__name__], []
                rows.append(row)
                atoms.append(found)
                if len(rows) == 256 or sum(map(len, atoms)) > _BATCH_ATOMS:
                    yield _batch(rows, atoms)
                    rows, atoms = [], []
        if rows:
            yield _batch(rows, atoms)

    return run


def local_path(path: str) -> str:
    """A local file's absolute path without its scheme; a path of any other store stays whole."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


def parse_files(files: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Each file (path, content, format) parsed once: metadata, error, and atoms."""
    return files.mapInArrow(_parser(frozenset([*AMINO_ACIDS, *config.more_residues])), _PARSED)


def scan_structures(spark: SparkSession, root: str, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.withColumn("format", structure_format(F.col("path"))).filter("format is not null")
    return parse_files(named.select("path", "format", "content"), config)


def atoms_of(parsed: DataFrame) -> DataFrame:
    whole = parsed.filter("error is null").select("structure_id", "source_path", "file_format", F.explode("atoms").alias("a"))
    return whole.select("structure_id", "source_path", "file_format", "a.*")
