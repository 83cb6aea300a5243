"""``spark.read.format("structures")``: a data source over a folder of structure files.

Its ``table`` option names what is read, so that no more is parsed than that needs:

- ``metadata``: a row a file of what stands outside the coordinates. The atom table is passed over line by line; the column
  ``atoms_parsed`` tells how many atoms were parsed, which is none unless the table has text blocks that must be read.
- ``atoms``: the atoms of the files that can be parsed, in the columns of ``schemas.ATOMS``.
- ``residues``: (structure_id, source_path, file_format, chain_id, pos, seq, x, y, z), as ``topology.residues`` makes them of
  atoms: a residue's atoms stand in one file, so they are reduced where it is parsed, and neither shuffled nor sent.

Files are packed into partitions by size (``bytes_per_partition``). Filters on file_format and source_path choose files
before any is opened, where ``spark.sql.python.filterPushdown.enabled`` is set (option ``pushdown`` tells the reader). Paths are those of any store that
``tables.store_of`` opens.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..config import PipelineConfig
from ..operators.topology import AMINO_ACIDS
from ..schemas import ATOMS, names
from .coordinates import _META_FIELDS, local_path, metadata_of, parse_structure
from .tables import store_of

_KINDS = {"string": pa.string(), "int": pa.int32(), "float": pa.float32(), "long": pa.int64()}
METADATA = _META_FIELDS.replace("model_count int", "atoms_parsed int")
RESIDUES = "structure_id string, source_path string, file_format string, chain_id string, pos int, seq int, x float, y float, z float"
_TABLES = {"metadata": METADATA, "atoms": ATOMS, "residues": RESIDUES}
_FORMATS = ((re.compile(r"\.(cif|mmcif)(\.gz)?$", re.I), "mmcif"), (re.compile(r"\.(pdb|ent)(\.gz)?$", re.I), "pdb"))
_ROWS = 100_000


def without_atoms(text: str) -> tuple[str, int]:
    """A CIF text less the rows of its atom table, and how many of these had to be kept."""
    at = re.search(r"^loop_\s*\n(?:\s*_atom_site\.\S*\s*\n)+", text, re.M | re.I)
    if not at:
        return text, 0
    # the table ends where a line begins another item, loop or block
    end = re.compile(r"^(?:#|_|loop_|data_|save_)", re.M | re.I).search(text, at.end())
    rows = text[at.end() : end.start() if end else len(text)]
    if re.search(r"^;", rows, re.M):  # a text block may hold anything
        return text, rows.count("\n")
    return text[: at.start()] + (text[end.start() :] if end else ""), 0


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str]]

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(0)
        self.files = files


class StructureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "metadata")
        if self.table not in _TABLES:
            raise ValueError(f"no table {self.table}; there are {', '.join(_TABLES)}")
        self.root, self.size = options["path"], int(options.get("bytes_per_partition", 64 << 20))
        config = PipelineConfig()
        self.points = tuple(options["representative_atoms"].split(",")) if options.get("representative_atoms") else config.representative_atoms
        self.named = frozenset([*AMINO_ACIDS, *filter(None, options.get("more_residues", "").split(","))])
        self.chosen: list[tuple[str, str, object]] = []

    def wanted(self, path: str, kind: str) -> bool:
        tests = {"equal": lambda a, b: a == b, "in": lambda a, b: a in b, "starts": str.startswith, "ends": str.endswith, "contains": lambda a, b: b in a}
        return all(tests[how](path if column == "source_path" else kind, value) for column, how, value in self.chosen)

    def partitions(self) -> list[InputPartition]:
        store, root = store_of(self.root)
        prefix = self.root[: -len(root)] if self.root.endswith(root) and ":" in self.root.split("/")[0] else ""
        found = []
        for info in store.get_file_info(pafs.FileSelector(root, recursive=True)):
            kind = next((k for pattern, k in _FORMATS if pattern.search(info.base_name)), None)
            hidden = any(part.startswith((".", "_")) for part in info.path[len(root) :].split("/"))
            if info.type == pafs.FileType.File and kind and not hidden and self.wanted(local_path(prefix + info.path), kind):
                found.append((prefix + info.path, kind, info.size))
        out: list[list[tuple[str, str]]] = []
        held = self.size
        for path, kind, size in sorted(found, key=lambda f: f[0].split("/")):
            if held + size > self.size:
                out.append([])
                held = 0
            out[-1].append((path, kind))
            held += size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in _TABLES[self.table].split(", "))])
        rows: list[tuple] = []
        for path, kind in partition.files:
            store, inner = store_of(path)
            with store.open_input_stream(inner, compression=None) as f:
                raw = f.read()
            rows += getattr(self, f"_{self.table}")(local_path(path), kind, raw)
            if len(rows) >= _ROWS:
                yield self._batch(rows, schema)
                rows = []
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def _metadata(self, path: str, kind: str, raw: bytes) -> list[tuple]:
        try:
            text, kept = (gzip.decompress(raw) if path.endswith(".gz") else raw).decode("utf-8"), 0
            if kind == "mmcif":
                text, kept = without_atoms(text)
            meta = metadata_of(path, kind, text)
            cells = [meta[k] for k in ("method", "resolution", "deposition", "release", "title")]
            return [(meta["structure_id"], path, kind, *cells, kept, None)]
        except Exception as e:  # any file may be broken in any way
            return [(None, path, kind, *[None] * 6, str(e) or type(e).__name__)]

    def _parsed(self, path: str, raw: bytes) -> tuple[str, list[tuple]]:
        try:
            meta, atoms = parse_structure(path, raw, self.named)
            return meta["structure_id"], atoms
        except Exception:  # told by the ingest step's failures
            return "", []

    def _atoms(self, path: str, kind: str, raw: bytes) -> list[tuple]:
        sid, atoms = self._parsed(path, raw)
        return [(sid, path, kind, *a) for a in atoms]

    def _residues(self, path: str, kind: str, raw: bytes) -> list[tuple]:
        sid, atoms = self._parsed(path, raw)
        column = {n: i for i, n in enumerate(names(ATOMS)[3:])}
        cell = [column[c] for c in ("model_idx", "het_flag", "resname", "atom_name", "chain_id", "res_pos", "resseq", "x", "y", "z")]
        best: dict[tuple, tuple[int, tuple]] = {}
        for a in atoms:
            model, het, resname, atom, chain, pos, seq, x, y, z = (a[i] for i in cell)
            if model == 0 and het == " " and resname in self.named and atom in self.points:
                rank, key = self.points.index(atom), (chain, pos, seq)
                held = best.get(key)
                if held is None or rank < held[0] or (rank == held[0] and (x, y, z) > held[1]):
                    best[key] = rank, (x, y, z)
        return [(sid, path, kind, *key, *point) for key, (_, point) in best.items()]


class FilteredReader(StructureReader):
    """Spark refuses a reader that takes filters where its setting for that is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if type(f) in kinds and column in ("file_format", "source_path"):
                self.chosen.append((column, kinds[type(f)], f.value))
            else:
                yield f


class StructureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "metadata")]

    def reader(self, schema) -> DataSourceReader:
        kind = FilteredReader if self.options.get("pushdown") == "true" else StructureReader
        return kind(dict(self.options))


def read_structures(spark: SparkSession, root: str, table: str = "metadata", **options: object) -> DataFrame:
    """A table of the structure files below a folder."""
    spark.dataSource.register(StructureSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("structures").options(table=table, pushdown=pushed, **options).load(root)
