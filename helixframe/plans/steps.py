"""The steps, each from its inputs to its tables: what a command line runs.

A step reads and writes the tables of its inputs' and outputs' paths, and gives an exit code and a report, rows (section,
key, value). Tables are Parquet in versions (see ``sources.tables``), put out as CSV too where a path ends so; parsed
structures are kept beside the manifests, so that files are parsed once. What a report counts is counted by the write.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import manifests, occupancy, topology
from ..operators.atlas import build_atlas, route_atlas
from ..operators.relational import constants, distinct_sorted
from ..schemas import ATLAS, CHAIN_MANIFEST, CHAIN_TOPOLOGY, DOMAIN_MAPPING, FAILURES, JOIN_FAILURES, OCCUPANCY, STRUCTURE_MANIFEST, names
from ..sources import classifications as c
from ..sources import components, coordinates, downloads, tables


@dataclass(frozen=True)
class Step:
    code: int
    report: DataFrame


def _told(spark: SparkSession, section: str, **counts: float) -> DataFrame:
    return constants(spark, [(section, k.replace("_", " "), float(v)) for k, v in counts.items()], "section", "key", "value")


def download_classifications(spark: SparkSession, output_dir: str, sources: DataFrame | None = None, config: PipelineConfig = PipelineConfig()) -> Step:
    """Fetches the registry's files; a failure if fewer than ``registry_least_ok`` are there."""
    plan = downloads.registry(spark) if sources is None else sources
    # a row a source, of a fixed registry
    done = downloads.fetch_registry(plan, output_dir, config).collect()
    ok = sum(r["ok"] for r in done)
    return Step(0 if ok >= config.registry_least_ok else 1, _told(spark, "downloads", completed=ok, failed=len(done) - ok))


def build_domain_mapping(spark: SparkSession, classifications_dir: str, output: str, config: PipelineConfig = PipelineConfig()) -> Step:
    mapping, seen = watched_mapping(spark, classifications_dir, config)
    tables.put(mapping.select(names(DOMAIN_MAPPING)), output)
    return Step(0, _report(spark, seen))


def watched_mapping(spark: SparkSession, folder: str, config: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, tables.Watched]:
    """The mapping of the five classification files in a folder, and what is counted while it is made."""
    scope, species = c.read_scope_cla(spark, f"{folder}/scope_cla.txt"), c.read_scope_des(spark, f"{folder}/scope_des.txt")
    lengths = c.read_fasta_lengths(spark, f"{folder}/scope_astral_40.fa")
    cath, ecod = c.read_cath(spark, f"{folder}/cath_domain_list.txt"), c.read_ecod(spark, f"{folder}/ecod_domains.txt")
    return c.domain_mapping(scope, species, lengths, cath, ecod, config)


def _report(spark: SparkSession, seen: tables.Watched) -> DataFrame:
    """Kingdoms that no domain has are left out."""
    rows = [(s, k, int(v)) for s, k, v in seen.told() if v or s != "kingdoms"]
    return spark.createDataFrame(rows, "section string, key string, value long")


def map_domains(spark: SparkSession, folder: str, config: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, DataFrame]:
    """Mapping and report, the mapping written to the shared folder."""
    mapping, seen = watched_mapping(spark, folder, config)
    work = tables.fresh_dir(spark, "mapping")
    mapping.write.parquet(work)
    return spark.read.schema(mapping.schema).parquet(work), _report(spark, seen)


def with_components(spark: SparkSession, path: str, config: PipelineConfig = PipelineConfig()) -> PipelineConfig:
    """A configuration whose amino acids are also those of a dictionary of components, of some thousand names."""
    found = components.amino_acids(components.read_components(spark, path))
    return replace(config, more_residues=tuple(sorted({*config.more_residues, *(r["resname"] for r in found.collect())})))


def plan_downloads(spark: SparkSession, mapping: DataFrame, folder: str, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(pdb_id, url) of the mapping's structures that the folder lacks."""
    return downloads.pending(mapping, tables.structure_files(spark, folder).select("path", "length"), config)


def download_structures(spark: SparkSession, domain_mapping: str, output_dir: str, plan: DataFrame | None = None, config: PipelineConfig = PipelineConfig()) -> Step:
    """Fetches what is pending; failures go to a table, and are no failure of the step."""
    mapping = tables.get(spark, domain_mapping, DOMAIN_MAPPING)
    wanted = distinct_sorted(mapping, F.lower("structure_id").alias("pdb_id")).filter("pdb_id <> ''")
    tables.make_dir(spark, output_dir)
    todo = plan_downloads(spark, mapping, output_dir, config) if plan is None else plan
    work = tables.fresh_dir(spark, "downloads")
    downloads.fetch_structures(todo, output_dir, config).write.parquet(work)
    done = spark.read.parquet(work)
    needed, tried, ok = wanted.count(), done.count(), done.filter("ok").count()
    tables.write_failures(downloads.download_failures(done), f"{output_dir}/download_failures.csv")
    report = _told(spark, "structures", needed=needed, there_before=needed - tried, downloaded=needed - tried + ok, failures=tried - ok)
    return Step(0, report)


def parse(spark: SparkSession, root: str, parsed_path: str, config: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    """Parses each file once, into Parquet at ``parsed_path``, and gives the manifests, failures and atoms."""
    if tables.structure_files(spark, root).isEmpty():
        raise FileNotFoundError(f"no structure files below {root}")
    coordinates.scan_structures(spark, root, config).write.mode("overwrite").parquet(parsed_path)
    return parsed_tables(spark, parsed_path, config)


def parsed_tables(spark: SparkSession, parsed_path: str, config: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    parsed = spark.read.parquet(parsed_path)
    atoms = coordinates.atoms_of(parsed)
    return {
        "structures": manifests.structure_manifest(parsed, atoms, config),
        "chains": manifests.chain_manifest(atoms, config),
        "failures": manifests.ingest_failures(parsed),
        "atoms": atoms,
    }


def ingest_structures(
    spark: SparkSession,
    input_dir: str,
    structure_output: str,
    chain_output: str,
    failures_output: str,
    parsed_path: str,
    config: PipelineConfig = PipelineConfig(),
) -> Step:
    """A failure where there is no file to read; files that can't be parsed go to the failures, and the others on."""
    try:
        found = parse(spark, input_dir, parsed_path, config)
    except FileNotFoundError:
        return Step(1, _told(spark, "ingest", structures=0, chains=0, failures=0))
    order = F.split("source_path", "/")
    written = {
        "structures": tables.put(found["structures"].orderBy(order).select(names(STRUCTURE_MANIFEST)), structure_output),
        "chains": tables.put(found["chains"].select(names(CHAIN_MANIFEST)), chain_output),
        "failures": tables.put(found["failures"].orderBy(order).select(names(FAILURES)), failures_output),
    }
    counts = {k: v["rows"] for k, v in written.items()}
    return Step(0, _told(spark, "ingest", **counts))


def topologies(spark: SparkSession, atoms: DataFrame, chains: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """The topology table of a chain manifest. Residues are made once, and written to the shared folder."""
    work = tables.fresh_dir(spark, "residues")
    topology.residues(atoms, config).write.parquet(work)
    return topology.chain_topology(spark.read.parquet(work), chains, config)


def compute_topology(spark: SparkSession, chain_manifest: str, parsed_path: str, output: str, config: PipelineConfig = PipelineConfig()) -> Step:
    chains = tables.get(spark, chain_manifest, CHAIN_MANIFEST)
    out = topologies(spark, coordinates.atoms_of(spark.read.parquet(parsed_path)), chains, config)
    written = tables.put(out.orderBy("structure_id", "source_path", "chain_id").select(names(CHAIN_TOPOLOGY)), output)
    return Step(0, _told(spark, "topology", chains=written["rows"]))


def atlas(mapping: DataFrame, chains: DataFrame, config: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, DataFrame]:
    """The atlas with its tiers, and the join failures."""
    full, failed = build_atlas(mapping, chains)
    return occupancy.with_tiers(full, config=config), failed


def build_atlas_table(spark: SparkSession, chain_topology: str, domain_mapping: str, output: str, failures_output: str) -> Step:
    """The atlas without tiers, which the occupancy step fills in. Domains are joined once, and written once by their route."""
    chains, mapping = tables.get(spark, chain_topology, CHAIN_TOPOLOGY), tables.get(spark, domain_mapping, DOMAIN_MAPPING)
    columns = {"hit": names(ATLAS), "miss": names(JOIN_FAILURES)}
    found, counts = tables.routes(route_atlas(mapping, chains), "route", ["hit", "miss"], columns)
    tables.put(found["hit"], output)
    tables.put(found["miss"], failures_output)
    return Step(0, _told(spark, "atlas", atlas_rows=counts["hit"], join_failures=counts["miss"]))


def summarise_occupancy(spark: SparkSession, atlas_path: str, output: str, config: PipelineConfig = PipelineConfig()) -> Step:
    """The summary by fold; the atlas gets its tiers in a new version, made of the old one."""
    full = tables.get(spark, atlas_path, ATLAS)
    tables.put(occupancy.with_tiers(full, config=config).select(names(ATLAS)), atlas_path)
    tiered = tables.get(spark, atlas_path, ATLAS)
    tables.put(occupancy.occupancy_summary(tiered, config).select(names(OCCUPANCY)), output)
    return Step(0, occupancy.report(tiered, config))


def export_table(spark: SparkSession, table: str, output: str) -> Step:
    """A table as one CSV file of that name."""
    found = tables.current(spark, table)
    rows = spark.read.parquet(found) if found else spark.read.parquet(table)
    tables.export_csv(rows, output)
    return Step(0, _told(spark, "export", rows=rows.count()))
