"""Manifests of parsed structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..schemas import CHAIN_MANIFEST, FAILURES, STRUCTURE_MANIFEST, names
from .topology import chain_stats


def structure_manifest(parsed: DataFrame, atoms: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """A row a structure: its metadata, and counts of its chains and residues, the chains in file order."""
    key = ["structure_id", "source_path"]
    ordered = F.array_sort(F.collect_list(F.struct("chain_pos", "chain_id")))
    by = chain_stats(atoms, config).groupBy(key)
    sums = by.agg(
        F.count(F.lit(1)).cast("int").alias("protein_chain_count"),
        F.sum("residue_count").cast("int").alias("protein_residue_count"),
        F.array_join(F.transform(ordered, lambda c: c["chain_id"]), ",").alias("protein_chain_ids"),
    )
    return parsed.filter("error is null").drop("atoms", "error").join(sums, key).select(names(STRUCTURE_MANIFEST))


def chain_manifest(atoms: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    out = chain_stats(atoms, config).orderBy(F.split("source_path", "/"), "chain_pos")
    return out.select(names(CHAIN_MANIFEST))


def ingest_failures(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select(names(FAILURES))
