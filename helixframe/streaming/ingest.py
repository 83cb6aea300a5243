"""Incremental ingest: structure files are parsed as they appear, each once, and the manifests follow.

A structure's files are told apart by their names' stems: of several files of one stem, in any folder, the one that was
changed last counts (the greater path among equals). So a new version of a structure is a new file of its stem; a file that
is changed in place isn't seen again by a file stream.

Each micro-batch writes what it parsed below ``state`` as a partition of its own number, so that a batch that is run again
after a failure replaces itself. Nothing that was written before is rewritten: which rows count is decided when the tables
are read, by a last-wins aggregate over the files, a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import PipelineConfig
from ..functions.scalar import stem, structure_format
from ..operators.manifests import chain_manifest, ingest_failures, structure_manifest
from ..operators.relational import last_wins
from ..schemas import CHAIN_MANIFEST, FAILURES, STRUCTURE_MANIFEST, names
from ..sources.coordinates import atoms_of, parse_files

_FILE = "path string, modificationTime timestamp, length long, content binary"
_FILES = "source_path string, stem string, modified timestamp"
_TABLES = {"structures": STRUCTURE_MANIFEST, "chains": CHAIN_MANIFEST, "failures": FAILURES}


def _new_files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).load(root)
    return files.withColumn("format", structure_format(F.col("path"))).filter("format is not null")


def ingest_new(spark: SparkSession, root: str, output: str, checkpoint: str) -> StreamingQuery:
    """Appends parsed files, failures with them, to Parquet, and stops when all that is there is done."""
    named = _new_files(spark, root).select("path", "format", "content")
    return parse_files(named).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)


def ingest_versions(spark: SparkSession, root: str, state: str, checkpoint: str, config: PipelineConfig = PipelineConfig()) -> StreamingQuery:
    """Parses new files into ``state`` and stops when all that is there is done; ``versions`` reads the manifests."""

    def merge(batch: DataFrame, number: int) -> None:
        put = lambda df, table: df.write.mode("overwrite").parquet(f"{state}/{table}/batch={number}")
        put(parse_files(batch.select("path", "format", "content"), config), "parsed")
        parsed = batch.sparkSession.read.parquet(f"{state}/parsed/batch={number}")
        atoms = atoms_of(parsed)
        put(structure_manifest(parsed, atoms, config), "structures")
        put(chain_manifest(atoms, config), "chains")
        put(ingest_failures(parsed), "failures")
        path = F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("source_path")
        # last, so that a batch counts when all its tables are there
        put(batch.select(path, stem(F.col("path")).alias("stem"), F.col("modificationTime").alias("modified")), "files")

    stream = _new_files(spark, root).writeStream.foreachBatch(merge)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def present_files(spark: SparkSession, state: str) -> DataFrame:
    """(source_path, batch) of the last version of each structure."""
    files = spark.read.schema(f"{_FILES}, batch int").parquet(f"{state}/files")
    return last_wins(files.withColumn("at", F.struct("modified", "source_path", "batch")), ["stem"], "at").select("source_path", "batch")


def versions(spark: SparkSession, state: str, table: str) -> DataFrame:
    """The manifest of structures or chains, or the failures, of the last version of each structure."""
    kept = spark.read.schema(f"{_TABLES[table]}, batch int").parquet(f"{state}/{table}")
    return kept.join(present_files(spark, state), ["source_path", "batch"], "left_semi").select(names(_TABLES[table]))
