"""Readers of the structural classifications, and the domain mapping made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.scalar import KINGDOMS, blank_to_null, kingdom, matched, strip
from ..operators.relational import first_hit, last_wins
from .json_arrays import read_json_array
from .tables import Watched, lines, position

_RANGE = r"^([A-Za-z0-9]):(-?[0-9]+)-(-?[0-9]+)"
_CHAIN = r"^([A-Za-z0-9]):"


def _fields(df: DataFrame, least: int) -> DataFrame:
    """Lines that aren't comments, stripped and then split, with enough fields."""
    rows = df.filter(~F.col("value").startswith("#")).withColumn("f", F.split(strip(F.col("value")), "\t", -1))
    return rows.filter(F.size("f") >= least)


def read_scope_cla(spark: SparkSession, path: str) -> DataFrame:
    """Domains of the classification file; the last row of an sid counts. A region's first segment gives its range; a
    range whose numbers are no integers of 32 bits is null."""
    at = F.col("f")
    names = ["sid", "structure_id", "region", "sccs", "sunid", "hierarchy"]
    cells = [at[0], F.lower(at[1]), strip(at[2]), at[3], at[4], at[5]]
    rows = _fields(lines(spark, path), 6).select(*[c.alias(n) for c, n in zip(cells, names)], "pos")
    rows = last_wins(rows, ["sid"], "pos")
    region = F.col("region")
    chain = F.coalesce(matched(region, _RANGE, 1), matched(region, _CHAIN, 1)).alias("chain_id")
    ends = [matched(region, _RANGE, i).try_cast("int").alias(n) for i, n in ((2, "residue_start"), (3, "residue_end"))]
    species = matched(F.col("hierarchy"), r"sp=([0-9]+)", 1).alias("species")
    return rows.select("sid", "structure_id", chain, *ends, "sccs", "sunid", "hierarchy", species, "pos")


def read_scope_des(spark: SparkSession, path: str) -> DataFrame:
    """(sunid, level, sccs, description); rows whose last field is blank lose it by stripping, and so are dropped."""
    at = F.col("f")
    rows = _fields(lines(spark, path), 5).select(at[0].alias("sunid"), at[1].alias("level"), at[2].alias("sccs"), at[4].alias("description"), "pos")
    return last_wins(rows, ["sunid"], "pos").drop("pos")


def read_fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(sid, domain_length): letters of each record, its lines stripped. One row a record, of any number of lines."""
    rec = spark.read.option("lineSep", "\n>").text(path)
    rec = rec.select(F.make_valid_utf8("value").alias("value"), position().alias("pos"), (F.col("_metadata.file_block_start") == 0).alias("start"))
    # text before the first header is no record: a first row counts only if it begins one
    rec = rec.withColumn("head", F.col("value").startswith(">")).filter("head or pos.i % 8589934592 > 0 or not start")
    parts = F.split(F.regexp_replace("value", "^>", ""), r"\r\n|\n|\r")
    letters = F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.length(strip(x)))
    size = F.aggregate(letters, F.lit(0), lambda a, b: a + b).alias("domain_length")
    rec = rec.select(F.get(F.split(strip(F.get(parts, 0)), r"\s+"), 0).alias("sid"), size, "pos")
    return last_wins(rec.filter("sid <> ''"), ["sid"], "pos").drop("pos")


def read_cath(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, chain_id, cath_id, pos) of a JSON object with ``data``, or of a bare list, in splits. Entries without ids are dropped."""
    entry = "struct<domain_id: string, pdb_code: string, superfamily_id: string, atom_length: string>"
    rows = read_json_array(spark, path, "data").select(F.struct("file", "pos").alias("pos"), F.from_json("value", entry).alias("e"))
    rows = rows.select("pos", "e.*").filter("domain_id <> '' and pdb_code <> ''")
    key = [F.lower("pdb_code").alias("structure_id"), F.substring("domain_id", 5, 1).alias("chain_id")]
    return rows.select(*key, F.col("superfamily_id").alias("cath_id"), "domain_id", "pos")


def read_ecod(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, chain_id, ecod_id, pos) by the file's own header; none without a header."""
    text = lines(spark, path)
    # hashes go first, then white space
    titled = text.withColumn("title", strip(F.regexp_replace("value", "^#+", ""))).filter(F.col("title").startswith("uid"))
    head = titled.orderBy("pos").limit(1).select(F.split("title", "\t", -1).alias("header"), F.col("pos").alias("head_pos"))
    # one row at most
    rows = text.join(F.broadcast(head), F.col("pos") > F.col("head_pos")).filter(~F.col("value").startswith("#"))
    rows = rows.withColumn("f", F.split(strip(F.col("value")), "\t", -1)).filter(F.size("f") >= F.size("header"))
    cell = lambda name: F.get(F.col("f"), F.array_position("header", name).cast("int") - 1)
    some = lambda name: F.when(F.array_contains("header", name), cell(name)).otherwise(F.lit(""))
    cells = {"structure_id": F.lower(some("pdb")), "chain_id": some("chain"), "ecod_id": some("f_id"), "ecod_domain_id": some("ecod_domain_id")}
    return rows.select(*[c.alias(n) for n, c in cells.items()], "pos").filter("structure_id <> ''")


def domain_mapping(
    scope: DataFrame,
    species: DataFrame,
    lengths: DataFrame,
    cath: DataFrame,
    ecod: DataFrame,
    config: PipelineConfig = PipelineConfig(),
) -> tuple[DataFrame, Watched]:
    """The mapping, and what is counted while it is made: what was read, what fell out, what was kept, and the kingdoms of that."""
    seen, n = Watched(), F.count(F.lit(1))
    scope = seen.watch(scope, "read", **{"scope domains": n})
    species = seen.watch(species, "read", **{"scope descriptions": n})
    lengths = seen.watch(lengths, "read", **{"sequences": n})
    cath = seen.watch(cath, "read", **{"cath domains": n})
    ecod = seen.watch(ecod, "read", **{"ecod domains": n})
    size = F.col("domain_length")
    fits = size.between(config.min_length, config.max_length)
    fell = {"without length": F.count_if(size.isNull()), "outside window": F.count_if(size.isNotNull() & ~fits)}
    joined = seen.watch(scope.join(lengths, "sid", "left"), "mapping", **fell)
    key = ["structure_id", "chain_id"]
    both = joined.filter(fits).withColumn("chain_id", F.coalesce("chain_id", F.lit("")))
    for name, right in (("cath", cath), ("ecod", ecod)):
        both = first_hit(both, right, key, f"{name}_id", "pos", lambda x, name=name: seen.watch(x, "read", **{f"{name} chains": n}))
    named = species.filter("level = 'sp'").select(F.col("sunid").alias("species"), "description")
    both = both.join(named, "species", "left")
    cells = {
        "domain_id": F.col("sid"),
        "structure_id": F.col("structure_id"),
        "chain_id": blank_to_null(F.col("chain_id")),
        "residue_start": F.col("residue_start"),
        "residue_end": F.col("residue_end"),
        "domain_length": size.cast("int"),
        "kingdom": kingdom(F.col("description")),
        "scope_id": F.col("sccs"),
        "cath_id": blank_to_null(F.col("cath_id")),
        "ecod_id": blank_to_null(F.col("ecod_id")),
    }
    out = both.select(*[c.alias(n) for n, c in cells.items()])
    out = seen.watch(out, "mapping", **{"rows": n, "with cath": F.count("cath_id"), "with ecod": F.count("ecod_id")})
    kinds = F.coalesce("kingdom", F.lit("unknown"))
    return seen.watch(out, "kingdoms", **{k: F.count_if(kinds == k) for k in (*KINGDOMS, "unknown")}), seen
