"""Chemical components: which residue names are amino acids, by the polymer type in a dictionary of components.

The dictionary is a CIF file of many blocks, one a component; blocks are rows of a text source, so it is read in splits. A
component is an amino acid if its type names a peptide and is not for other things to be like one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = r"""(?:"([^"\n]*)"|'([^'\n]*)'|([^\s'"_][^\s'"]*))"""


def _item(name: str) -> F.Column:
    """The value of an item of a block, quoted or not, in upper case; null where it is missing or unknown."""
    pattern = rf"(?im)^_chem_comp\.{name}\s+{_VALUE}"
    found = F.coalesce(*[F.nullif(F.regexp_extract("value", pattern, k), F.lit("")) for k in (1, 2, 3)])
    return F.when(~found.isin("?", "."), F.upper(F.trim(found)))


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind) of each component of a dictionary; of several blocks of a name, the least kind."""
    blocks = spark.read.option("lineSep", "\ndata_").text(path)
    rows = blocks.select(F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    # where a loop lists components, as in a file of one block, its rows are items by column
    looped = rows.filter(F.col("value").rlike(r"(?im)^loop_\s*\n\s*_chem_comp\.id\s*\n\s*_chem_comp\.type\s*\n"))
    body = F.regexp_extract("value", r"(?is)loop_\s*\n\s*_chem_comp\.id\s*\n\s*_chem_comp\.type\s*\n(.*?)(?:\n#|\nloop_|\n_|\z)", 1)
    line = looped.select(F.explode(F.split(body, "\n")).alias("line")).filter(F.trim("line") != "")
    cells = F.regexp_extract("line", rf"^\s*(\S+)\s+{_VALUE}", 1), [F.regexp_extract("line", rf"^\s*\S+\s+{_VALUE}", k) for k in (1, 2, 3)]
    listed = line.select(F.upper(cells[0]).alias("name"), F.upper(F.coalesce(*[F.nullif(c, F.lit("")) for c in cells[1]])).alias("kind"))
    one = rows.select(_item("id").alias("name"), _item("type").alias("kind"))
    found = one.union(listed).filter("name is not null and kind is not null and name <> ''")
    return found.groupBy("name").agg(F.min("kind").alias("kind"))


def amino_acids(components: DataFrame) -> DataFrame:
    """(resname): names of components that peptides are made of."""
    kind = F.col("kind")
    return components.filter(kind.contains("PEPTIDE") & ~kind.contains("PEPTIDE-LIKE")).select(F.col("name").alias("resname"))
