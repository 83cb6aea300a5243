"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of each kingdom, matched as substrings, archaea before bacteria before eukaryotes.
ARCHAEA = (
    "archaea", "archaeon", "methanobacterium", "halobacterium", "sulfolobus", "pyrococcus", "thermococcus",
    "methanococcus",
)
BACTERIA = (
    "escherichia", "bacillus", "staphylococcus", "streptococcus", "salmonella", "mycobacterium",
    "pseudomonas", "helicobacter", "clostridium", "vibrio", "neisseria", "campylobacter", "bacteria",
    "thermus", "thermotoga", "aquifex",
)
EUKARYOTES = (
    "human", "mouse", "rat", "homo sapiens", "mus musculus", "saccharomyces", "drosophila", "caenorhabditis",
    "arabidopsis", "xenopus", "danio", "gallus", "bos", "sus", "oryctolagus", "eukaryot", "fungal", "fungi",
    "plant", "mammal",
)
KINGDOMS = {"archaea": ARCHAEA, "bacteria": BACTERIA, "eukaryotes": EUKARYOTES}
# Names of the structural classes.
CLASS_NAMES = {
    "a": "all-alpha",
    "b": "all-beta",
    "c": "alpha/beta (a/b)",
    "d": "alpha+beta (a+b)",
    "e": "multi-domain",
    "f": "membrane/cell surface",
    "g": "small proteins",
}
TIERS = ("common", "rare", "ultra-rare")
# Texts of the failures.
CONTACT_ERROR = "Missing chain topology summary for domain join."
NO_CHAIN_ERROR = "No protein chains detected in first model."


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def matched(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where nothing matches."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def priority_class(text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """The first class one of whose keywords is in the text, in any case; null if none. Searches for each keyword are
    compiled loops over bytes, and end at the first hit; one pattern of them all took four times as long."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for name, keywords in reversed(classes.items()):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def kingdom(text: Column) -> Column:
    return priority_class(text, KINGDOMS)


def occupancy_tier(count: Column, common: int = 10, rare: int = 3) -> Column:
    return F.when(count >= common, "common").when(count >= rare, "rare").when(count >= 1, "ultra-rare").otherwise("unoccupied")


def fraction(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total)


def six_decimals(c: Column) -> Column:
    """Six decimals, rounded half to even on the binary value; null stays null."""
    return F.replace(F.format_number(c, 6), F.lit(","), F.lit(""))


def topology_text(s: Column, p: Column, x: Column) -> Column:
    part = lambda c: F.coalesce(six_decimals(c), F.lit(""))
    return F.concat(F.lit("S="), part(s), F.lit(";P="), part(p), F.lit(";X="), part(x))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def structure_format(path: Column) -> Column:
    """mmcif or pdb by suffix in any case, else null."""
    return F.when(F.lower(path).rlike(r"\.(cif|mmcif)(\.gz)?$"), "mmcif").when(F.lower(path).rlike(r"\.(pdb|ent)(\.gz)?$"), "pdb")


def stem(path: Column) -> Column:
    """The file name without .gz and the suffix before it."""
    return F.regexp_replace(F.regexp_replace(file_name(path), r"\.gz$", ""), r"(?<=.)\.[^.]*$", "")


def dict_text(entries: Column) -> Column:
    """Of structs (key, n): {'key': n, ...} in the array's order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["n"].cast("string"))), ", "), F.lit("}"))
