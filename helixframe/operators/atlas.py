"""Domains joined with the topology of their chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import CONTACT_ERROR, topology_text
from ..schemas import ATLAS, JOIN_FAILURES, names
from .relational import last_wins, tagged


_KEY = ["structure_id", "chain_id"]


def route_atlas(mapping: DataFrame, topology: DataFrame, position: str = "pos") -> DataFrame:
    """Each domain once: with the atlas's columns, an error and its route, hit or miss; of several topology rows of a chain,
    the last by ``position``."""
    t = topology if position in topology.columns else topology.withColumn(position, F.monotonically_increasing_id())
    t = last_wins(t.select(*_KEY, "s_fraction", "p_fraction", "x_fraction", position), _KEY, position).drop(position)
    # a blank chain is a key of its own, as null would never match
    m = mapping.withColumn("chain_id", F.coalesce("chain_id", F.lit("")))
    both = tagged(m, t.withColumn("chain_id", F.coalesce("chain_id", F.lit(""))), _KEY, "route")
    own = [F.nullif(F.col(c), F.lit("")).alias(c) if c == "chain_id" else F.col(c) for c in mapping.columns]
    s, p, x = (F.col(f"{c}_fraction") for c in "spx")
    more = [topology_text(s, p, x).alias("topology_representation"), s.alias("ps_fraction"), p.alias("pp_fraction"), x]
    error = F.when(F.col("route") == "miss", CONTACT_ERROR).alias("error")
    return both.select(*own, *more, F.lit(None).cast("string").alias("occupancy_tier"), error, "route")


def build_atlas(mapping: DataFrame, topology: DataFrame, position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The atlas and its join failures."""
    both = route_atlas(mapping, topology, position)
    return both.filter("route = 'hit'").select(names(ATLAS)), both.filter("route = 'miss'").select(names(JOIN_FAILURES))
