"""Order-aware deduplication, first-hit joins and routed joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constants(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small table of literals, which plans hold as expressions and not as a scan."""
    one = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*one)))


def _free(name: str, df: DataFrame) -> str:
    """``name``, or with underscores after it, so that no column has it."""
    while name in df.columns:
        name += "_"
    return name


def last_wins(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """Of rows with one key, the last by position; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    row = _free("row", df)
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), position).alias(row))
    return best.select(*key, *[F.col(row)[c].alias(c) for c in rest]).select(df.columns)


def first_hit(left: DataFrame, right: DataFrame, key: list[str], value: str, position: str, seen: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Left rows with the value of the first right row of their key, or null. ``seen`` is given the right rows, one a key."""
    return left.join(seen(right.groupBy(*key).agg(F.min_by(value, position).alias(value))), key, "left")


def tagged(left: DataFrame, right: DataFrame, key: list[str], route: str) -> DataFrame:
    """Left rows with those of the right, which has one a key, and ``route``: hit or miss. One join for both."""
    name = _free(_free("hit", right), left)
    both = left.join(right.withColumn(name, F.lit(True)), key, "left")
    return both.withColumn(route, F.when(F.col(name), "hit").otherwise("miss")).drop(name)


def routed(left: DataFrame, right: DataFrame, key: list[str], error: str, failed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Matched rows, and the failure table of the rest. ``right`` has one row a key."""
    route = _free(_free("route", right), left)
    both = tagged(left, right, key, route)
    return both.filter(F.col(route) == "hit").drop(route), both.filter(F.col(route) == "miss").select(*failed, F.lit(error).alias("error"))


def distinct_sorted(df: DataFrame, *columns) -> DataFrame:
    out = df.select(*columns).distinct()
    return out.orderBy(*out.columns)


def counted(df: DataFrame, key, alias: str, empty: str | None = None) -> DataFrame:
    """Rows a value, most frequent first, ties by value; nulls under ``empty`` or left out."""
    k = F.coalesce(F.nullif(key, F.lit("")), F.lit(empty)) if empty else key
    return df.select(k.alias(alias)).filter(F.col(alias).isNotNull()).groupBy(alias).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), alias)
