"""How densely each structural class is occupied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.scalar import CLASS_NAMES, TIERS, occupancy_tier
from .relational import constants, counted

CONFIG = PipelineConfig()


def fold_counts(atlas: DataFrame, fold: str = "scope_id", config: PipelineConfig = CONFIG) -> DataFrame:
    """(fold, domain_count, occupancy_tier), blank folds left out."""
    n = atlas.filter(F.col(fold).isNotNull()).groupBy(fold).agg(F.count(F.lit(1)).alias("domain_count"))
    return n.withColumn("occupancy_tier", occupancy_tier(F.col("domain_count"), config.common_from, config.rare_from))


def with_tiers(atlas: DataFrame, fold: str = "scope_id", config: PipelineConfig = CONFIG) -> DataFrame:
    """The atlas with its tier column filled; a join on counts, so that one large fold is split as any skewed key."""
    tiers = fold_counts(atlas, fold, config).select(fold, "occupancy_tier")
    rest = [c for c in atlas.columns if c != "occupancy_tier"]
    return atlas.drop("occupancy_tier").join(tiers, fold, "left").select(*rest, "occupancy_tier")


def tier_counts(folds: DataFrame) -> DataFrame:
    """Folds of each tier, with zeros."""
    tiers = constants(folds.sparkSession, [(t, i) for i, t in enumerate(TIERS)], "occupancy_tier", "ord")
    n = folds.groupBy("occupancy_tier").agg(F.count(F.lit(1)).alias("folds"))
    return tiers.join(n, "occupancy_tier", "left").select("occupancy_tier", F.coalesce("folds", F.lit(0)).alias("folds"), "ord").orderBy("ord").drop("ord")


def key_counts(df: DataFrame, key: str, value, alias: str = "kingdoms") -> DataFrame:
    """(key, entries): counts of each value of a key, most frequent first, as structs (key, n)."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("v").alias("k"))))
    entries = F.transform(ranked, lambda e: F.struct(e["k"].alias("key"), (-e["m"]).alias("n")))
    return n.groupBy(key).agg(entries.alias(alias))


def unknown(c) -> F.Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def occupancy_summary(atlas: DataFrame, config: PipelineConfig = CONFIG) -> DataFrame:
    """A row a fold: its domains, tier, and domains by kingdom, the most frequent fold first."""
    kinds = key_counts(atlas, "scope_id", unknown(F.col("kingdom")))
    both = fold_counts(atlas, config=config).join(kinds, "scope_id")
    both = both.select("scope_id", "domain_count", "occupancy_tier", F.map_from_entries("kingdoms").alias("kingdoms"))
    return both.orderBy(F.desc("domain_count"), "scope_id")


def class_counts(df: DataFrame, code, distinct: str) -> DataFrame:
    """Rows and distinct folds of each named class that occurs."""
    names = constants(df.sparkSession, list(CLASS_NAMES.items()), "class", "class_name")
    n = df.groupBy(code.alias("class")).agg(F.count(F.lit(1)).alias("domains"), F.countDistinct(distinct).alias("folds"))
    return F.broadcast(names).join(n, "class").select("class", "class_name", "domains", "folds").orderBy("class")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, least and greatest of the numbers in each column; a single number has no deviation."""
    v = [F.expr(f"try_cast(`{c}` as double)") for c in columns]
    each = [F.struct(F.lit(c).alias("metric"), x.alias("v")) for c, x in zip(columns, v)]
    long = df.select(F.inline(F.array(*each))).filter("v is not null and not isnan(v)")
    kinds = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return long.groupBy("metric").agg(*[of("v").alias(n) for n, of in kinds.items()])


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose cell is filled, and their percentage. Blank and null cells are not filled."""
    filled = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("total"), *filled)
    each = [F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("total")) for c in columns]
    percent = F.when(F.col("total") > 0, 100.0 * F.col("filled") / F.col("total")).alias("percent")
    return one.select(F.inline(F.array(*each))).select("column", "filled", "total", percent)


def _by_row(atlas: DataFrame) -> DataFrame:
    """Rows of the report that count or average the atlas's rows, by one aggregation. A metric without numbers has none."""
    aggregates, cells = [F.count(F.lit(1)).alias("domains")], [("totals", "domains", F.col("domains"), F.lit(1))]
    for c in ("cath_id", "ecod_id"):
        aggregates.append(F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c))
        cells.append(("coverage", c, F.when(F.col("domains") > 0, 100.0 * F.col(c) / F.col("domains")), F.lit(1)))
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    for c in ("ps_fraction", "pp_fraction", "x_fraction"):
        cast = F.expr(f"try_cast(`{c}` as double)")
        number = F.when(~F.isnan(cast), cast)
        aggregates.append(F.count(number).alias(f"{c}_n"))
        for name, of in kinds.items():
            aggregates.append(of(number).alias(f"{c}_{name}"))
            cells.append((f"fraction {name}", c, F.col(f"{c}_{name}"), F.col(f"{c}_n")))
    each = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.cast("double").alias("value"), n.cast("long").alias("n")) for s, k, v, n in cells]
    return atlas.agg(*aggregates).select(F.inline(F.array(*each))).filter("n > 0").drop("n")


def _by_fold(folds: DataFrame) -> DataFrame:
    """Rows of the report that count folds, by one aggregation over grouping sets. Classes that do not occur have none."""
    named = folds.select(F.substring("scope_id", 1, 1).alias("class"), "occupancy_tier", "domain_count")
    sets = named.groupingSets([["class"], ["occupancy_tier"], []], "class", "occupancy_tier")
    sums = sets.agg(F.grouping_id().cast("int").alias("grain"), F.sum("domain_count").alias("domains"), F.count(F.lit(1)).alias("folds"))
    sums = sums.select("grain", F.coalesce("class", "occupancy_tier", F.lit("folds")).alias("key"), "domains", "folds")
    # grouping_id: 1 by class, 2 by tier, 3 over all
    told = [("totals", "folds", 3)] + [("tiers", t, 2) for t in TIERS]
    told += [(f"class {x}", c, 1) for c in CLASS_NAMES for x in ("domains", "folds")]
    out = constants(folds.sparkSession, told, "section", "key", "grain").join(sums, ["grain", "key"], "left")
    value = F.when(F.col("section") == "class domains", F.col("domains")).when(F.col("grain") == 1, F.col("folds")).otherwise(F.coalesce("folds", F.lit(0)))
    return out.select("section", "key", value.cast("double").alias("value")).filter("value is not null")


def report(atlas: DataFrame, config: PipelineConfig = CONFIG) -> DataFrame:
    """The printed report as rows (section, key, value): one aggregation each by row, by kingdom and by fold."""
    kinds = counted(atlas, F.col("kingdom"), "kingdom", "unknown")
    kinds = kinds.select(F.lit("kingdoms").alias("section"), F.col("kingdom").alias("key"), F.col("n").cast("double").alias("value"))
    return _by_row(atlas).unionAll(kinds).unionAll(_by_fold(fold_counts(atlas, config=config)))
