"""Mixing sources to target weights, in DataFrame functions alone.

Sizes are words. Sources, in order of code points with null last, weigh WEIGHTS in turn and share ``share`` of all
sizes; a target stops at ``most`` times its source's size, and the excess is shared anew by weight among the others
until none is above. That is a water level: with sources by cap / weight, the level is what is left after the caps
below it, over the weights above it.

A source's rate is target / size. Each document is emitted floor(rate) times, plus one copy by a Bernoulli draw whose
probability is the fraction: its hash, of 48 bits, is compared with the fraction of 2**48. The hash is of seed, id and
text digest, so reruns agree and no document's draw depends on another's. So the words taken from a source vary about its
target, with a standard deviation of sqrt(p (1 - p) sum(size ** 2)) for a fraction p; ``deviations`` gives both.

Defined cases: null or wordless text has size 0; a null source is a source of its own; sources without words have target
0 and take nothing; rows that repeat id and text share a draw, those with a null id and equal text too; other columns are
kept by ``mix_documents``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Sources up to which their table is broadcast; beyond, it is joined as any other.
BROADCAST_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 48


def size_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(doc_id, text, seed: int) -> F.Column:
    """A hash of 48 bits."""
    known = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(known.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate). Windows over all rows: a row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    s = s.withColumn("at", F.row_number().over(by_cap)).withColumn("level", left / F.sum("w").over(rest))
    s = s.withColumn("first", F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("at", "level"))).over(everything))
    s = s.withColumn("target", F.when(F.col("at") < F.coalesce("first.at", F.col("at") + 1), F.col("cap")).otherwise(F.col("first.level") * F.col("w")))
    return s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def rates(slim: DataFrame, **how) -> DataFrame:
    """From rows (source, size): (source, source_size, target, base, chance): each document base times, and once more by chance."""
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    return stash(goal.select("source", "source_size", "target", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("chance")), "rates")


def _copies(rows: DataFrame, rate: DataFrame) -> DataFrame:
    r = rate.withColumnRenamed("source", "r_source")
    r = F.broadcast(r) if r.count() <= BROADCAST_ROWS else r
    joined = rows.join(r, rows["source"].eqNullSafe(F.col("r_source")))
    once = F.col("draw") < F.col("chance") * F.lit(float(1 << _BITS))
    return joined.withColumn("copies", F.col("base") + F.when(once, 1).otherwise(0)).drop("r_source")


def _slim(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, draw): written once, so that texts are read once for sizes and draws."""
    own = [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source")]
    return stash(docs.select(*own, size_of(docs["text"]).alias("size"), draw_of(docs["doc_id"], docs["text"], seed).alias("draw")), "sizes")


def mix_table(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies)."""
    slim = _slim(docs, seed)
    out = _copies(slim, rates(slim, **how))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def deviations(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """Rows (source, source_size, target, taken, expected_deviation): a row a source."""
    slim = _slim(docs, seed)
    rate = rates(slim, **how)
    one = F.col("size").cast("double")
    out = _copies(slim, rate).groupBy("source", "source_size", "target", "chance")
    out = out.agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.sum(one * one).alias("squares"))
    return out.select("source", "source_size", "target", "taken", F.expr("sqrt(chance * (1 - chance) * squares)").alias("expected_deviation"))


def mix_documents(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is emitted."""
    sizes = docs.select(docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"))
    rate = rates(sizes, **how)
    own = [docs["source"].cast("string").alias("source"), draw_of(docs["doc_id"], docs["text"], seed).alias("draw")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *own)
    many = _copies(rows, rate).filter("copies > 0").select("row", F.explode(F.expr("array_repeat(1, cast(copies as int))")).alias("copy"))
    return many.select("row.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         cast('0x' || substr(md5('0:' || coalesce(cast(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 12) AS BIGINT) AS draw
  FROM documents),
sizes AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM slim GROUP BY source),
caps AS (SELECT source, source_size, cast([5, 2, 1][(n - 1) % 3 + 1] AS DOUBLE) AS w, cast(source_size AS DOUBLE) * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, row_number() OVER o AS ord, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM caps WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
level AS (SELECT *, (1.5::DOUBLE * cast(total AS DOUBLE) - below) / rest AS level FROM levels),
head AS (SELECT min(ord) AS ord, arg_min(level, ord) AS level FROM level WHERE level * w < cap),
goal AS (
  SELECT source, source_size, CASE WHEN l.ord < coalesce(f.ord, l.ord + 1) THEN cap ELSE f.level * w END AS target
  FROM level l CROSS JOIN head f),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM goal),
copied AS (
  SELECT s.*, r.source_size, r.target, floor(rate) + CASE WHEN draw < (rate - floor(rate)) * 281474976710656.0::DOUBLE THEN 1 ELSE 0 END AS copies
  FROM slim s JOIN rate r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, cast(copies AS BIGINT) AS copies, cast(size * copies AS BIGINT) AS taken FROM copied
"""
