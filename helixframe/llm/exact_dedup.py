"""Exact dedup by a sort of contents, in DataFrame functions alone.

Texts are equal when they are identical after each run of white space becomes one space. Rows are range-partitioned by
Spark's sampled splitters and sorted in each partition, with spilling to disk; equal texts are then neighbours, which a
window compares in full. So that splitters are small, they hold the first characters and the SHA-256 of a normalised text,
never a whole one.

A text that fills much of a partition by itself is found in a sample and dealt in parts, by a hash of doc_id. Each part is
a run that is compared in full like any other; one row stands for each run of such a text, and these rows are sorted and
compared in full again. The sample decides how rows are dealt and nothing else: a text that it misses is one run. It lists
at most ``4 * partitions`` texts, as each holds at least half of a partition's share of the sampled rows or bytes.

Defined cases: null is an empty text, and both equal texts of white space alone only where these normalise to the same
(one space is not empty). Of rows that repeat an id one stays; null ids come after all others, so they stay only where no
row of the text has an id, and keep_id is then null. An empty table gives no rows. Other columns change nothing, and
``drop_copies`` keeps them all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SPACES = r"[\x20\x09-\x0D]+"
#: Characters of a text by which partitions are told apart before its digest does.
LEADING = 32
#: Rows sampled for each partition, at least; and the sampled copies below which a text is no heavy one.
SAMPLED, SEEN = 64, 8


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _keyed(rows: DataFrame) -> DataFrame:
    """With columns norm and sha."""
    named = rows.withColumn("norm", normalised(F.col("text")))
    return named.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))


def heavy_texts(rows: DataFrame, parts: int, count: int) -> DataFrame:
    """(sha, deal): the texts that take half a partition's share of a sample's rows or bytes, and the runs that they are dealt to."""
    share = min(1.0, max(0.01, SAMPLED * parts / max(1, count)))
    seen = _keyed(rows.sample(share, seed=12) if share < 1 else rows)
    seen = seen.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("norm")).alias("size"))
    seen = stash(seen, "sampled")
    total = seen.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    part = F.greatest(*[F.col(c) * F.lit(parts / max(1, total[c] or 0)) for c in ("n", "size")])
    large = seen.filter(F.col("n") >= SEEN).withColumn("part", part).filter("part >= 0.5")
    return large.select("sha", F.ceil(4 * F.col("part")).cast("int").alias("deal"))


def _runs(rows: DataFrame, parts: int, *more: str) -> tuple[DataFrame, Window, Window]:
    """Rows by ranges of their contents, the window of a run of equal texts in order of ids, and the whole run."""
    key = [F.substring("norm", 1, LEADING), F.col("sha"), *map(F.col, more)]
    dealt = rows.withColumn("lead", key[0]).repartitionByRange(parts, "lead", "sha", *more)
    run = Window.partitionBy("lead", "sha", *more, "norm")
    return dealt, run.orderBy(F.col("doc_id").asc_nulls_last()), run


def content_groups(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256) and, if ``carry`` names columns, a struct ``row`` of them: one
    a row of ``docs``."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")]
    rows = docs.select(*own, *([F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []))
    heavy = heavy_texts(rows.select("doc_id", "text"), parts, docs.count())
    # 4 * parts rows at most
    keyed = _keyed(rows).drop("text").join(F.broadcast(heavy), "sha", "left")
    keyed = keyed.withColumn("deal", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("deal")).cast("int"), F.lit(-1)))
    dealt, by_id, run = _runs(keyed, parts, "deal")
    first = F.row_number().over(by_id) == 1
    here = {"run_id": F.min("doc_id").over(run), "run_size": F.count(F.lit(1)).over(run), "first": first}
    here["stands"] = F.when(first & (F.col("deal") >= 0), F.col("norm"))
    kept = [c for c in ("doc_id", "row") if c in keyed.columns]
    compared = dealt.select(*kept, "sha", "deal", "norm", *[v.alias(k) for k, v in here.items()])
    out = stash(compared.drop("norm"), "runs")
    # a row for each run of a heavy text
    some = out.filter("stands is not null").select("sha", "deal", F.col("stands").alias("norm"), F.col("run_id").alias("doc_id"), "run_size")
    again, by_id, run = _runs(some, parts)
    whole = {"all_id": F.min("doc_id").over(run), "all_size": F.sum("run_size").over(run), "wins": F.row_number().over(by_id) == 1}
    whole = stash(again.select("sha", "deal", *[v.alias(k) for k, v in whole.items()]), "heavy")
    # at most 8 * parts runs by their shares, and one more a text
    out = out.join(F.broadcast(whole), ["sha", "deal"], "left")
    at = {
        "keep_id": F.when(F.col("deal") >= 0, F.col("all_id")).otherwise(F.col("run_id")),
        "group_size": F.coalesce("all_size", "run_size"),
        "kept": F.col("first") & F.coalesce("wins", F.lit(True)),
        "text_sha256": F.col("sha"),
    }
    return out.select("doc_id", *[v.alias(k) for k, v in at.items()], *kept[1:])


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` less all rows but one of each group of equal texts; whole rows, with all columns."""
    packed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    named = packed.withColumn("doc_id", F.col(f"c{docs.columns.index('doc_id')}")).withColumn("text", F.col(f"c{docs.columns.index('text')}"))
    found = content_groups(named, tuple(packed.columns)).filter("kept")
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op12_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
numbered AS (
  SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept
  FROM normal)
SELECT doc_id, keep_id, cast(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256 FROM numbered
"""
