"""Bounded samples of labelled texts, for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_dir, stash



def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int]) -> tuple[pd.DataFrame, tuple[int, int]]:
    """At most ``most`` texts labelled 0 and 1 (columns text, y), of any length, by hash of id, and how many rows have each
    label. Held-out rows, null ids and other labels are left out; an id that is labelled twice takes the larger label."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    work = fresh_dir(docs.sparkSession, "labelled")
    known = stash(known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")), "labels", work)
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (0, 1)]
    chosen = stash(parts[0].union(parts[1]), "sample", work)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # the sample has sum(most) rows at most; of an id that occurs again, one text is fetched, the least
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = found.toArrow().to_pandas().sort_values("doc_id")
    discard(docs.sparkSession, work)
    return found[["doc_id", "text", "y"]].reset_index(drop=True), (totals.get(0, 0), totals.get(1, 0))
