"""Ranked lexical search: TPUT over postings that are partitioned by term, exact top-k for each item.

An index is built in one pass over whole texts: a row (term, doc, tf, n) for each document and term that some item asks
for, and sums for the statistics, which count every document and term. Postings are then written with their part of a
score (``gain``), dealt by term and sorted by gain. A term that many documents hold is dealt in blocks, so that no list is
one task's.

For each item, then (three-phase uniform threshold):

1. the ``k`` largest gains of each list are fetched; the k-th largest sum of these is ``least``, a lower bound on the
   k-th score;
2. every list of an item of ``m`` terms is cut at gain * m >= least. A document below the cut in all lists scores under
   ``least``. A list is sent once, down to the lowest cut of its items, to tasks that each hold some documents.
   There, sums of what was found give a higher lower bound; sums plus the cut, or the list's largest gain, for every list
   in which a document was not found give its upper bound, and documents whose upper bound is below the lower one go;
3. the candidates that remain are looked up in the postings, and ranked by their exact scores.

How much the cut leaves out is the collection's: where an item has many words that most documents hold, nearly all
postings pass it, and the second phase scores nearly everything; it then costs a shuffle of the postings, not one of
items times postings.

Ties with the k-th score are kept by every cut, so the result is that of scoring everything, up to 64-bit hashes of terms.

The score is of whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a gain is weight *
(10**9 tf div (1000 tf + 20 m)), with m = 50 + (50 n N) div L for a document of n terms, N documents with terms and L
terms in all.

Defined cases: a null text, or one without terms, is in no statistic and never found; an item without terms, or whose
terms no document holds, has no rows; items that repeat an id are told apart (each has its ranks); repeated documents are
each ranked, and null ids come after others of equal score. Empty tables give no rows. Other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, stash, table
from .text import ALNUM, groups, release, utf8, words

K = 50
#: Postings of a list, on average, that a block of it holds.
BLOCK = 100_000
#: Documents whose bounds a task adds up, on average, and (item, term) pairs whose lists a task looks up at once; more are done in blocks of items.
BUCKET, PAIRS = 8_192, 1 << 20
_POSTINGS = "doc long, doc_id long, n long, term long, tf long"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, term): distinct terms of each row of ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            h, row, _, _ = words(data, offsets, ALNUM)
            pairs = np.unique(np.stack([row.astype(np.int64), h.view(np.int64)], 1), axis=0)
            at = pa.array(pairs[:, 0])
            yield pa.record_batch([batch.column("item").take(at), batch.column("item_id").take(at), pa.array(pairs[:, 1])], ["item", "item_id", "term"])

    own = items.select(F.monotonically_increasing_id().alias("item"), items[item_id].cast("long").alias("item_id"), items[text].cast("string").alias("text"))
    return own.mapInArrow(run, "item long, item_id long, term long")


def _postings(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """A row for each document and term that may be asked for; and a row a batch without a term, with tf documents and n terms in all."""
    bits = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _POSTINGS.split(", ")]
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            held = terms = 0
            for lo, hi in groups(offsets):
                h, row, _, _ = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                n = np.bincount(row, minlength=hi - lo)
                held, terms = held + int((n > 0).sum()), terms + len(h)
                at = in_bitmap(bits.value, h)
                h, row = h[at], row[at]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.empty(0, np.int64)
                tf = np.diff(np.append(first, len(h)))
                own = row[first]
                take = pa.array(own + lo)
                yield pa.record_batch([batch.column("doc").take(take), batch.column("doc_id").take(take), pa.array(n[own].astype(np.int64)), pa.array(h[first].view(np.int64)), pa.array(tf.astype(np.int64))], names)
            none = pa.array([None], pa.int64())
            yield pa.record_batch([none, none, pa.array([terms], pa.int64()), none, pa.array([held], pa.int64())], names)
        release()

    own = [F.monotonically_increasing_id().alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]
    return docs.select(*own).mapInArrow(run, _POSTINGS)


def build_index(docs: DataFrame, asked: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(term, doc, doc_id, gain), written by term and falling gain, from documents and the terms (term) asked for; and how
    many documents have terms."""
    spark = docs.sparkSession
    found = stash(_postings(docs, bitmap(asked, "term")), "postings")
    sums = found.filter("term is null").agg(F.sum("tf").alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = sums["N"] or 0, sums["L"] or 0
    # the bitmap lets a few other terms pass
    held = found.join(asked.select("term"), "term")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    df = stash(df.select("term", weight.alias("w"), (1 + F.floor(F.col("df") / block)).alias("blocks")), "weights")
    length = f"(50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L)"
    gain = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {length}))")
    scored = held.join(df.filter("w > 0"), "term").select("term", "doc", "doc_id", gain.alias("gain"), F.pmod(F.xxhash64("doc"), "blocks").alias("block"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_term = scored.repartition(parts, "term", "block").sortWithinPartitions("term", F.desc("gain"))
    return stash(by_term.select("term", "doc", "doc_id", "gain"), "by-term"), n_docs


def _least(sums: DataFrame, k: int) -> DataFrame:
    """(item, least): the k-th largest sum of each item; 1, the least score that is ranked, where it has fewer."""
    best = Window.partitionBy("item").orderBy(F.desc("sum"))
    top = sums.select("item", "sum", F.row_number().over(best).alias("at")).filter(F.col("at") <= k)
    return top.groupBy("item").agg(F.greatest(F.max(F.when(F.col("at") == k, F.col("sum"))), F.lit(1)).alias("least"))


def _bounds(near: DataFrame, wanted: dict[int, tuple[np.ndarray, np.ndarray, int]], k: int) -> DataFrame:
    """(item, doc, sum, most): of fetched postings (bucket, doc, term, gain), for the items {item: (terms, largest gains, cut)}.
    Sums are of gains above the cut, and ``most`` adds what the other lists can still hold. Of each bucket: the documents
    whose ``most`` reaches its k-th sum."""
    held = near.sparkSession.sparkContext.broadcast(wanted)

    def run(part: pa.Table) -> pa.Table:
        term, gain = part.column("term").to_numpy(), part.column("gain").to_numpy()
        doc, at = np.unique(part.column("doc").to_numpy(), return_inverse=True)
        order = np.lexsort((-gain, term))
        term, gain, at = term[order], gain[order], at[order]
        names, first = np.unique(term, return_index=True)
        last = np.append(first[1:], len(term))
        out = [[], [], [], []]
        for item, (terms, caps, cut) in held.value.items():
            place = np.searchsorted(names, terms)
            there = place < len(names)
            there[there] = names[place[there]] == terms[there]
            sums, rest = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            bound = np.minimum(caps, cut)
            for j in np.flatnonzero(there):
                lo, hi = first[place[j]], last[place[j]]
                hi = lo + int(np.searchsorted(-gain[lo:hi], -cut, "left"))  # gains above the cut
                sums[at[lo:hi]] += gain[lo:hi]  # a list holds a document once
                rest[at[lo:hi]] -= bound[j]
            some = np.flatnonzero(sums)
            if len(some):
                s = sums[some]
                most = s + rest[some] + int(bound.sum())
                if len(some) > k:
                    keep = most >= np.partition(s, len(s) - k)[len(s) - k]
                    some, s, most = some[keep], s[keep], most[keep]
                for column, x in zip(out, (np.full(len(some), item), doc[some], s, most)):
                    column.append(x)
        return pa.table([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out], ["item", "doc", "sum", "most"])

    return near.groupBy("bucket").applyInArrow(run, "item long, doc long, sum long, most long")


def candidates(index: DataFrame, wanted: DataFrame, n_docs: int, k: int = K, pairs: int = PAIRS) -> DataFrame:
    """(item, doc): the first two phases."""
    # 1: row_number below a bound is cut in each task before the shuffle
    by_gain = Window.partitionBy("term").orderBy(F.desc("gain"))
    heads = index.withColumn("at", F.row_number().over(by_gain)).filter(F.col("at") <= k)
    heads = stash(heads.select("term", "doc", "gain", "at"), "heads")
    some = wanted.join(heads, "term").groupBy("item", "doc").agg(F.sum("gain").alias("sum"))
    m = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    cut = _least(some, k).join(m, "item").select("item", "least", F.expr("(least - 1) div m").alias("cut"))
    lists = wanted.join(cut, "item").join(heads.filter("at = 1").select("term", F.col("gain").alias("cap")), "term")
    blocks = 1 + wanted.count() // pairs
    lists = stash(lists.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "lists")
    # 2: a list is fetched once, down to the lowest cut of its items, and dealt by documents
    found = []
    for b in range(blocks):
        # about ``pairs`` rows
        rows = lists.filter(F.col("block") == b).select("item", "term", "cap", "cut").toPandas()
        asked = {int(i): (x["term"].to_numpy(), x["cap"].to_numpy(), int(x["cut"].iloc[0])) for i, x in rows.groupby("item")}
        lowest = lists.filter(F.col("block") == b).groupBy("term").agg(F.min("cut").alias("cut"))
        fetched = index.join(lowest, "term").filter("gain > cut").select("doc", "term", "gain")
        bucket = F.pmod(F.xxhash64("doc"), F.lit(1 + n_docs // BUCKET))
        found.append(stash(_bounds(fetched.withColumn("bucket", bucket), asked, k), "bounds"))
    near = reduce(DataFrame.unionByName, found)
    near = near.join(_least(near, k).withColumnRenamed("least", "higher"), "item")
    return near.filter("most >= higher").select("item", "doc")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """(item, item_id, rank, doc, doc_id, score): the k best documents of each row of ``items``. ``doc`` and ``item`` are
    places of rows."""
    wanted = stash(item_terms(items), "items")
    index, n_docs = build_index(docs, wanted.select("term").distinct(), block)
    near = stash(candidates(index, wanted.select("item", "term"), n_docs, k, pairs), "candidates")
    # 3: candidates' postings alone are shuffled, where they are few by a broadcast of their documents
    lists = index.join(near.select("doc").distinct(), "doc", "left_semi")
    exact = near.join(lists, "doc").join(wanted, ["item", "term"])
    exact = exact.groupBy("item", "item_id", "doc", "doc_id").agg(F.sum("gain").alias("score")).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc")
    ranked = exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item", "item_id", F.col("rank").cast("int").alias("rank"), "doc", "doc_id", "score")


def op13_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, cast(count(*) AS BIGINT) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, cast(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
sums AS (SELECT cast(count(*) AS BIGINT) AS N_, cast(sum(n) AS BIGINT) AS L FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, cast(floor(1000 * ln(cast(2 * any_value(N_) + 2 AS DOUBLE) / cast(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs CROSS JOIN sums WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (
  SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_) // L)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id) CROSS JOIN sums GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
