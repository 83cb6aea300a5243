"""Benchmark decontamination with spaced seeds.

A mask picks some of the word positions in a short span and ignores the others, so its hash survives substitutions at
the ignored ones. Items of fewer than SHORT words have masks of four words besides, as few places of five are left in them
when some words are replaced. Of all ways to replace words for which comparing at every offset finds an overlap, the masks
miss none in items of up to 13 words, and 2 of 1,745 and 8 of 4,049 in those of 14 and 15; of longer ones with words
replaced at random they find about 0.97 at the least (tests hold both).
Items that are equal word by word are searched once. Their hashes under every mask are a table, the
test hashes; the documents' hashes are the training hashes, and the two are joined. Each hit names an item and a diagonal
(the item's offset in the document).

A bitmap of the test hashes, of LOOK_BITS bits at most, spares most training hashes the shuffle; of the others, a row of
three numbers each is sent. A hash that many documents hold is split by a salt where the test hashes are too many to be
sent to the tasks. Documents with a true hit, and no others, then send their words.

Overlaps around hits are verified word by word. Along a diagonal, a run is a best-scoring piece (a match counts 1, a
mismatch -MISMATCH) with LEAST_RUN matches at least. Runs of one item on neighbouring diagonals (SHIFT words inserted or
dropped at most) and near each other in the document (WINDOW words between them at most) make a chain. An item is found
in a document if a chain matches ``need(item words)`` of its words: half of them, but 8 at least and 13 at most; items
under 8 words must occur whole, and those under 4 are not searched for. ``span_words`` is the length of the best chain,
so it is never below ``matched_words``.

Defined cases: null and empty texts match nothing, nor do null and empty items; repeated documents return repeated rows,
repeated items one row an item id; a null doc_id or item_id is kept as null; of chains with equal matches the first in
the document is told; other columns are ignored, and kept by ``of_no_leak``; an empty table on either side finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, row_key, rows_without, stash, table
from .text import ALNUM, combine, groups, utf8, words

#: Seeds: 1 is compared, 0 is ignored.
MASKS = ("1101101011", "1110010111", "1011110101", "11111")
SHORT, SHORT_MASKS = 24, ("1111", "1010011")
MISMATCH = 1.5
LEAST_RUN = 5
SHIFT, WINDOW = 8, 16
LOOK_BITS = 1 << 26
#: Parts of a training hash that many documents hold.
SALTS = 16


def need(n: int) -> int:
    return n if n < 8 else max(8, min(13, -(-n // 2)))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` words."""
    return MASKS + SHORT_MASKS if n < SHORT else MASKS


def seeds_of(h: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, int]]:
    """Hashes at every word where a mask fits, mask by mask, and the number of words it spans."""
    for mask in masks:
        yield combine(h, [i for i, x in enumerate(mask) if x == "1"], int(mask, 2)), len(mask)


_ITEMS = "item long, item_id long, words array<long>, seeds array<long>, places array<int>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's words and test hashes; ``item`` is a hash of all its words. Items under 4 words are left out."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        out: list[list] = [[] for _ in types]
        for i, item_id in enumerate(batch.column("item_id").to_pylist()):
            h, _, _, _ = words(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), ALNUM)
            if len(h) < 4:
                continue
            found = [(s, p) for hashes, _ in seeds_of(h, masks_of(len(h))) for p, s in enumerate(hashes)]
            key = combine(h, [0], 7)
            whole = np.bitwise_xor.reduce(combine(key + np.arange(len(key), dtype=np.uint64), [0], 9)) + np.uint64(len(h))
            row = (int(whole.view(np.int64)), item_id, h.view(np.int64), [int(s.view(np.int64)) for s, _ in found], [p for _, p in found])
            for column, value in zip(out, row):
                column.append(value)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in _ITEMS.split(", ")])


def _hits(look, masks: tuple[str, ...]):
    """Of each document the hashes that may be test hashes: (row_key, seed, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = look.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for lo, hi in groups(offsets):
                h, at, _, _ = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                first = np.searchsorted(at, np.arange(hi - lo + 1))
                for s, n in seeds_of(h, masks):
                    i = in_bitmap(bits, s)
                    i = i[at[i] == at[i + n - 1]]
                    if len(i):
                        d = at[i]
                        cells = [keys[lo + d], s[i].view(np.int64), (i - first[d]).astype(np.int32)]
                        yield pa.record_batch([pa.array(c) for c in cells], ["row_key", "seed", "place"])

    return run


_WORDS = "doc_id long, row_key long, words array<long>"


def _worded(wanted):
    """The words of documents whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = in_bitmap(bits, batch.column("row_key").to_numpy(zero_copy_only=False).view(np.uint64))
            if not len(at):
                continue
            batch = batch.take(pa.array(at))
            data, offsets = utf8(batch.column("text"))
            for lo, hi in groups(offsets):
                h, row, _, _ = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                first = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64)))
                own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row_key")]
                yield pa.record_batch([*own, lists], ["doc_id", "row_key", "words"])

    return run


def runs(same: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the best-scoring pieces of matches and mismatches with LEAST_RUN matches (all, if there are fewer)."""
    out, least = [], min(LEAST_RUN, len(same))
    todo = [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        part = same[lo:hi]
        if np.count_nonzero(part) < max(1, least):
            continue
        score = np.concatenate([[0.0], np.cumsum(np.where(part, 1.0, -MISMATCH))])
        end = int(np.argmax(score - np.minimum.accumulate(score)))
        start = int(np.argmin(score[: end + 1]))
        if np.count_nonzero(part[start:end]) >= least:
            out.append((lo + start, lo + end))
            todo += [(lo, lo + start), (lo + end, hi)]
    return sorted(out)


def best_chain(x: np.ndarray, y: np.ndarray, diagonals: list[int]) -> tuple[int, int, int] | None:
    """(matched, first word, words spanned) of the chain with the most matches of item ``x`` in ``y``; None below its need."""
    found = []
    for diagonal in sorted(set(diagonals)):
        lo, hi = max(0, -diagonal), min(len(x), len(y) - diagonal)
        if lo >= hi:
            continue
        same = x[lo:hi] == y[lo + diagonal : hi + diagonal]
        for a, b in runs(same):
            found.append((lo + a + diagonal, lo + b + diagonal, diagonal, np.flatnonzero(same[a:b]) + lo + a))
    found.sort(key=lambda f: f[:3])
    best = None
    chains: list[list] = []
    for f in found:
        # the latest chain that this run continues
        for chain in reversed(chains):
            if abs(f[2] - chain[-1][2]) <= SHIFT and f[0] <= max(c[1] for c in chain) + WINDOW:
                chain.append(f)
                break
        else:
            chains.append([f])
    for chain in chains:
        at = np.unique(np.concatenate([f[3] for f in chain]))
        there = np.unique(np.concatenate([f[3] + f[2] for f in chain]))
        matched = min(len(at), len(there))
        if matched >= need(len(x)) and (best is None or matched > best[0]):
            best = matched, int(there[0]), int(there[-1] - there[0]) + 1
    return best


_FOUND = "doc_id long, row_key long, row long, item long, matched_words int, item_words int, first_word int, span_words int"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    for batch in batches:
        rows = []
        for i, shift in enumerate(batch.column("diagonals").to_pylist()):
            x, y = (batch.column(c)[i].values.to_numpy() for c in ("item_words", "words"))
            best = best_chain(x, y, shift)
            if best:
                rows.append((i, best[0], len(x), best[1], best[2]))
        at = pa.array([r[0] for r in rows], pa.int64())
        own = [batch.column(c).take(at) for c in names[:4]]
        yield pa.record_batch([*own, *[pa.array([r[k] for r in rows], pa.int32()) for k in range(1, 5)]], names)


def _search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, row_key, item_id, matched_words, item_words, first_word, span_words), one for each row of ``docs`` and item id."""
    spark = docs.sparkSession
    texts = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    items = stash(texts.filter("text <> ''").distinct().mapInArrow(_items, _ITEMS), "items")
    named = items.select("item", "item_id").distinct()
    known = stash(items.select("item", "words", "seeds", "places").dropDuplicates(["item"]), "known")
    tests = known.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s"))
    tests = stash(tests.select(F.col("s.seeds").alias("seed"), "item", F.col("s.places").alias("at")), "tests")
    masks = masks_of(known.agg(F.min(F.size("words"))).first()[0] or SHORT)
    look = spark.sparkContext.broadcast(bitmap(tests.select("seed").distinct(), "seed", LOOK_BITS))

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("row_key"), docs["text"].cast("string").alias("text"))
    hits = slim.select("row_key", "text").mapInArrow(_hits(look, masks), "row_key long, seed long, place int")
    hits = hits.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))
    salted = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = hits.join(salted, ["seed", "salt"]).groupBy("row_key", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    near = stash(near, "near")
    wanted = spark.sparkContext.broadcast(bitmap(near.select("row_key").distinct(), "row_key"))
    held = slim.mapInArrow(_worded(wanted), _WORDS).withColumn("row", F.monotonically_increasing_id())
    held = stash(held, "worded")
    sides = near.join(known.select("item", F.col("words").alias("item_words")), "item").join(held, "row_key")
    found = sides.mapInArrow(_verified, _FOUND).join(named, "item")
    # texts that are equal word by word have one id each, or the better of several
    best = F.max(F.struct("matched_words", (-F.col("first_word")).alias("before"), "span_words", "item_words", "doc_id", "row_key"))
    out = found.groupBy("row", "item_id").agg(best.alias("b"))
    return out.select("b.doc_id", "b.row_key", "item_id", "b.matched_words", "b.item_words", (-F.col("b.before")).alias("first_word"), "b.span_words")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    return _search(docs, benchmark).drop("row_key")


def of_no_leak(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found: rows are told apart by id and text, so those without an id,
    or that share one, are judged by their own text."""
    return rows_without(docs, stash(_search(docs, benchmark).select("row_key").distinct(), "leaks"))


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
