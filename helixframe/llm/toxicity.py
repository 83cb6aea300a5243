"""Toxicity by nearest labelled examples, by the exact cosine of weighted TF-IDF vectors over all words.

Every word of a text counts, in documents and examples. Its weight is (1 + log of its frequency) x IDF, the IDF being over
all documents; words that the label does not tell apart (see ``telling_terms``) weigh PLAIN of that, as topic words would
else govern the cosine of long texts. The IDF of a word in n of N documents is log((N + 1) / (max(n, N / RARE, 1) + 1)) + 1:
a word in fewer than one in RARE documents weighs as one in RARE does, which bounds the table of counts; words that no example holds count in a document's length as any other.

The examples' inverted index is cut into blocks of similar examples and posts, for each term and block, the largest weight
in the block. A query sums these bounds by block. The VISITS blocks with the highest bounds are added up first and give a
k-th best cosine; then every block whose bound reaches it. So its K nearest are exact, ties going to the earlier example.
Queries are looked up in batches, so that the sums are matrix products for the terms with the longest postings and a few
passes over arrays for all others.

Neighbours vote with weights falling by cosine distance, each counting for as many labelled rows as it stands for in
its class's sample; a prior of one vote keeps scores calibrated. Evidence is the neighbours' ids, nearest first.
Documents without any word of an example have no neighbours, and score as the examples without words do.

Examples are at most SAMPLE texts a class. Scoring is one pass over the documents, without a shuffle of texts; counting
shuffles a row for each word and part of a task.

Defined cases: null and empty texts hold no words; repeated rows return repeated rows; null ids are kept and not held
out; without labels of both kinds, all scores are the labels' mean, or 0 without any; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_dir, stash, table
from .labelled import held_out, sample
from .text import ALNUM, groups, utf8, words

SAMPLE = (6000, 3000)
K, BLOCK, VISITS = 15, 128, 2
PLAIN, RARE = 1 / 16, 1 << 14
#: Terms posted as whole rows, queries that are looked up together, and texts whose scores a task keeps.
DENSE, QUERIES, KNOWN = 768, 128, 50_000
#: Bytes of texts that are scored together.
LOOKED_UP = 1 << 20
#: Groups of similar examples.
GROUPS = 12
#: A task counts words over so many distinct ones of its texts before it hands them on.
PART = 4_000_000


def _rows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, row, _, _ = words(data, offsets, ALNUM)
    return h, row


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash), and how often each occurs."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (hash, row) and counts of many texts, some at a time."""
    parts = []
    for lo, hi in groups(offsets):
        h, row, count = _distinct(*_rows_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        parts.append((h, (row + lo).astype(np.int32), count.astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64),) * 3


def telling_terms(h: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted hashes of all terms that the label tells apart: in 1 % (4 at least) of a class's examples, four times as usual
    there as in the other, and with a likelihood-ratio statistic above 8."""
    terms, at = np.unique(h, return_inverse=True)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    a = np.bincount(at, weights=y[row], minlength=len(terms))
    b = np.bincount(at, minlength=len(terms)) - a
    p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    all_ = (a + b + 1) / (n1 + n0 + 2)
    g = a * np.log(p / all_) + b * np.log(q / all_) + (n1 - a) * np.log((1 - p) / (1 - all_)) + (n0 - b) * np.log((1 - q) / (1 - all_))
    fit = ((p > 4 * q) & (a >= max(4, n1 / 100))) | ((q > 4 * p) & (b >= max(4, n0 / 100)))
    fit &= g > 8
    return terms[fit]


def unit_rows(row: np.ndarray, count: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Weights of unit TF-IDF vectors, term frequencies by 1 + log."""
    w = (1 + np.log(count)) * weight
    norm = np.sqrt(np.bincount(row, w * w, rows))
    return w / norm[row]


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from each start up to its end."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def alike(row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, usual: np.ndarray) -> np.ndarray:
    """A group number for each example, by a few rounds of means over the usual terms, so that blocks of one group differ in
    their bounds from others. Groups decide speed alone."""
    column = np.full(int(term.max()) + 1 if len(term) else 1, -1)
    usual = usual[usual < len(column)]
    column[usual] = np.arange(len(usual))
    at = column[term]
    full = at >= 0
    x = np.zeros((rows, len(usual)), np.float32)
    x[row[full], at[full]] = weight[full]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    x = unit(x)
    means = x[np.linspace(0, max(0, rows - 1), min(GROUPS, rows)).astype(int)]
    group = np.zeros(rows, np.int64)
    for _ in range(6):
        if not means.size:
            break
        group = (x @ means.T).argmax(1)
        sums = np.zeros_like(means)
        np.add.at(sums, group, x)
        means = np.where(np.bincount(group, minlength=len(means))[:, None] > 0, unit(sums), means)
    return group


class BlockMax:
    """Inverted index over unit vectors, cut into blocks of similar examples.

    ``v`` is a matrix, or (row, term, weight, shape) of what is not zero. Postings stand by term, then block, and each run
    of a term in a block has its largest weight. Terms with the longest postings (DENSE at most) are posted as whole rows,
    so that their part of the sums is a matrix product.
    """

    def __init__(self, v, block: int = BLOCK, dense: int = DENSE):
        row, term, weight, (rows, terms) = v if isinstance(v, tuple) else (*np.nonzero(v), v[np.nonzero(v)], v.shape)
        held = np.bincount(term, minlength=terms)
        self.rows = np.flatnonzero(np.bincount(row, minlength=rows))
        usual = np.flatnonzero(held > len(self.rows) // 100)
        usual = usual[np.argsort(-held[usual], kind="stable")][:dense]
        self.rows = self.rows[alike(row, term, weight, rows, usual)[self.rows].argsort(kind="stable")]
        place = np.zeros(rows, np.int64)
        place[self.rows] = np.arange(len(self.rows))
        at = place[row]
        self.edges = np.append(np.arange(0, len(self.rows), block), len(self.rows))
        self.column = np.full(terms, -1)
        self.column[usual] = np.arange(len(usual))
        column = self.column[term]
        full = column >= 0
        self.full = np.zeros((len(usual), len(self.rows)))
        self.full[column[full], at[full]] = weight[full]
        blocks = len(self.edges) - 1
        self.full_bound = np.maximum.reduceat(self.full, self.edges[:-1], 1) if blocks else np.zeros((len(usual), 0))
        term, at, weight = term[~full], at[~full], weight[~full]
        by = np.lexsort((at, term))
        term, self.at, self.post = term[by], at[by], weight[by]
        key = term.astype(np.int64) * max(1, blocks) + self.at // block
        run = np.flatnonzero(np.diff(key, prepend=-1))
        self.block = self.at[run] // block
        self.bound = np.maximum.reduceat(self.post, run) if len(run) else np.empty(0)
        self.run = np.append(run, len(key))
        self.start = np.searchsorted(term[run], np.arange(terms + 1))

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each of ``n`` query vectors (given as the examples' are), the example numbers and cosines of the ``k`` nearest
        with a positive cosine; ties go to the earlier example."""
        blocks, size = len(self.edges) - 1, len(self.rows)
        if not blocks:
            return [(np.empty(0, np.int64), np.empty(0))] * n
        column = self.column[term]
        full = column >= 0
        q = np.zeros((n, len(self.full)))
        q[row[full], column[full]] = weight[full]
        row, term, weight = row[~full], term[~full], weight[~full]
        lo, hi = self.start[term], self.start[term + 1]
        runs, row, weight = spans(lo, hi), np.repeat(row, hi - lo), np.repeat(weight, hi - lo)
        cell = row * blocks + self.block[runs]
        bound = q @ self.full_bound + np.bincount(cell, weight * self.bound[runs], n * blocks).reshape(n, blocks)
        score = np.zeros((n, size))

        def visit(chosen: np.ndarray) -> None:
            """Add up whole scores of the chosen (query, block) cells."""
            for b in np.flatnonzero(chosen.any(0)):
                i = np.flatnonzero(chosen[:, b])
                score[i, self.edges[b] : self.edges[b + 1]] = q[i] @ self.full[:, self.edges[b] : self.edges[b + 1]]
            live = np.flatnonzero(chosen.ravel()[cell])
            lo, hi = self.run[runs[live]], self.run[runs[live] + 1]
            each = spans(lo, hi)
            to = np.repeat(row[live] * size, hi - lo) + self.at[each]
            score.ravel()[:] += np.bincount(to, np.repeat(weight[live], hi - lo) * self.post[each], n * size)

        # the blocks of the highest bounds give a k-th cosine; then every block whose bound reaches it
        first = np.zeros((n, blocks), bool)
        best = np.argsort(-bound, 1, kind="stable")[:, : max(VISITS, -(-k // max(1, int(np.diff(self.edges).min()))))]
        np.put_along_axis(first, best, True, 1)
        visit(first & (bound > 0))
        kth = np.partition(score, size - k, 1)[:, size - k] if size > k else np.zeros(n)
        visit(~first & (bound > 0) & (bound >= kth[:, None] - 1e-9))
        return [self._best(self.rows, x, k) for x in score]

    @staticmethod
    def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        keep = np.flatnonzero(scores > 0)
        if len(keep) > k:
            keep = keep[scores[keep] >= np.partition(scores[keep], -k)[-k] - 1e-11]
        scores = np.round(scores[keep], 12)
        top = np.lexsort((ids[keep], -scores))[:k]
        return ids[keep[top]], scores[top]


class Model:
    """``known``: sorted hashes of the words of examples, and of all that are not rare; ``weight`` of each, and ``rare`` of
    any other. ``examples``: (row, term, weight) of the y's unit vectors; ``totals``: labelled rows of both kinds."""

    def __init__(self, known, weight, rare: float, examples: tuple, y, ids, totals: tuple[int, int], k: int = K):
        self.known, self.weight, self.rare = known, weight, rare
        self.examples, self.y, self.ids, self.k = examples, y, ids, k
        ones, zeros = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
        self.stands = np.where(y == 1, totals[1] / ones, totals[0] / zeros)
        self.prior = totals[1] / max(1, sum(totals))
        bare = np.bincount(examples[0], minlength=len(y)) == 0
        self.bare = (self.stands[bare & (y == 1)].sum() + self.prior) / (self.stands[bare].sum() + 1)
        self.unit = float(self.stands.min()) if len(y) else 1.0

    @cached_property
    def index(self) -> BlockMax:
        """Made where it is used, so that only the vectors are sent."""
        return BlockMax((*self.examples, (len(self.y), len(self.known))))

    def vote(self, near: np.ndarray, cos: np.ndarray) -> tuple[float, list[int]]:
        if not len(near):
            return self.bare, []
        w = self.stands[near] / (1.02 - np.minimum(cos, 1))
        return float((w[self.y[near] == 1].sum() + self.unit * self.prior) / (w.sum() + self.unit)), self.ids[near].tolist()

    def score(self, data: np.ndarray, offsets: np.ndarray, known: dict[bytes, tuple[float, list[int]]]) -> tuple[np.ndarray, list[list[int]]]:
        """Scores and evidence of each text; ``known`` holds those of texts that the task has met, by a digest of their words."""
        n = len(offsets) - 1
        h, row, count = _distinct(*_rows_of(data, offsets))
        term = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[term] == h
        weight = unit_rows(row, count, np.where(hit, self.weight[term], self.rare), n)
        start = np.searchsorted(row, np.arange(n + 1))
        keys = [blake2b(h[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest() for a, b in zip(start[:-1], start[1:])]
        first = {key: i for i, key in reversed(list(enumerate(keys))) if key not in known}
        new = np.sort(np.fromiter(first.values(), np.int64, len(first)))
        found = {key: known[key] for key in keys if key in known}
        for lo in range(0, len(new), QUERIES):
            part = new[lo : lo + QUERIES]
            at = spans(start[part], start[part + 1])
            to = np.repeat(np.arange(len(part)), start[part + 1] - start[part])[hit[at]]
            at = at[hit[at]]
            for i, near in zip(part, self.index.nearest(to, term[at], weight[at], len(part), self.k)):
                found[keys[i]] = self.vote(*near)
        if len(known) > KNOWN:
            known.clear()
        known.update(found)
        return np.array([found[key][0] for key in keys]), [found[key][1] for key in keys]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold each word, by its hash; how many there are, without one."""
    rows, held, size = 0, [], 0

    def part() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rows += batch.num_rows
        for lo, hi in groups(offsets):
            h, _, _ = _distinct(*_rows_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            held.append(h)
            size += len(h)
            if size > PART:
                yield part()
                held, size = [], 0
    yield part()
    yield pa.record_batch([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], ["h", "n"])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[bytes, tuple[float, list[int]]] = {}
        for batch in batches:
            if isinstance(model, float):
                score, evidence = np.full(batch.num_rows, model), [[]] * batch.num_rows
            else:
                data, offsets = utf8(batch.column("text"))
                score, evidence = np.empty(batch.num_rows), []
                for lo, hi in groups(offsets, LOOKED_UP):
                    score[lo:hi], more = model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], known)
                    evidence += more
            cells = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.record_batch(cells, ["doc_id", "held_out", "score", "evidence"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    seen, totals = sample(docs, labels, "toxic", SAMPLE)
    seen = seen.drop_duplicates("text").reset_index(drop=True)
    y = seen["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return totals[1] / sum(totals) if sum(totals) else 0.0
    h, row, count = _words_of(*utf8(pa.array(seen["text"], pa.large_string())))
    ids = seen["doc_id"].to_numpy()
    del seen
    if not len(h):
        return totals[1] / sum(totals)
    work = fresh_dir(docs.sparkSession, "words")
    counts = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_counter, "h long, n long")
    counts = stash(counts.groupBy("h").agg(F.sum("n").alias("n")), "counts", work)
    total = counts.filter("h is null").first()["n"]
    usual = counts.filter(F.col("h").isNotNull() & (F.col("n") * RARE > total)).toArrow()
    words_, n = usual.column("h").to_numpy().view(np.uint64), usual.column("n").to_numpy()
    discard(docs.sparkSession, work)
    known = np.union1d(words_, h)
    weight = np.full(len(known), max(1.0, total / RARE))
    weight[np.searchsorted(known, words_)] = n
    idf = lambda n: np.log((total + 1) / (n + 1)) + 1
    weight = PLAIN * idf(weight)
    weight[np.searchsorted(known, telling_terms(h, row, y))] /= PLAIN
    term = np.searchsorted(known, h).astype(np.int32)
    vectors = row, term, unit_rows(row, count, weight[term], len(y))
    return Model(known, weight, PLAIN * idf(max(1.0, total / RARE)), vectors, y, ids, totals)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    scored = slim.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double, evidence array<bigint>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def op6_blockmax_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
