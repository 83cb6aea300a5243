"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes become fixed vectors (character classes and a few random directions). Filters of WIDTH bytes at every STRIDE-th
byte are learned, over the whole document, in overlapping chunks. Each filter is max-pooled in each chunk; the largest
and the mean of its chunk maxima over all chunks are the features, so that long documents weigh no less by their end
than by their start. A hidden layer combines them into one probability.

It is trained on the driver by Adam, on at most SAMPLE labelled texts a class, of any length; the share of the
labels among all labelled rows then corrects the probability for the sample's balance. Scoring is one pass over the
documents without any shuffle.

A score is of its text alone. Before scoring, weights and byte vectors are rounded to multiples of 2**-GRID, and features
and hidden values to multiples of 2**-COARSE, so that every sum has few enough digits to be exact: neither the order of
additions, nor the texts scored beside it, nor the machine can change it.

Defined cases: null and empty texts are scored as a padded empty text; repeated rows return repeated rows; null ids are
kept and not held out; without labels of both kinds all scores are the labels' mean, or 0.5 without any; lang, source
and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import held_out, sample
from .text import groups, utf8

WIDTH, STRIDE, FILTERS, HIDDEN = 8, 3, 24, 16
CHUNK, STEP = 192, 128
SAMPLE = (1200, 1200)
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.3
#: Binary places of weights, and of what later layers take in. Products have GRID + COARSE places, or 2 * GRID for filters,
#: and sums of them stay below 2**17 (of outputs of filters 2**21), so 53 digits hold them.
GRID, COARSE = 16, 20


def _byte_vectors() -> np.ndarray:
    v = np.zeros((256, 10), np.float32)
    b = np.arange(256)
    kinds = [(b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), (b == 32) | ((b >= 9) & (b <= 13)), np.isin(b, [*map(ord, ".,;:!?'\"-()")]), b >= 128]
    for i, k in enumerate(kinds):
        v[k, i] = 1
    rest = (b > 0) & ~np.any(kinds, 0)
    v[rest, 6] = 1
    v[:, 7:] = np.random.default_rng(7).normal(0, 0.5, (256, 3))
    v[0] = 0
    return v


def on_grid(x: np.ndarray, places: int) -> np.ndarray:
    return np.round(x.astype(np.float64) * (1 << places)) / (1 << places)


#: On the grid, and few enough digits for training too.
BYTES = on_grid(_byte_vectors(), GRID).astype(np.float32)
DIM = WIDTH * BYTES.shape[1]


class Net:
    """Filters, hidden layer, and the correction of the log odds."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "K": r.normal(0, DIM**-0.5, (DIM, FILTERS)),
            "c": np.zeros(FILTERS),
            "A": r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)),
            "a": np.zeros(HIDDEN),
            "B": r.normal(0, HIDDEN**-0.5, HIDDEN),
            "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift = 0.0

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Padded bytes of all texts, and where each text's windows start and end among all windows."""
        size = np.diff(offsets)
        n = np.maximum(1, -(-np.maximum(size - WIDTH, 0) // STRIDE) + 1)  # the last window ends with the text or beyond
        room = n * STRIDE + WIDTH + (-WIDTH % STRIDE)
        start = np.concatenate([[0], np.cumsum(room)])
        out = np.zeros(start[-1], np.uint8)
        if len(data):
            out[np.repeat(start[:-1] - offsets[:-1], size) + np.arange(len(data))] = data
        return out, np.stack([start[:-1] // STRIDE, start[:-1] // STRIDE + n])

    def respond(self, padded: np.ndarray) -> np.ndarray:
        """Filter outputs of every window."""
        m = (len(padded) - WIDTH) // STRIDE + 1
        out = np.empty((m, FILTERS), self.p["K"].dtype)
        for lo in range(0, m, 1 << 15):
            hi = min(m, lo + (1 << 15))
            out[lo:hi] = self.gather(padded, np.arange(lo, hi)) @ self.p["K"]
        return out

    @staticmethod
    def gather(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        return BYTES[padded[(at * STRIDE)[:, None] + np.arange(WIDTH)]].reshape(len(at), DIM)

    def rounded(self) -> Net:
        """A network of the same weights, rounded, as numbers whose sums are exact."""
        out = Net()
        out.p, out.shift = {k: on_grid(v, GRID) for k, v in self.p.items()}, self.shift
        return out

    @staticmethod
    def chunks(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each overlapping chunk, and each text's first chunk."""
        n = spans[1] - spans[0]
        count = np.maximum(1, -(-(n - (CHUNK - STEP)) // STEP))
        first = np.concatenate([[0], np.cumsum(count)])
        k = np.arange(first[-1]) - np.repeat(first[:-1], count)
        lo = np.repeat(spans[0], count) + k * STEP
        return lo, np.minimum(lo + CHUNK, np.repeat(spans[1], count)), first

    def features(self, out: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.concatenate([out, np.full((1, FILTERS), -np.inf, out.dtype)])
        top = np.maximum.reduceat(out, np.stack([lo, hi], 1).ravel(), axis=0)[::2] + self.p["c"]
        each = np.diff(first)
        mean = np.add.reduceat(top, first[:-1], axis=0) / each[:, None]
        return np.concatenate([np.maximum.reduceat(top, first[:-1], axis=0), mean], 1), top

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of a ``rounded`` network."""
        if len(offsets) < 2:
            return np.empty(0)
        padded, spans = self.windows(data, offsets)
        x, _ = self.features(self.respond(padded), *self.chunks(spans))
        h = on_grid(np.maximum(on_grid(x, COARSE) @ self.p["A"] + self.p["a"], 0), COARSE)
        z = h @ self.p["B"] + self.p["b"] + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def step(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        padded, spans = self.windows(data, offsets)
        out = self.respond(padded)
        lo, hi, first = self.chunks(spans)
        x, top = self.features(out, lo, hi, first)
        h = np.maximum(x @ self.p["A"] + self.p["a"], 0)
        z = h @ self.p["B"] + self.p["b"]
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        dh = dz[:, None] * self.p["B"] * (h > 0)
        dx = dh @ self.p["A"].T
        each = np.diff(first)
        text = np.repeat(np.arange(len(y)), each)
        dtop = dx[text, FILTERS:] / each[text, None]
        is_top = top == x[text, :FILTERS]
        # overlapping chunks often share their largest window: they share its gradient, too
        dtop += is_top * (dx[:, :FILTERS] / np.add.reduceat(is_top, first[:-1], axis=0, dtype=np.int64))[text]
        at = np.stack([s + out[s:e].argmax(0) for s, e in zip(lo, hi)])
        dK = np.zeros_like(self.p["K"])
        for f in range(FILTERS):
            dK[:, f] = dtop[:, f] @ self.gather(padded, at[:, f])
        return {"K": dK, "c": dtop.sum(0), "A": x.T @ dh, "a": dh.sum(0), "B": h.T @ dz, "b": dz.sum(keepdims=True)}


def train(texts: list[str], y: np.ndarray, totals: tuple[int, int], seed: int = 11) -> Net | float:
    """A network, or one score for all where there is nothing to learn."""
    if len(set(y.tolist())) < 2:
        return totals[1] / sum(totals) if sum(totals) else 0.5
    net, r = Net(seed), np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t, rounds = 0, max(EPOCHS, -(-600 // max(1, len(raw) // BATCH)))
    for epoch in range(rounds):
        order = r.permutation(len(raw))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(raw[j]) for j in part])])
            g = net.step(np.concatenate([raw[j] for j in part]), offsets, y[part].astype(np.float32))
            t += 1
            rate = RATE * (1 - 0.9 * epoch / rounds)
            for k, p in net.p.items():
                d = g[k] + 1e-4 * p
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    net.shift = float(np.log(totals[1] / totals[0]) - np.log(ones / zeros))
    return net.rounded()


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            if isinstance(net, float):
                score = np.full(batch.num_rows, net)
            else:
                data, offsets = utf8(batch.column("text"))
                score = np.empty(batch.num_rows)
                for lo, hi in groups(offsets, 1 << 19):
                    score[lo:hi] = net.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*rest, pa.array(score)], [c for c in batch.schema.names if c != "text"] + ["score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    seen, totals = sample(docs, labels, "quality", SAMPLE)
    net = train(seen["text"].tolist(), seen["y"].to_numpy(), totals)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    scored = slim.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; one pass, and no join."""
    seen, totals = sample(docs, labels, "quality", SAMPLE)
    shared = docs.sparkSession.sparkContext.broadcast(train(seen["text"].tolist(), seen["y"].to_numpy(), totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared)
        for batch in batches:
            text = pa.record_batch([batch.column(batch.schema.get_field_index("text"))], ["text"])
            (scored,) = score(iter([text]))
            yield batch.filter(pa.array(np.asarray(scored.column("score")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
