"""Both sides of what decides how rows are sent, and vectors longer than exact sums in single precision."""

import random

import numpy as np
import pytest

from helixframe.llm import ann, mixing, warc

R = random.Random(31)


def test_products_of_long_vectors_are_exact():
    r = np.random.default_rng(1)
    a, b = (r.integers(-127, 128, (40, 4096)).astype(np.float32) for _ in range(2))
    a[0], b[0], b[1] = 127, 127, -127
    assert (ann._products(a, b) == (a.astype(np.int64) @ b.astype(np.int64).T)).all()


def test_nearest_of_long_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=4096)
    v = [(i, [float(x) for x in base + r.normal(scale=1e-4, size=4096)]) for i in range(120)]  # hardly apart
    found = ann.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>"), k=7, every=40).collect()
    m = {i: np.array(x) for i, x in v}
    for q in (0, 40, 80):
        want = sorted((-float(np.cumsum(m[q] * m[i])[-1]), i) for i in m if i != q)[:7]
        got = sorted((x["rank"], x["vec_id"], x["score"]) for x in found if x["query_id"] == q)
        assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in got]


@pytest.mark.parametrize("few", [warc.FEW_DIGESTS, 0])
def test_digests_sent_or_joined(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_DIGESTS", few)
    texts = ["x" * 200, "y" * 99, None, "z" * 150, "ü" * 60]
    pages = [(i, f"http://x/{i}", R.choice(texts)) for i in range(80)] + [(None, None, texts[0]), (3, "again", texts[0])]
    found = warc.decisions(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    low = {}
    for i, _, t in pages:
        if t and len(t.encode()) >= 100 and i is not None:
            low[t] = min(low.get(t, i), i)
    want = []
    for i, u, t in pages:
        first = low.get(t)
        want.append((i, u or "", (t or "").encode(), first if first is not None and i != first else None))
    assert sorted(map(repr, ((x["page_id"], x["url"], bytes(x["payload"]), x["refers_to"]) for x in found))) == sorted(map(repr, want))


@pytest.mark.parametrize("few", [mixing.BROADCAST_ROWS, 0])
def test_rates_sent_or_joined(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", few)
    rows = [(i, "w " * R.randrange(0, 30) or None, R.choice(["a", "b", None, "c"]), 5) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, base long")
    found = mixing.mix_table(docs, seed=4)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 50_000)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, mixing.mix_table(docs, seed=4).collect()))
    assert found.count() == 200 and mixing.mix_documents(docs, seed=4).count() == found.agg({"copies": "sum"}).first()[0]
