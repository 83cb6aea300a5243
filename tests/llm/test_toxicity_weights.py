"""Scores against the definition of the weights, with rare words that weigh as one in RARE documents does."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import labelled, toxicity

R = random.Random(21)
VOCAB = [f"w{i}" for i in range(300)]


@pytest.mark.parametrize("rare", [1 << 14, 40, 6])
def test_scores_equal_the_definition(spark, monkeypatch, rare):
    monkeypatch.setattr(toxicity, "RARE", rare)
    rows = [(i, " ".join(R.choices(VOCAB, [1 / (k + 1) for k in range(300)], k=R.randrange(5, 60))), int(i % 9 == 0)) for i in range(300)]
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    rows_too = [(2000 + i, f"only{i} {rows[i][1]}") for i in range(20)]
    frame = spark.createDataFrame([x[:2] for x in rows] + rows_too, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "telling_terms", lambda h, row, y: np.empty(0, np.uint64))  # all words weigh alike
    found = {x["doc_id"]: x for x in toxicity.toxicity_scores(frame, labels).collect()}
    texts = {x["doc_id"]: x["text"].split() for x in frame.collect()}
    held, total = Counter(w for t in texts.values() for w in set(t)), len(texts)
    assert rare == 1 << 14 or sum(n < total / rare for n in held.values()) > 30

    def vector(t):
        idf = lambda w: math.log((total + 1) / (max(held[w], total / rare, 1) + 1)) + 1
        v = {w: (1 + math.log(n)) * idf(w) for w, n in Counter(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    of = {i: vector(t) for i, t in texts.items()}
    toxic = {i for i, _, y in rows if y}
    prior = sum(y for *_, y in learned) / len(learned)
    for i, x in found.items():
        cos = {j: sum(a * of[j].get(w, 0) for w, a in of[i].items()) for j, _, _ in learned}
        best = sorted((c for c in cos.values() if c > 0), reverse=True)[:15]
        assert np.allclose([cos[j] for j in x["evidence"]], best, atol=1e-9)
        w = [1 / (1.02 - min(1, cos[j])) for j in x["evidence"]]
        voted = sum(a for a, j in zip(w, x["evidence"]) if j in toxic)
        assert math.isclose(x["score"], (voted + prior) / (sum(w) + 1), abs_tol=1e-6)


def test_an_id_that_occurs_often_is_fetched_once(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("IF(id < 2900, 7L, id) as doc_id", "'text ' || (id % 50) as text")
    labels = spark.createDataFrame([(7, 1), (2950, 0), (2951, 0), (2952, 1)], "doc_id long, quality int")
    fetched = []
    plain = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: fetched.append(out := plain(self)) or out)
    found, totals = labelled.sample(docs, labels, "quality", (10, 10))
    want = [i for i in (7, 2950, 2951, 2952) if zlib.crc32(str(i).encode()) % 5]
    assert found["doc_id"].tolist() == want and sum(t.num_rows for t in fetched) == len(want)
    assert 7 not in want or found.set_index("doc_id")["text"][7] == "text 0"
