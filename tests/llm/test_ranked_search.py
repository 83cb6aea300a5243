"""Ranked search against scoring every document, in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from helixframe.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(held, lengths):
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    vocab = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(3000)]
    docs = [(i, " ".join(r.choices(vocab, k=r.randrange(1, 90)))) for i in range(600)]
    docs += [(600, None), (601, ""), (602, "?! _"), (603, " ".join(r.choices(vocab, k=60_000))), (3, docs[3][1]), (3, docs[3][1]), (None, docs[4][1]), (None, "Ünï w1"), (604, "ÜNÏ ünï W1")]
    items = [(i, " ".join(r.choices(vocab, k=r.randrange(1, 25)))) for i in range(25)]
    items += [(25, None), (26, "no such term"), (27, "Ünï, W1! w1"), (None, docs[7][1]), (28, "w1")]
    more = lambda rows: [(*x, 1, 2, 3, "t") for x in rows]
    return docs, items, spark.createDataFrame(more(docs), "doc_id long, text string, n long, tf long, doc long, term string"), spark.createDataFrame(more(items), "item_id long, text string, item long, k long, doc_id long, term string")


@pytest.mark.parametrize("k, block, pairs", [(50, 100_000, 1 << 20), (3, 7, 40), (1, 1, 100), (10_000, 50, 1 << 20)])
def test_equals_scoring_everything(tables, k, block, pairs, monkeypatch):
    monkeypatch.setattr(ranked_search, "BUCKET", 50)
    docs, items, d, i = tables
    found = ranked_search.rank_documents(d, i, k, block, pairs).collect()
    assert sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in found), key=repr) == brute(docs, items, k)


def test_phases_prune(tables):
    docs, items, d, i = tables
    wanted = ranked_search.item_terms(i)
    index, n_docs = ranked_search.build_index(d, wanted.select("term").distinct())
    near = ranked_search.candidates(index, wanted.select("item", "term"), n_docs, 3).count()
    assert 3 * 25 <= near < wanted.join(index, "term").select("item", "doc").distinct().count() / 2


def test_repeated_items_and_empty_tables(spark, tables):
    docs, items, d, i = tables
    twice = i.filter("item_id = 5").union(i.filter("item_id = 5"))
    found = ranked_search.rank_documents(d, twice, 4).collect()
    assert Counter(x["rank"] for x in found) == {1: 2, 2: 2, 3: 2, 4: 2}
    assert ranked_search.rank_documents(d.limit(0), i).count() == 0
    assert ranked_search.rank_documents(d, i.limit(0)).count() == 0
