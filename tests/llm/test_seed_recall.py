"""What spaced seeds find of the overlaps that comparing at every offset finds, by the length of items."""

import itertools
import random
from collections import Counter

import numpy as np

from helixframe.llm import decontaminate

LENGTHS = (4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 24, 28, 33, 40)


def altered(words, kept, r):
    """The words with all but ``kept`` of them replaced, at random."""
    out = list(words)
    for i in r.sample(range(len(words)), len(words) - kept):
        out[i] = f"z{r.getrandbits(40):x}"
    return out


def test_recall_by_length(spark):
    r = random.Random(17)
    word = lambda: f"w{r.getrandbits(30):x}"
    items, docs, whole = [], [], {}
    for n in LENGTHS:
        for _ in range(60):
            item, words = len(items), [word() for _ in range(n)]
            items.append((item, " ".join(words)))
            for _ in range(3):
                at = [word() for _ in range(r.randrange(3, 30))]
                text = at + altered(words, r.randint(decontaminate.need(n), n), r) + [word() for _ in range(9)]
                # every offset, by words as numbers
                number = {w: i for i, w in enumerate(dict.fromkeys([*words, *text]))}
                x, y = (np.array([number[w] for w in t]) for t in (words, text))
                if decontaminate.best_chain(x, y, list(range(-len(x), len(y)))):
                    whole[len(docs)] = item
                docs.append((len(docs), " ".join(text)))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    of = {item: len(text.split()) for item, text in items}
    there, hit = Counter(of[i] for i in whole.values()), Counter(of[i] for d, i in whole.items() if (d, i) in got)
    assert got <= set(whole.items())
    recall = {n: hit[n] / there[n] for n in LENGTHS}
    assert min(there.values()) > 40
    assert all(recall[n] == 1 for n in LENGTHS if n < 14), recall
    assert all(recall[n] >= 0.93 for n in LENGTHS), recall
    longer = [n for n in LENGTHS if n >= 14]
    assert sum(hit[n] for n in longer) / sum(there[n] for n in longer) > 0.97, recall


def test_every_way_to_replace_words_of_short_items():
    for n in range(8, 14):
        for kept in range(decontaminate.need(n), n + 1):
            for gone in itertools.combinations(range(n), n - kept):
                same = np.ones(n, bool)
                same[list(gone)] = False
                x = np.arange(n)
                if decontaminate.best_chain(x, np.where(same, x, -1 - x), [0]):
                    places = lambda m: [i for i, bit in enumerate(m) if bit == "1"]
                    assert any(same[[p + i for i in places(m)]].all() for m in decontaminate.masks_of(n) for p in range(n - len(m) + 1)), same


def test_a_nine_word_item_with_its_fifth_word_replaced(spark):
    words = [f"word{i}" for i in range(9)]
    docs = spark.createDataFrame([(1, "some text " + " ".join([*words[:4], "other", *words[5:]]) + " and more")], "doc_id long, text string")
    (row,) = decontaminate.find_leaks(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert (row["item_id"], row["matched_words"]) == (7, 8)
