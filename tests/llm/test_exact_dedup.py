"""Exact dedup against plain Python, with heavy texts dealt in parts and without."""

import hashlib
import random
import re

import pytest

from helixframe.llm import exact_dedup

SCHEMA = "doc_id long, text string, norm string, sha string, deal int, row string"


def rows():
    r = random.Random(3)
    out = [(i, "a  b\tc" if i % 3 == 0 else f"text {r.randrange(150)}", "n", "s", 1, "r") for i in range(900)]
    out += [(i, t, None, None, None, None) for i, t in ((900, None), (901, ""), (902, " "), (903, "\n\t "), (904, "x" * 300_000), (905, "x" * 300_000 + "y"), (906, "x" * 300_000))]
    return out + [(5, out[5][1], "n", "s", 1, "r"), (None, "a b c", "n", "s", 1, "r"), (None, "only null"), (None, "only null"), (907, "ÄÖ  b"), (908, "ÄÖ \x0bb")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, *[None] * (6 - len(x))) for x in rows()], SCHEMA)


def expected():
    norm = [(x[0], re.sub(r"[\x20\x09-\x0D]+", " ", x[1] or "")) for x in rows()]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(order)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seen", [8, 1, 10**9])
def test_content_groups(docs, monkeypatch, seen):
    monkeypatch.setattr(exact_dedup, "SEEN", seen)
    heavy = exact_dedup.heavy_texts(docs.select("doc_id", "text"), 4, 920).collect()
    assert len(heavy) <= 16 and (len(heavy) > 0) == (seen < 10**9)
    got = sorted((tuple(x) for x in exact_dedup.content_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == expected()


def test_drop_copies(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = sorted([x[:2] for x in expected() if x[3]], key=repr)
    found = kept.collect()
    assert sorted([x["doc_id"] for x in found], key=repr) == sorted([x[0] for x in want], key=repr)
    assert {x["norm"] for x in found} == {"n", None}


def test_empty(docs):
    assert exact_dedup.content_groups(docs.limit(0)).count() == 0


def test_native(docs):
    import io
    from contextlib import redirect_stdout

    told = io.StringIO()
    with redirect_stdout(told):
        exact_dedup.content_groups(docs).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", told.getvalue())
