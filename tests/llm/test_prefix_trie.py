"""Conversation tries against plain Python, with and without stubs, chains and paths."""

import hashlib
import random
import zlib

import pytest

from helixframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, dig string, n long, top int"


def rows():
    r = random.Random(2)
    texts = ["hi", "Ünï 😀", "", None, "a longer turn " * 3, "x"]
    out = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), -3, 1000]:
        out += [(c, k if r.random() < 0.9 else None, r.choice(["user", "bot", None]), r.choice(texts[:3] if k < 3 else texts)) for k in range(r.randrange(0, 9))]
    shared = [(k, "user", f"s{k}") for k in range(30)]
    for c in range(300, 330):  # copies and near copies that share a long way
        out += [(c, *x) for x in shared] + ([(c, 30, "bot", f"end {c % 4}")] if c % 3 else [])
    out += [(331, k, "bot", f"{k % 5}") for k in range(400)]  # a very long one, and its copy
    out += [(332, k, "bot", f"{k % 5}") for k in range(400)]
    out += [out[0], out[0], (None, 0, "user", "no conversation")]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*x, 1, "d", 2, 3) for x in rows()], SCHEMA).repartition(3)


def brute(data, rebuild):
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            dig = hashlib.sha256((f"{len(role)}:" + role + text).encode()).digest()[:16]
            own.setdefault(c, []).append(((turn is not None, turn or 0, role[:32], text[:32], dig), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    seqs = own
    if rebuild:
        seqs = {}
        for c, v in own.items():
            h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
            seqs[c] = own.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        kids = [p for p in out if len(p) == len(path) + 1 and p[:-1] == path]
        ends = sorted(c for c in nodes[path] if len(seqs[c]) == len(path))
        n = len(nodes[path])
        saved = (n - 1) * len(path[-1][1]) if path else 0
        up = min(nodes[path[:-1]]) if path else None
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out[path] = (min(nodes[path]), len(path), up, n, len(kids), sum(out[k][5] for k in kids) or 1, saved + sum(out[k][6] for k in kids), sha)
    return out


@pytest.mark.parametrize("rebuild, fewest", [(True, 1_000), (True, 12), (False, 1), (False, 200)])
def test_equals_brute_force(spark, table, rebuild, fewest, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    want = brute(rows(), rebuild)
    got = prefix_trie.conversation_trie(table, rebuild, texts=True, fewest=fewest, most=fewest).collect()
    key = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(repr, (tuple(x[k] for k in key) for x in got))) == sorted(map(repr, want.values()))
    said = {(v[0], v[1]): p[-1] for p, v in want.items() if p}
    assert all((x["role"], x["text"]) == said.get((x["conv_id"], x["depth"]), (None, None)) for x in got)


def test_empty(table):
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0


def test_turnless_alone(spark):
    # conversation 1 takes its first turns of 0, which is absent, and none of its own
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = prefix_trie.conversation_trie(spark.createDataFrame([(lone, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(x) for x in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
