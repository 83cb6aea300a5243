"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import ann, common, decontaminate, jaccard_join, labelled, licenses, mixing, quality, sharding, token_cache, toxicity, warc

DOCS = "doc_id long, text string, source string, lang string, size long, n long, draw string, score double, shard int"
R = random.Random(5)
VOCAB = ["".join(R.choices("abcdefghij", k=R.randrange(2, 8))) for _ in range(400)]
ASCII = {i: i + 32 for i in range(65, 91)}


def prose(n, r=R):
    return " ".join(r.choices(VOCAB, k=n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    base = prose(60, r)
    out = [(i, prose(r.randrange(1, 80), r)) for i in range(40)]
    for i in range(40, 70):  # near copies of one text, and exact ones
        w = base.split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = r.choice(VOCAB)
        out.append((i, " ".join(w)))
    out += [(70, base.upper()), (71, None), (72, ""), (73, " \n\t"), (74, "one two"), (75, "One  two"), (76, prose(30_000, r)), (None, base), (None, None), (5, out[5][1]), (5, out[5][1])]
    return [(i, t, None if k % 11 == 0 else f"s{k % 4}", "en", 1, 2, "x", 0.5, 3) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard_components(docs, rows, empty):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), min(low[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))
    found = jaccard_join.jaccard_components(docs)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == want
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(docs, found).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({d for d, _, c in want if d is not None and d == c}) and kept.count(None) == 2
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_one_of_each_by_row(spark):
    r = random.Random(12)
    a, b, c, d, e = (prose(40, r) for _ in range(5))
    rows = [(1, a), (1, b), (2, a), (4, c), (5, c), (5, d), (5, d)]  # unlinked texts that share an id stay, linked ones go
    rows += [(None, e)] * 3 + [(None, None), (None, None), (None, " "), (7, None), (7, None), (7, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(map(tuple, jaccard_join.one_of_each(docs, jaccard_join.jaccard_components(docs)).collect()))
    want = [(1, a), (1, b), (4, c), (5, d), (None, e), (None, None), (None, None), (None, " "), (7, None), (7, ""), (8, "")]
    assert found == Counter(want)


def test_regions_split_by_pivots(docs, rows, monkeypatch):
    want = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=repr)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=repr) == want


def test_loose_copies_of_one_text(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(1, 4)):
            w[at] = f"x{rng.randint(0, 400)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    low = list(range(len(texts)))
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in linked:
            low[i] = low[j] = min(low[i], low[j])
    assert 1 < len(set(low)) < len(texts)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "WIDER", 2)
    monkeypatch.setattr(jaccard_join, "LARGEST", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == dict(enumerate(low))


def plain_leaks(docs, items):
    """The definition of an overlap, word by word: places of document and item that agree under a mask, without a hash."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    out = []
    for d, text in docs:
        y = split(text)
        for i, item in items:
            x = split(item)
            if len(x) < 4:
                continue
            diagonals = set()
            for m in decontaminate.masks_of(len(x)):
                picked = lambda w, at: tuple(w[at + k] for k, bit in enumerate(m) if bit == "1")  # noqa: B023, E731
                there = defaultdict(list)
                for p in range(len(x) - len(m) + 1):
                    there[picked(x, p)].append(p)
                diagonals |= {q - p for q in range(len(y) - len(m) + 1) for p in there.get(picked(y, q), ())}
            pieces = []
            for g in diagonals:
                places = [k for k in range(len(x)) if 0 <= k + g < len(y)]
                todo = [places]
                while todo:  # the best-scoring piece, then what is left on both sides of it
                    part = todo.pop()
                    least = min(5, len(places))
                    best = (0, None)
                    for lo in range(len(part)):
                        total = 0.0
                        for hi in range(lo, len(part)):
                            total += 1 if x[part[hi]] == y[part[hi] + g] else -1.5
                            if total > best[0] + 1e-9:
                                best = (total, (lo, hi + 1))
                    if best[1] is None:
                        continue
                    lo, hi = best[1]
                    same = [k for k in part[lo:hi] if x[k] == y[k + g]]
                    if len(same) >= least:
                        pieces.append((part[lo] + g, part[hi - 1] + g + 1, g, same))
                        todo += [part[:lo], part[hi:]]
            chains = []
            for piece in sorted(pieces, key=lambda f: f[:3]):
                for c in reversed(chains):
                    if abs(piece[2] - c[-1][2]) <= 8 and piece[0] <= max(f[1] for f in c) + 16:
                        c.append(piece)
                        break
                else:
                    chains.append([piece])
            found = []
            for c in chains:
                there = {k + f[2] for f in c for k in f[3]}
                n = min(len({k for f in c for k in f[3]}), len(there))
                if n >= decontaminate.need(len(x)):
                    found.append((n, -min(there), max(there) - min(there) + 1))
            if found:
                n, first, span = max(found)
                out.append((d, i, n, len(x), -first, span))
    return Counter(out)


def told(found):
    return Counter(tuple(x[c] for c in ("doc_id", "item_id", "matched_words", "item_words", "first_word", "span_words")) for x in found.collect())


def test_decontamination(spark, empty):
    r = random.Random(2)
    items = [(i, prose(n, r)) for i, n in enumerate([40, 25, 16, 12, 9, 6, 4, 3, 200])] + [(50, None), (51, ""), (0, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i, t in items[:7]:
        rows.append((100 + i, f"{prose(30, r)}\n{t.upper()}! {prose(20, r)}"))
        want.add((100 + i, i))
    w = items[0][1].split()
    for k in (5, 13, 21, 29):
        w[k] = "zzz"
    rows.append((200, prose(10, r) + " " + " ".join(w)))  # substitutions
    rows.append((201, " ".join(items[1][1].split()[:15] + ["zzz"] + items[1][1].split()[15:])))  # an insertion
    long = items[8][1].split()
    rows.append((202, " ".join([*long[20:26], "zzz", "yyy", *long[26:34]])))  # two runs side by side
    want |= {(200, 0), (201, 1), (202, 8)}
    rows += [(300 + k, prose(200, r)) for k in range(20)] + [(400, None), (401, ""), (402, items[7][1]), (403, " ".join(items[0][1].split()[:6]))]
    # fragments of one item far apart are no overlap, neither in one stretch nor in two, nor on distant diagonals
    rows.append((404, " ".join([*long[:6], *prose(60, r).split(), *long[66:74]])))
    rows.append((405, " ".join([*long[:6], *prose(2000, r).split(), *long[100:108]])))
    rows.append((406, " ".join([*long[:6], *long[150:157]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_leaks(docs, bench)
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want
    assert all(x["matched_words"] <= x["span_words"] for x in found.collect())
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.of_no_leak(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_equals_definition(spark):
    r = random.Random(21)
    some = lambda n: " ".join(r.choices(VOCAB[:25], k=n))
    items = [(i, some(r.randrange(3, 40))) for i in range(12)]
    items += [(100, items[3][1]), (100, items[3][1]), (None, items[4][1]), (3, items[5][1])]  # ties, repeated and null ids
    docs = []
    for i in range(80):
        w = some(r.randrange(0, 60)).split()
        for _ in range(r.randrange(0, 5)):
            x = r.choice(items)[1].split()
            lo = r.randrange(-(-len(x) // 2))
            part = [r.choice(VOCAB) if r.random() < 0.1 else y for y in x[lo : lo + r.randrange(6, 40)]]
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, " ".join(w)))
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, docs[6][1]), (7, docs[8][1]), (9, None), (9, "")]
    text = "item_id long, text string"
    shared = spark.createDataFrame([(*x, 1, "a", 3) for x in docs], "doc_id long, text string, seed int, words string, item long")
    want = Counter()
    for d, t in docs:  # of an id that names two texts, the better overlap
        best = {}
        for key in plain_leaks([(d, t)], list(dict.fromkeys(items))):
            best[key[1]] = max(best.get(key[1], key), key, key=lambda k: (k[2], -k[4], k[5], k[3]))
        want.update(best.values())
    assert sum(want.values()) > 40
    assert told(decontaminate.find_leaks(shared, spark.createDataFrame(items, text))) == want


def test_decontamination_by_row(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(6)
    items = [(i, prose(20, r)) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaking = [(i, f"{prose(30, r)} {t}", "s") for i, t in [(None, items[0][1]), (1, items[1][1]), (2, items[2][1]), (None, items[3][1])]]
    clean = [(None, prose(50, r), "s"), (1, prose(50, r), "s"), (3, None, None), (None, None, "s"), (4, "", "s")]
    docs = spark.createDataFrame(leaking + clean, "doc_id long, text string, row_key string")
    for few in (100, 0):  # keys are sent to all tasks, or a bitmap of them is
        monkeypatch.setattr(common, "FEW_KEYS", few)
        assert Counter(map(tuple, decontaminate.of_no_leak(docs, bench).collect())) == Counter(clean)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(corpus_pipeline, "table", lambda *_: bench)
            assert Counter(map(tuple, corpus_pipeline.decontamination(spark, docs, "").collect())) == Counter(clean)


def test_sharding(spark, docs, rows, empty):
    found = sharding.shard_documents(docs, 7).collect()
    key = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(key(r[0], r[1]) for r in rows)
    by, load, shards = defaultdict(list), Counter(r["label"] for r in found), defaultdict(set)
    for r in found:
        by[r["shard"]].append(r["slot"])
        shards[r["node"]].add(r["shard"])
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    # no row moves but a label's surplus, and equal texts stay together
    assert sum(r["shard"] != r["label"] for r in found) == sum(max(0, load[a] - len(by[a])) for a in range(7))
    # but for groups in labels with more repeated rows than their shard holds
    copies, of = Counter(r["node"] for r in found), {r["node"]: r["label"] for r in found}
    repeated = Counter(r["label"] for r in found if copies[r["node"]] > 1)
    assert all(len(x) == 1 or repeated[of[n]] > len(by[of[n]]) for n, x in shards.items())
    assert sharding.shard_documents(empty).count() == 0 and sharding.with_shards(empty).count() == 0
    few = sharding.shard_documents(docs.limit(3), 7).collect()
    assert sorted((r["slot"]) for r in few) == [0, 0, 0] and len({r["shard"] for r in few}) == 3


def test_with_shards_keeps_columns(spark, rows):
    names = "doc_id long, text string, shard string, Slot long, input_shard long, uid string, crc long, row int"
    data = [(r[0], r[1], f"old{k}", k, k, "u", 2, 3) for k, r in enumerate(rows)]
    full = sharding.with_shards(spark.createDataFrame(data, names), 7)
    assert full.columns == ["doc_id", "text", "input_shard_", "input_slot", "input_shard", "uid", "crc", "row", "shard", "slot"]
    assert Counter(map(tuple, full.drop("shard", "slot").collect())) == Counter(data)
    assert full.select("shard", "slot").distinct().count() == len(rows)
    plain = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(spark.createDataFrame(data, names), 7).collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in full.collect()} == plain


def test_propagation_lowers_the_cut(spark):
    r = random.Random(31)
    texts = []
    for _ in range(25):  # groups of near copies of many sizes; one is larger than a shard
        base = prose(40, r).split()
        for _ in range(r.choice([1, 1, 2, 3, 9])):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(40)] = r.choice(VOCAB)
            texts.append(" ".join(w))
    texts += [" ".join([*base[:39], x]) for x in VOCAB[:60]] + texts[:30] * 2 + [prose(30, r) for _ in range(150)]
    slim = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "doc_id as uid", "text")
    facts = slim.mapInArrow(sharding._facts, sharding._FACTS)
    found, cuts = sharding.propagate(facts, 6)
    label = {x["node"]: x["label"] for x in found.collect()}
    weight, hubs = Counter(), defaultdict(dict)
    for x in facts.collect():
        weight[x["node"]] += 1
        for k in range(sharding.HUBS):
            if x[f"hub{k}"] is not None:
                hubs[k, x[f"hub{k}"]][x["node"]] = 1

    def cut(of):
        out = 0
        for nodes in hubs.values():
            out += sum(weight[a] * weight[b] for a, b in itertools.combinations(nodes, 2) if of[a] != of[b])
        return out

    everything = cut({n: n for n in label})
    assert cuts[0][1] == everything and min(c for c, _ in cuts) == cut(label) and cut(label) < cuts[0][0]
    by_hash = sum(cut({n: r.randrange(6) for n in label}) for _ in range(5)) / 5
    assert cut(label) < 0.5 * by_hash
    shards = sharding._assigned(slim, 6).collect()
    of, sizes = {}, Counter(x["shard"] for x in shards)
    for x in shards:
        of.setdefault(x["node"], x["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and cut(of) < 0.7 * by_hash


def test_quotas():
    flow = lambda a, b, w, f=False: {"label": a, "want": b, "w": w, "forced": f}
    flows = [flow(0, 1, 100), flow(1, 0, 40), flow(2, 1, 60)]
    part = {(a, b): p for a, b, _, p in sharding._granted(flows, {0: 100, 1: 100, 2: 100}, 110)}
    assert part[1, 0] == 1 and math.isclose(part[0, 1], (40 + 60 * 10 / 120) / 100) and math.isclose(part[2, 1], 10 / 120)
    forced = {(a, b): p for a, b, f, p in sharding._granted([flow(0, 1, 50, True), flow(0, 2, 50, True)], {0: 120, 1: 95, 2: 0}, 100)}
    assert math.isclose(forced[0, 2], 0.2) and math.isclose(forced[0, 1], 0.2 * 5 / 10)  # an excess of 20, and room for 5 in 1
    assert sharding._dealt({0: 5, 2: 1}, 3) == [(0, 0, 2, 0), (1, 5, 2, 3), (2, 5, 2, 3)]


def test_nearest(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[40:90] = v[40]
    data = [(i, v[i].tolist(), "x") for i in range(300)] + [(300, None, "x"), (320, [0.0] * 8, "x"), (340, [float("nan")] * 8, "x"), (360, [None, *[1.0] * 7], "x"), (380, [1.0, 2.0], "x"), (381, [], "x"), (None, v[0].tolist(), "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for x in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    w = v.astype(np.float64)
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        s = (w * w[q]).sum(1)
        want = sorted((-s[i], i) for i in range(300) if i != q)[:20]
        assert [i for _, i in want] == [i for i, _ in found] and np.allclose([-a for a, _ in want], [b for _, b in found], atol=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_with_repeated_ids(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(120, 4)).astype(np.float32)
    data = [(i % 70, v[i].tolist()) for i in range(120)] + [(20, [1.0, 2.0]), (21, [3.0, 4.0]), (21, [3.0, 4.0])]
    want = defaultdict(list)
    for q in sorted({i for i, _ in data if i % 20 == 0}):
        own = min((x for i, x in data if i == q), key=lambda x: (len(x), x))
        for i, x in data:
            if i != q and len(x) == len(own):
                want[q].append((-sum(a * b for a, b in zip(own, x)), i))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    for size in (8192, 7):
        monkeypatch.setattr(ann, "QUERY_BLOCK", size)
        monkeypatch.setattr(ann, "BLOCK", 3 * size)
        got = defaultdict(list)
        for x in ann.nearest(df, 5).orderBy("query_id", "rank").collect():
            got[x["query_id"]].append((x["vec_id"], x["score"]))
        assert set(got) == set(want)
        for q, found in got.items():
            best = sorted(want[q])[:5]
            assert [i for _, i in best] == [i for i, _ in found] and np.allclose([-a for a, _ in best], [b for _, b in found], atol=1e-12)


def test_quality(spark, empty, docs):
    r = random.Random(4)
    good = [(i, prose(r.randrange(20, 90), r) + ".", 1) for i in range(150)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(r.randrange(20, 90), r).split()), 0) for i in range(150, 250)]
    df, labels = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int")
    found = {x["doc_id"]: x for x in quality.quality_scores(df, labels).collect()}
    held = [i for i, x in found.items() if x["held_out"]]
    assert held == [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i]["predicted"] == (i < 150) for i in held) >= 0.95 * len(held)
    assert quality.quality_scores(docs, labels).count() == docs.count() and quality.of_quality(empty, labels).columns == empty.columns
    assert {x["score"] for x in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    net = quality.Net()
    texts = [b"", b"a", b"x" * 5000, bytes(range(256)) * 9]
    whole = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(whole, [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts])
    tail = b"x" * 4000 + b"!!!! $$$$ AAAA"
    assert net.score(np.frombuffer(tail, np.uint8), np.array([0, len(tail)]))[0] != whole[2]  # the end counts


def test_network_equals_its_definition():
    net = quality.Net()
    r = np.random.default_rng(4)
    net.p = {k: r.normal(0, 0.3, v.shape).astype(np.float32) for k, v in net.p.items()}
    texts = [b"", b"x", b"hello world", bytes(r.integers(0, 256, 700, dtype=np.uint8)), b"abc " * 900]

    def plain(text):
        """Every filter at every third byte, the largest in each chunk of windows, and the largest and mean of these."""
        p = {k: v.astype(np.float64) for k, v in net.p.items()}
        n = max(1, -(-max(len(text) - 8, 0) // 3) + 1)
        padded = text + bytes(3 * n + 16)
        out = []
        for i in range(n):
            window = np.concatenate([quality.BYTES[b] for b in padded[3 * i : 3 * i + 8]]).astype(np.float64)
            out.append([sum(window[j] * p["K"][j, f] for j in range(quality.DIM)) for f in range(quality.FILTERS)])
        chunks, lo = [], 0
        while True:
            chunks.append([max(o[f] for o in out[lo : lo + 192]) + p["c"][f] for f in range(quality.FILTERS)])
            if lo + 192 >= n:
                break
            lo += 128
        x = [max(c[f] for c in chunks) for f in range(quality.FILTERS)] + [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)]
        hidden = [max(0.0, sum(x[i] * p["A"][i, j] for i in range(len(x))) + p["a"][j]) for j in range(quality.HIDDEN)]
        return 1 / (1 + math.exp(-sum(h * b for h, b in zip(hidden, p["B"])) - p["b"][0]))

    found = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(found, [plain(t) for t in texts], atol=1e-4)


def test_extra_columns_change_nothing(spark, docs):
    slim, labels = docs.select("doc_id", "text"), spark.createDataFrame([(i, i % 2, i % 2) for i in range(70)], "doc_id long, quality int, toxic int")
    for of in (lambda d: quality.quality_scores(d, labels), lambda d: toxicity.toxicity_scores(d, labels), licenses.scan_licenses):
        assert sorted(map(repr, of(docs).collect())) == sorted(map(repr, of(slim).collect()))
    # null ids are scored and not held out, repeated rows score alike
    found = [x for x in quality.quality_scores(docs, labels).collect()]
    assert sum(x["doc_id"] is None and not x["held_out"] for x in found) == 2
    assert len({x["score"] for x in found if x["doc_id"] == 5}) == 1


def test_warc(spark):
    html = ["<p>" + "é" * 100 + "</p>", "<p>short</p>", None, "", "".join(R.choices("abc \n", k=300_000))]
    pages = [(i, f"http://x/{i}", html[i % 5]) for i in range(23)] + [(3, "http://x/3", html[0]), (None, None, html[0])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    for split in (1 << 20, 777):
        found = warc.round_trip(df, split=split).collect()
        text = {t or "" for t in html}
        want = Counter()
        for i, _, h in pages:
            raw = (h or "").encode()
            low = min(p for p, _, x in pages if p is not None and (x or "") == (h or ""))
            again = len(raw) >= 100 and i != low
            want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", low if again else None] += 1
        assert Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in found) == want
        assert all(bytes(x["payload"]).decode() in text for x in found if x["record_type"] == "response")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ignores_false_magic():
    import gzip

    body = warc.MAGIC + b"noise" + gzip.compress(b"not a record") + warc.MAGIC
    data = b"".join(gzip.compress(warc._record(i, "u", body + bytes([i]), "d", None), 0) for i in range(5))
    read = lambda at, n: data[at : at + n]
    for split in (1, 50, 10_000):
        got = [x for s in range(0, len(data), split) for x in warc._members(read, s, min(s + split, len(data)), len(data))]
        assert [warc.parse(x)["payload"] for x in got] == [body + bytes([i]) for i in range(5)]


def test_toxicity_index_is_exact():
    r = np.random.default_rng(3)
    v = r.random((500, 30)) * (r.random((500, 30)) < 0.1)
    v[100:200] = v[100]
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    queries = np.vstack([v[:60], r.random((5, 30)), np.zeros((1, 30))])
    for dense, visits in ((0, 1), (7, 2), (30, 50)):  # postings alone, both kinds of terms, whole rows alone
        index = toxicity.BlockMax(v, 16, dense)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "VISITS", visits)
            row, term = np.nonzero(queries)
            found = index.nearest(row, term, queries[row, term], len(queries), 15)
        for q, (ids, cos) in zip(queries, found):
            s = np.round(v @ q, 12)
            want = sorted((-s[i], i) for i in range(500) if s[i] > 0)[:15]
            assert np.allclose([-a for a, _ in want], cos, atol=1e-11)
            assert {i for a, i in want if -a > cos[-1] + 1e-9} <= set(ids)
    none = toxicity.BlockMax(np.zeros((3, 4))).nearest(np.array([0]), np.array([1]), np.ones(1), 2, 5)
    assert [len(ids) for ids, _ in none] == [0, 0]


def test_toxicity(spark, docs, empty):
    r = random.Random(8)
    rows = [(i, prose(60, r) + (" vile" if i % 5 == 0 else "") + (" awful" if i % 10 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    df, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(df, labels).collect()
    assert all(x["predicted"] == (x["doc_id"] % 5 == 0) for x in found) and all(0 <= x["score"] <= 1 for x in found)
    assert all(x["evidence"] for x in found if x["predicted"])
    assert toxicity.toxicity_scores(docs, labels).count() == docs.count() and toxicity.toxicity_scores(empty, labels).count() == 0
    assert {x["score"] for x in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_over_all_words(spark):
    r = random.Random(4)
    rows = [(i, prose(r.randrange(5, 60), r), int(i % 9 == 0)) for i in range(300)]  # no word is told apart by the label
    new = [f"only{i} {prose(20, r)}" for i in range(20)]  # with words that no example holds
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    copies = [(1000 + i, t) for i, t, y in learned if y]
    df = spark.createDataFrame([x[:2] for x in rows] + copies + [(2000 + i, t) for i, t in enumerate(new)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {x["doc_id"]: x for x in toxicity.toxicity_scores(df, labels).collect()}
    assert copies and all(found[i]["evidence"][0] == i - 1000 and found[i]["predicted"] for i, _ in copies)
    texts = {x["doc_id"]: x["text"].split() for x in df.collect()}
    df_of = Counter(w for t in texts.values() for w in set(t))

    def vector(t):
        v = {w: (1 + math.log(n)) * (math.log((len(texts) + 1) / (df_of[w] + 1)) + 1) for w, n in Counter(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    of = {i: vector(texts[i]) for i in texts}
    for i, x in found.items():
        cos = {j: sum(a * of[j].get(w, 0) for w, a in of[i].items()) for j, _, _ in learned}
        best = sorted((c for c in cos.values() if c > 0), reverse=True)[:15]
        assert np.allclose([cos[j] for j in x["evidence"]], best, atol=1e-9)
        w = [1 / (1.02 - min(1, cos[j])) for j in x["evidence"]]
        toxic = sum(a for a, j in zip(w, x["evidence"]) if j % 9 == 0)
        prior = sum(y for *_, y in learned) / len(learned)
        assert math.isclose(x["score"], (toxic + prior) / (sum(w) + 1), abs_tol=1e-6)


@pytest.mark.parametrize("few", [token_cache.FEW, 0])
def test_token_cache(spark, docs, rows, empty, tmp_path, monkeypatch, few):
    monkeypatch.setattr(token_cache, "FEW", few)
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, cache = public.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    t = Tokenizer.from_file(path)
    more = spark.createDataFrame([(900, "a<|endoftext|>b", *rows[0][2:]), (901, "日本語 ١٢ ǆ", *rows[0][2:]), (902, "é — “x”   y", *rows[0][2:])], DOCS)
    every = docs.union(more)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in every.collect())
    for _ in range(2):
        found = token_cache.token_counts(every, path, cache).collect()
        assert Counter((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in found) == want and all(x["over_limit"] == (x["n_tokens"] > 1024) for x in found)
    held = spark.read.parquet(cache)
    assert held.count() <= len({(r["doc_id"], r["text"] or "") for r in every.collect()}) + 2  # the second run hit for every text
    assert held.select("digest").distinct().count() == len({r["text"] or "" for r in every.collect()})
    assert token_cache.token_counts(empty, path, str(tmp_path / "none")).count() == 0


def test_both_engines_count_alike():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    whole, fast, special = token_cache._engines(path)
    assert fast is not None
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and token_cache._COMPARED.fullmatch(chr(c))]
    around = ("{}", "a{}b", " {}", "{0}{0} {0}", "1{}2", "'{}", "{}s'{}", "a {}a", "\n{} ", " {} {}", "{}  ", "A{}\t{}Z", "!{}!", "{}'s {}'LL")
    texts = [t.replace("{0}", c).replace("{}", c) for c in known for t in around]
    r = random.Random(17)
    texts += ["".join(r.choices(known, k=r.randrange(1, 80))) for _ in range(3000)]
    texts += ["".join(r.choices([" ", "  ", "\n", "a", "Z", "é", "1", "'", "'s", ".", "\t", "¡"], k=40)) for _ in range(3000)]
    strings = [x.content for x in whole.get_added_tokens_decoder().values()]
    texts += [f"{a}{x}{b}" for x in strings for a in ("", " ", "a", "\n", x) for b in ("", " ", "b", "1", "'s", x)]
    assert strings and all(token_cache._COMPARED.fullmatch(t) for t in texts)
    want = [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert token_cache.count_tokens(texts, path) == want


def test_mixing(spark, docs, rows, empty):
    found = mixing.mix_table(docs).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    assert Counter((x["doc_id"], x["size"]) for x in found) == Counter((r[0], n) for r, n in zip(rows, size))
    sizes = defaultdict(int)
    for r, n in zip(rows, size):
        sizes[r[2]] += n
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size)
    while free:  # share, stop those above, share the rest anew
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    assert {round(x["target"], 6) for x in found} == {round(x, 6) for x in target.values()}
    assert all(x["taken"] <= 2 * x["size"] for x in found)
    rate = {s: target[s] / sizes[s] if sizes[s] else 0.0 for s in names}

    def copies(r):  # the draw, in plain Python
        digest = "" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()
        known = f"0:{'' if r[0] is None else r[0]}:{digest}"
        return int(rate[r[2]]) + (int(hashlib.md5(known.encode()).hexdigest()[:12], 16) < (rate[r[2]] % 1) * 2**48)

    assert Counter((x["doc_id"], x["size"], x["copies"]) for x in found) == Counter((r[0], n, copies(r)) for r, n in zip(rows, size))
    emitted = Counter(map(tuple, mixing.mix_documents(docs).collect()))
    assert emitted == sum((Counter({r: copies(r)}) for r in rows), Counter())
    off = mixing.deviations(docs).collect()
    assert {x["source"] for x in off} == set(names) and sum(x["taken"] for x in off) == sum(x["taken"] for x in found)
    taken = mixing.mix_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(x["copies"] for x in found)
    assert sorted(map(repr, mixing.mix_table(docs).collect())) == sorted(map(repr, found)) and mixing.mix_table(empty).count() == 0


def test_mixing_draws_are_near_their_chance(spark):
    rows = [(i, "a b c", f"s{i % 3}") for i in range(6000)]
    off = mixing.deviations(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 4 * x["expected_deviation"] + 3 for x in off) and any(x["expected_deviation"] for x in off)


def test_licenses(spark, docs, empty):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "MIT license mit License; Mit\nlicense", "cc by cc-by CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0.", "gnu general public", "x" * 50, None, "", "K cc by", "all rights reserved", "İmit license mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in licenses.scan_licenses(df).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[x["doc_id"]] or "").translate(ASCII))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert x["base_labels"] == ",".join(sorted({b for _, b in at})) and set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


def test_license_labels_and_scores(spark):
    r = random.Random(23)
    phrases = [(t.split(), k.split(), label) for t, k, label in licenses.TEMPLATES] + [(k.split(), k.split(), label) for k, label in licenses.BASE.items()]
    bag = sorted({w for t, _, _ in phrases for w in t})
    texts = [None, "", "license", "public domain public domain"]
    for _ in range(150):
        w = r.choices(VOCAB[:30] + bag, k=r.randrange(0, 30))
        for _ in range(r.randrange(0, 4)):
            t, _, _ = r.choice(phrases)
            lo, hi = sorted(r.sample(range(len(t) + 1), 2))
            part = t[lo:hi] if r.random() < 0.4 else t
            w[(at := r.randrange(len(w) + 1)) : at] = [x if r.random() < 0.95 else "other" for x in part]
        texts.append(" ".join(w))
    words = [(t or "").split() for t in texts]
    held = Counter(x for w in words for x in set(w))
    idf = lambda x: math.log((len(texts) + 1) / (held[x] + 1)) + 1
    found = {x["doc_id"]: x for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    some = 0
    for i, w in enumerate(words):
        labels, best = set(), 0.0
        for t, key, label in phrases:
            skip = next(k for k in range(len(t)) if t[k : k + len(key)] == key)
            for p in range(len(w) - len(key) + 1):
                if w[p : p + len(key)] == key:
                    labels.add(label)
                    place = [p - skip + k for k in range(len(t))]
                    inside = sum(idf(x) for x, k in zip(t, place) if 0 <= k < len(w) and w[k] == x)
                    best = max(best, inside / sum(map(idf, t)))
        some += bool(labels)
        assert found[i]["labels"] == ",".join(sorted(labels)) and math.isclose(found[i]["score"], best, abs_tol=1e-9)
    assert some > 60


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(0, 1), (None, 1), (1, None)], "doc_id long, quality int")
    seen, totals = labelled.sample(docs, labels, "quality", (7, 9))
    assert Counter(seen["y"]) == {0: 7, 1: 9} and sum(totals) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100))
