"""The pipeline stage by stage against plainer versions, and the registered queries that have SQL."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from test_operators import ASCII, plain_leaks

import __spark_entry__ as entry
import corpus_pipeline
from helixframe.llm import quality as classifier
from helixframe.llm.common import stash, table

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, source string, shard int, slot string, draw int, row_key long, node string, c0 int, n long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))


def one_a_group(rows):
    """Rows that stay, by comparing all pairs."""
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    low = list(range(len(rows)))
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    best = {}
    for i, r in enumerate(rows):
        best[low[i]] = min(best.get(low[i], r["doc_id"]), r["doc_id"])
    return {r["doc_id"] for i, r in enumerate(rows) if best[low[i]] == r["doc_id"]}


def emitted(rows):
    """Copies of each row, by the definition of targets and of the draw."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    out = Counter()
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        known = f"0:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}"
        draw = int(hashlib.md5(known.encode()).hexdigest()[:12], 16)
        out[r["doc_id"]] += int(rate) + (draw < rate % 1 * 2**48)
    return +out


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF))
        assert docs.columns == columns + ["shard", "slot"] * (name == "sharding")
        seen.append(docs.collect())
    ids = [[r["doc_id"] for r in rows] for rows in seen]
    scored = classifier.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert Counter(ids[1]) == Counter(r["doc_id"] for r in scored.collect() if r["predicted"]) and len(ids[1]) < len(ids[0])
    assert Counter(ids[2]) == Counter(one_a_group(seen[1])) and len(ids[2]) < len(ids[1])
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaking = {d for d, *_ in plain_leaks([(r["doc_id"], r["text"]) for r in seen[2]], items)}
    assert Counter(ids[3]) == Counter(set(ids[2]) - leaking) and leaking
    assert Counter(ids[4]) == emitted(seen[3])
    assert Counter(ids[5]) == Counter(ids[4])
    by = defaultdict(list)
    for r in seen[5]:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 24 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, seen[5]))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    text = " ".join(f"Word{i}, and more of it." for i in range(60))
    texts = [(1, text), (1, text), (2, text + " x"), (3, None), (4, ""), (5, "a"), (None, text), (None, None), (None, None), (6, "z " * 30_000), (7, text.upper())]
    rows = [(i, t, None if k % 3 else "s", k, "old", k, 5, "n", 6, 7) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD)
    kept = stage(spark, docs, SF)
    names = ["input_shard", "input_slot", "shard", "slot"]
    assert kept.columns == (docs.columns if name != "sharding" else [*docs.columns[:3], *names[:2], *docs.columns[5:], *names[2:]])
    found = Counter(tuple(r)[: len(docs.columns)] for r in kept.collect())
    if name != "mixing sources":
        assert found <= Counter(rows)
    assert set(found) <= set(rows) and (found == Counter(rows) or name not in ("sharding", "benchmark decontamination"))
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_oracles(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in entry.llm.oracle_sql().items():
        want = c.execute(sql).df()
        got = entry.queries()[name](spark, SF).toPandas()
        assert sorted(got.columns) == sorted(want.columns), name
        got = got[list(want.columns)]
        whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
        clean = lambda f: sorted(repr([whole(v) for v in r]) for r in f.astype(object).where(f.notna(), None).values.tolist())  # noqa: E731, B023
        assert clean(got) == clean(want), name
