"""Label propagation against the same in plain Python, with all votes of all hubs."""

import random
from collections import Counter, defaultdict

import pytest
import xxhash

from helixframe.llm import sharding


def hashed(*values):
    """Spark's xxhash64 of longs, or of (value, "int")."""
    seed = 42
    for v in values:
        raw = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain(facts, shards, tolerance=sharding.TOLERANCE):
    weight, first, members = Counter(), {}, defaultdict(set)
    for node, hubs in facts:
        weight[node] += 1
        first[node] = hubs[0]
        for k, hub in enumerate(hubs):
            if hub is not None:
                members[k, hub].add(node)
    members = {k: v for k, v in members.items() if len(v) > 1}
    of = defaultdict(list)
    for hub, nodes in members.items():
        for n in nodes:
            of[n].append(hub)
    capacity = sum(weight.values()) / shards
    label = {n: hashed(first[n]) % shards for n in of}

    def votes():
        out = {hub: Counter() for hub in members}
        for hub, nodes in members.items():
            for n in nodes:
                out[hub][label[n]] += weight[n]
        return out

    def cut(v):
        all_, own = sum(sum(c.values()) ** 2 for c in v.values()), sum(weight[n] ** 2 for nodes in members.values() for n in nodes)
        same = sum(x * x for c in v.values() for x in c.values())
        return (all_ - same) / 2, (all_ - own) / 2

    cuts, best = [], dict(label)
    while True:
        v = votes()
        cuts.append(cut(v))
        if len(cuts) > 1 and cuts[-1][0] > cuts[-2][0] - tolerance * cuts[-1][1]:
            best = dict(label) if cuts[-1][0] < cuts[-2][0] else best
            break
        best = dict(label)
        if not cuts[-1][0]:
            break
        load = Counter()
        for n, a in label.items():
            load[a] += weight[n]
        wishes, flows = {}, Counter()
        for n, a in label.items():
            heard = sum((v[h] for h in of[n]), Counter())
            ranked = sorted(heard, key=lambda x: (-heard[x], x))
            want, forced = ranked[0], False
            if want == a and load[a] > capacity and len(ranked) > 1:
                want, forced = ranked[1], True
            wishes[n] = want, forced
            if want != a:
                flows[a, want, forced] += weight[n]
        if not flows:
            break
        part = {(a, b, f): p for a, b, f, p in sharding._granted([dict(label=a, want=b, forced=f, w=w) for (a, b, f), w in flows.items()], load, capacity)}
        for n, (want, forced) in wishes.items():
            luck = hashed(n, (len(cuts), "int")) % (1 << 20) / (1 << 20)
            if luck < part.get((label[n], want, forced), 0.0):
                label[n] = want
    return {n: best.get(n, hashed(n) % shards) for n in weight}, cuts


@pytest.mark.parametrize("shards, seed", [(24, 1), (7, 2), (3, 3)])
def test_propagation_equals_plain_python(spark, shards, seed):
    r = random.Random(seed)
    pools = [[[r.getrandbits(62) for _ in range(r.choice([1, 2, 3, 9]))] for _ in range(sharding.HUBS)] for _ in range(60)]
    facts = []
    for node in range(700):
        pool = r.choice(pools)
        hubs = [None] * sharding.HUBS if r.random() < 0.1 else [r.choice(p) for p in pool]
        facts += [(node * 7919 - 10**12, hubs)] * r.choice([1, 1, 1, 2])
    frame = spark.createDataFrame([(n, *h) for n, h in facts], "node long, " + ", ".join(f"hub{k} long" for k in range(sharding.HUBS)))
    found, cuts = sharding.propagate(frame, shards)
    want, want_cuts = plain(facts, shards)
    assert {x["node"]: x["label"] for x in found.collect()} == want
    assert cuts == want_cuts and len(cuts) > 2


def test_many_labels_heard_by_few_hubs(spark):
    """A label that is heavy at none of a node's hubs, but the heaviest in their sum, is wished for."""
    votes = [[(a, 10) for a in range(4)] + [(9, 9)], [(a, 10) for a in range(4, 8)] + [(9, 9)], [(a, 10) for a in range(10, 14)] + [(9, 9)]]
    told = spark.createDataFrame([([x for v in votes for x in v],)], "told array<struct<label:int,votes:bigint>>")
    assert told.select(sharding._best_two(told["told"])).first()[0] == [9, 0]
