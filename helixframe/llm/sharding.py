"""Sharding by balanced label propagation. Law ``rows``: row counts of shards differ by one at most.

Nodes are distinct texts, weighing the rows that hold them. Nodes are linked through hubs, the minimum hashes of their
five-word shingles under several hash functions, so that near copies share hubs, and no pair is ever made. A node that
shares no hub is unlinked. Labels are shards. Linked nodes start at a hash of their first hub, others at a hash of their
own.

In each round, hubs count the weight of each label among their nodes, and nodes ask for the label with the most votes of
all their hubs together; a node of a label above its capacity (the mean of the shards) asks for the best other one, if its
hubs know any. All votes count. They are added up once for each distinct set of hubs, of which near copies share few, and
a node needs the two best labels of its set alone. The flows between labels are held to quotas: what two shards exchange is granted, and above that as much as the target has
room for; of an overfull label no more than its excess. A hash decides which movers are granted. Only the table of flows,
shards squared at most, reaches the driver. Rounds go on while they lower the weight of cut links (of pairs that a hub
links, by hub) by TOLERANCE of all links at least; the best labels count.

A row's shard is its label. Only a label's surplus moves: rows above the shard's final size, unlinked ones first, then
near copies, and repeated texts last, are dealt to shards below theirs. So equal texts are parted only in labels
that have more repeated rows than the shard holds, one group of them or its last, and near copies only by the surplus. Ranks come from a
range sort over all columns, so no group makes a task large.

Defined cases: null text has size 8, crc 0, and is apart from the empty text; repeated rows take a slot each; null ids
come first within their text; other columns are ignored, and kept by ``with_shards``; an empty table gives no rows; fewer
rows than shards leave some shards empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh_dir, stash, table
from .text import SPACED, combine, groups, mix, utf8, words

HUBS = 3
TOLERANCE = 0.002
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)) for i in range(HUBS)]
_FACTS = "doc_id long, uid long, size long, crc long, node long, " + ", ".join(f"hub{k} long" for k in range(HUBS))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row size, crc, node (a digest of the text) and hubs."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        null = np.asarray(batch.column("text").is_null())
        n = batch.num_rows
        crc, node, hubs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((HUBS, n), np.int64)
        has = np.zeros(n, bool)
        for i in range(n):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            crc[i] = zlib.crc32(raw)
            salt = b"null" if null[i] else b""
            node[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=salt).digest(), "little", signed=True)
        for lo, hi in groups(offsets):
            h, row, _, _ = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], SPACED)
            s = combine(h, range(5))
            if len(s):
                d = row[: len(s)]
                whole = d == row[4:]
                s, d = s[whole], d[whole]
                at, first = np.unique(d, return_index=True)
                has[lo + at] = True
                for k, salt in enumerate(_SALTS):
                    if len(at):
                        hubs[k, lo + at] = np.minimum.reduceat(mix(s ^ salt), first).view(np.int64)
        own = [pa.array(np.diff(offsets) + 8), pa.array(crc), pa.array(node), *[pa.array(x, mask=~has) for x in hubs]]
        yield pa.record_batch([batch.column("doc_id"), batch.column("uid"), *own], [x.split()[0] for x in _FACTS.split(", ")])


def _granted(flows: list, load: dict[int, int], capacity: float) -> list[tuple[int, int, bool, float]]:
    """The part of each flow (label, want, forced, w) that quotas admit. Forced flows leave a label above its capacity."""
    flow = {(r["label"], r["want"]): r["w"] for r in flows if not r["forced"]}
    left = {k: w - min(w, flow.get((k[1], k[0]), 0)) for k, w in flow.items()}
    asked: dict[int, float] = {}
    for (_, to), w in left.items():
        asked[to] = asked.get(to, 0) + w
    room = {b: max(0.0, capacity - load.get(b, 0)) for b in asked | {r["want"]: 0 for r in flows}}
    out = []
    for (a, b), w in flow.items():
        share = min(1.0, room[b] / asked[b]) if asked[b] else 0.0
        out.append((a, b, False, (w - left[a, b] + left[a, b] * share) / w))
    for b, w in asked.items():
        room[b] -= min(room[b], w)
    forced = {(r["label"], r["want"]): r["w"] for r in flows if r["forced"]}
    leaving: dict[int, float] = {}
    for (a, _), w in forced.items():
        leaving[a] = leaving.get(a, 0) + w
    part = {a: min(1.0, max(0.0, load.get(a, 0) - capacity) / w) for a, w in leaving.items()}
    coming: dict[int, float] = {}
    for (a, b), w in forced.items():
        coming[b] = coming.get(b, 0) + w * part[a]
    for a, b in forced:
        out.append((a, b, True, part[a] * (min(1.0, room[b] / coming[b]) if coming[b] else 0.0)))
    return out


def hub_links(facts: DataFrame, within: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, w, hub0, ..., set), links (node, w, hub) through hubs that several nodes share, and (set, hub) of each
    distinct set of such hubs, HUBS at most; written below ``within``. Unlinked nodes have no set."""
    nodes = facts.groupBy("node").agg(F.count(F.lit(1)).alias("w"), *[F.min(f"hub{k}").alias(f"hub{k}") for k in range(HUBS)])
    nodes = stash(nodes, "nodes", within)
    hubs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hub{k}").alias("hub")) for k in range(HUBS)])
    each = nodes.select("node", "w", F.explode(hubs).alias("x")).filter("x.hub is not null")
    each = each.select("node", "w", F.xxhash64("x.k", "x.hub").alias("hub"))
    shared = each.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub")
    links = stash(each.join(shared, "hub"), "hubs", within)
    sets = links.groupBy("node").agg(F.sort_array(F.collect_set("hub")).alias("hubs")).withColumn("set", F.xxhash64("hubs"))
    sets = stash(sets, "sets", within)
    nodes = stash(nodes.join(sets.select("node", "set"), "node", "left"), "nodes", within)
    return nodes, links, stash(sets.select("set", "hubs").distinct().select("set", F.explode("hubs").alias("hub")), "triples", within)


def cut_weight(votes: DataFrame) -> tuple[float, float]:
    """Weights of the cut links and of all, from (hub, label, votes)."""
    v = F.col("votes").cast("double")
    by = votes.groupBy("hub").agg(F.sum(v).alias("all"), F.sum(v * v).alias("same"), F.sum("own").alias("own"))
    one = by.agg(F.sum(F.expr("(all * all - same) / 2")), F.sum(F.expr("(all * all - own) / 2"))).first()
    return one[0] or 0.0, one[1] or 0.0


def _votes(links: DataFrame, labels: DataFrame, within: str) -> tuple[DataFrame, DataFrame]:
    """(node, hub, w, label) and (hub, label, votes, own); own is the sum of the nodes' squared weights."""
    at = links.join(labels.select("node", "label"), "node")
    w = F.col("w").cast("double")
    return at, stash(at.groupBy("hub", "label").agg(F.sum("w").alias("votes"), F.sum(w * w).alias("own")), "votes", within)


def _best_two(told) -> F.Column:
    """Of votes (label, votes), in which labels may repeat: the labels of the two largest sums, the smaller label first in a tie."""
    labels = F.array_distinct(F.transform(told, lambda x: x["label"]))
    none = F.lit(0).cast("long")
    of = lambda label: F.aggregate(F.filter(told, lambda x: x["label"] == label), none, lambda a, x: a + x["votes"])
    sums = F.transform(labels, lambda x: F.struct(of(x).alias("votes"), (-x).alias("after")))
    return F.transform(F.slice(F.sort_array(sums, asc=False), 1, 2), lambda x: (-x["after"]).alias("label"))


def propagate(facts: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[tuple[float, float]]]:
    """(node, hub0, last, label) from rows (node, hub0, ...), and the weights of cut and of all links before each round and
    after the last. ``last`` is 0 for nodes that stand for several rows, 1 for other linked ones, 2 for all else."""
    spark = facts.sparkSession
    work = fresh_dir(spark, "propagation")
    nodes, links, sets = hub_links(facts, work)
    total = nodes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    capacity = total / shards
    start = F.when(F.col("set").isNotNull(), F.xxhash64("hub0")).otherwise(F.xxhash64("node"))
    known = [F.col("set").isNotNull().alias("linked"), F.pmod(start, F.lit(shards)).cast("int").alias("label")]
    every = stash(nodes.select("node", "w", "hub0", "set", *known), "labels", work)
    labels = best = every.filter("linked").select("node", "w", "set", "label")
    cuts: list[tuple[float, float]] = []
    while True:
        at, votes = _votes(links, labels, work)
        cuts.append(cut_weight(votes))
        if len(cuts) > 1 and cuts[-1][0] > cuts[-2][0] - tolerance * cuts[-1][1]:
            best = labels if cuts[-1][0] < cuts[-2][0] else best
            break
        best = labels
        if not cuts[-1][0]:
            break
        load = {r["label"]: r["w"] for r in labels.groupBy("label").agg(F.sum("w").alias("w")).collect()}
        over = [a for a, w in load.items() if w > capacity]
        # a hub has a vote a shard at most, a set the votes of HUBS hubs; written, so that a large hub can be split in the join
        told = stash(votes.groupBy("hub").agg(F.collect_list(F.struct("label", "votes")).alias("told")), "told", work)
        heard = sets.join(told, "hub").groupBy("set").agg(F.flatten(F.collect_list("told")).alias("told"))
        wish = stash(heard.select("set", _best_two(F.col("told")).alias("best")), "heard", work)
        want, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
        own = F.col("label")
        asked = labels.join(wish, "set").withColumns({"want": want, "other": F.when(want == own, second).otherwise(want)})
        asked = asked.withColumn("forced", own.isin(over) & (F.col("want") == own) & F.col("other").isNotNull())
        asked = stash(asked.select("node", "w", "set", "label", "forced", F.when(F.col("forced"), F.col("other")).otherwise(F.col("want")).alias("want")), "wishes", work)
        flows = asked.filter("label <> want").groupBy("label", "want", "forced").agg(F.sum("w").alias("w")).collect()
        if not flows:
            break
        table_ = spark.createDataFrame(_granted(flows, load, capacity), "label int, want int, forced boolean, part double")
        luck = F.pmod(F.xxhash64("node", F.lit(len(cuts))), F.lit(1 << 20)) / float(1 << 20)
        # shards squared rows at most, twice
        moved = asked.join(F.broadcast(table_), ["label", "want", "forced"], "left")
        moves = luck < F.coalesce("part", F.lit(0.0))
        labels = stash(moved.select("node", "w", "set", F.when(moves, F.col("want")).otherwise(F.col("label")).alias("label")), "labels", work)
    to = best.select("node", F.col("label").alias("to"))
    last = F.when(F.col("w") > 1, 0).when(F.col("linked"), 1).otherwise(2).alias("last")
    out = every.join(to, "node", "left")
    out = stash(out.select("node", F.when(F.col("linked"), F.col("hub0")).alias("hub0"), last, F.coalesce("to", "label").alias("label")), "shards")
    discard(spark, work)
    return out, cuts


def _dealt(load: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Of each shard (label, rows of lower labels, final size, surplus rows before its own); sizes differ by one at most, the
    larger ones going to the fullest labels. The largest surplus is dealt first."""
    total = sum(load.values())
    q, r = divmod(total, shards)
    larger = set(sorted(range(shards), key=lambda a: (-load.get(a, 0), a))[:r])
    goal = {a: q + (a in larger) for a in range(shards)}
    surplus, before, at = {a: max(0, load.get(a, 0) - goal[a]) for a in goal}, {}, 0
    for a in sorted(surplus, key=lambda a: (-surplus[a], a)):
        before[a] = at
        at += surplus[a]
    out, start = [], 0
    for a in range(shards):
        out.append((a, start, goal[a], before[a]))
        start += load.get(a, 0)
    return out


def _assigned(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (doc_id, uid, size, crc, node, label, shard, slot) from rows (doc_id, uid, text)."""
    spark = rows.sparkSession
    facts = stash(rows.mapInArrow(_facts, _FACTS), "facts")
    labels, _ = propagate(facts, shards)
    keys = ["label", "last", "hub0", "node", "doc_id", "uid"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = facts.select("doc_id", "uid", "size", "crc", "node").join(labels, "node")
    dealt = named.select(*keys, "size", "crc").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stash(dealt.withColumn("at", F.monotonically_increasing_id()), "order")
    dealt = dealt.withColumn("part", F.shiftright("at", 33)).withColumn("i", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counted = dealt.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("part").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    load = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    goals = _dealt(load, shards)
    plan = spark.createDataFrame(goals, "label int, label_start long, goal long, surplus_start long")
    # where the surplus goes: (first of the surplus rows, shard, its first free slot), for each shard with room, the most first
    gaps, at = [], 0
    for room, a in sorted((load.get(a, 0) - goal, a) for a, _, goal, _ in goals):
        if room < 0:
            gaps.append((at, a, load.get(a, 0)))
            at -= room
    gap = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).alias("shard"), F.lit(n).cast("long").alias("slot")) for k, a, n in gaps or [(0, 0, 0)]])
    # both tables have a row a partition, or a shard
    ranked = dealt.join(F.broadcast(starts), "part").join(F.broadcast(plan), "label")
    ranked = ranked.withColumn("pos", F.expr("start + i - label_start"))
    ranked = ranked.withColumn("over", F.expr("surplus_start + pos - goal"))
    ranked = ranked.withColumn("gap", F.when(F.expr("pos >= goal"), F.array_max(F.filter(gap, lambda g: g["k"] <= F.col("over")))))
    shard = F.coalesce(F.col("gap.shard"), F.col("label")).cast("int")
    slot = F.when(F.col("gap").isNull(), F.col("pos")).otherwise(F.expr("gap.slot + over - gap.k"))
    return ranked.select("doc_id", "uid", "size", "crc", "node", "label", shard.alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, node, label): one a row of ``docs``; label is the shard that propagation chose."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), docs["text"].cast("string").alias("text"))
    none = F.lit(None).cast("int").alias("grown_shard")
    return _assigned(slim, shards).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", none, "node", "label")


def with_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` with columns shard and slot. All columns of ``docs`` are kept; one named shard or slot (in any case) is
    renamed to input_shard or input_slot, with underscores after it while that name is taken too."""
    taken, names = {c.lower() for c in docs.columns} | {"shard", "slot"}, []
    for c in docs.columns:
        new = c
        if c.lower() in ("shard", "slot"):
            new = f"input_{c.lower()}"
            while new in taken:
                new += "_"
            taken.add(new)
        names.append(new)
    packed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = stash(packed.select(F.struct(*packed.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    at = {c: f"row.c{i}" for i, c in enumerate(docs.columns)}
    slim = keyed.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), "uid", F.col(at["text"]).cast("string").alias("text"))
    found = _assigned(slim, shards).select("uid", "shard", "slot")
    return keyed.join(found, "uid").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "shard", "slot")


def op2_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24)
