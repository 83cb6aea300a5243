"""Prefix tries of conversations: what is shared among the openings of many conversations, node by node.

Turns are numbered by a range-partitioned sort, so that a conversation of any length is dealt to many tasks, and stand for
their role and text by a digest of 128 bits. Conversations of equal turns are counted as one sequence with copies.

Sequences are dealt to tasks by the digest of their first turn, many first turns a task, and each task builds pointer
dictionary tries: a dictionary a node, from digest to child. Children are made after their parents, so the reverse is a
postorder, by which sums over subtrees are added without recursion. A first turn with more turns below it than a task
should hold is cut off there, as a stub: its sequences go on to the place where the first of them part, or one ends, and
are dealt again by their next turn, and so on. One sequence alone below a stub is a chain, whose numbers are expressions
of each turn. At the end stubs gather the sums of what hangs below them, the deepest first.

A node's digest of members is of one string, which is in order by definition; strings of some thousand ids each are made
in many tasks, and one task a node hashes these as they come.

Defined cases: a null role or text is empty; turns are ordered by turn with null first, then by the first characters of
role and text and by digest, so repeated rows are repeated turns; rows without conv_id are no conversation; an empty
conversation, as rebuilding may leave, is a member of the root. No conversations give no rows. Other columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, stash, table

#: Turns below a first turn up to which one task builds them, by the share of a task but between these.
FEWEST, MOST = 1_000, 200_000
#: Ids in a piece of the string that is hashed for a node.
PIECE = 4_096
HEADS, EVERY = 6, 100
_BUILT = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long, top boolean, stub binary"
_NODES = [x.split()[0] for x in _BUILT.split(", ")]


def _parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _short(*parts) -> F.Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)), 1, 16)


def numbered_turns(conversations: DataFrame, within: str) -> DataFrame:
    """(conv_id, pos, role, text, dig, chars, before): turns from 0, with the code points of all earlier turns; written below ``within``."""
    spark = conversations.sparkSession
    role, text = [F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text")]
    own = [conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text")]
    rows = conversations.select(*own).filter("conv_id is not null")
    dig = _short(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumns({"r": F.left("role", F.lit(32)), "t": F.left("text", F.lit(32)), "dig": dig, "chars": F.length("text").cast("long")})
    order = ["conv_id", F.col("turn").asc_nulls_first(), "r", "t", "dig"]
    rows = rows.repartitionByRange(_parts(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, before = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, chars = batch.column("conv_id").to_numpy(), batch.column("chars").to_numpy()
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            size = np.diff(np.append(first, len(ids)))
            at = np.arange(len(ids)) - np.repeat(first, size)
            sums = np.concatenate([[0], np.cumsum(chars)])
            earlier = sums[:-1] - np.repeat(sums[first], size)
            if ids[0] == conv:
                at[: size[0]] += pos
                earlier[: size[0]] += before
            conv, pos, before = ids[-1], at[-1] + 1, earlier[-1] + chars[-1]
            own = [batch.column(c) for c in ("conv_id", "part", "role", "text", "dig", "chars")]
            yield pa.record_batch([*own, pa.array(at), pa.array(earlier)], ["conv_id", "part", "role", "text", "dig", "chars", "pos", "before"])

    kinds = "conv_id long, part int, role string, text string, dig binary, chars long, pos long, before long"
    local = stash(rows.select("conv_id", "part", "role", "text", "dig", "chars").mapInArrow(run, kinds), "local", within)
    ends = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "part", F.sum("n").over(earlier).alias("n"), F.sum("c").over(earlier).alias("c")).filter("n is not null")
    # a conversation that goes on in another partition: one a partition at most
    out = local.join(F.broadcast(carried), ["conv_id", "part"], "left")
    out = out.withColumns({"pos": F.expr("pos + coalesce(n, 0)"), "before": F.expr("before + coalesce(c, 0)")})
    return stash(out.select("conv_id", "pos", "role", "text", "dig", "chars", "before"), "turns", within)


def rebuilt_turns(turns: DataFrame, within: str) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n) and their turns (conv_id, pos, dig, chars, rest, from_id, from_pos): of conversation c the
    first h turns of c - c % 100, then its own after its first h; h is the CRC-32 of c's digits modulo 6. ``rest`` is the
    code points from this turn to the last."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sums = turns.withColumn("h", h).groupBy("conv_id", "h").agg(
        F.count(F.lit(1)).alias("own"), F.sum("chars").alias("all"), F.sum(F.when(F.col("pos") < F.col("h"), F.col("chars")).otherwise(0)).alias("head")
    )
    sums = stash(sums.withColumn("base", F.expr(f"conv_id - conv_id % {EVERY}")), "sums", within)
    # at most 100 conversations take at most 5 turns of a base
    lent = turns.filter(f"conv_id % {EVERY} = 0 and pos < {HEADS - 1}").select(F.col("conv_id").alias("base"), "pos", "dig", "chars", "before")
    taken = sums.join(lent, "base").filter("pos < h")
    span = Window.partitionBy("conv_id")
    taken = taken.withColumns({"taken": F.count(F.lit(1)).over(span), "end": F.max(F.expr("before + chars")).over(span)})
    taken = stash(taken, "taken", within)
    first = taken.select("conv_id", "pos", "dig", "chars", F.expr("end - before + `all` - head").alias("rest"), F.col("base").alias("from_id"), F.col("pos").alias("from_pos"))
    lengths = sums.join(taken.groupBy("conv_id").agg(F.max("taken").alias("taken")), "conv_id", "left").na.fill(0, ["taken"])
    lengths = stash(lengths.withColumn("n", F.expr("taken + greatest(own - h, 0)")), "lengths", within)
    rest = turns.join(lengths, "conv_id").filter("pos >= h")
    rest = rest.select("conv_id", F.expr("pos - h + taken").alias("pos"), "dig", "chars", F.expr("`all` - before").alias("rest"), F.col("conv_id").alias("from_id"), F.col("pos").alias("from_pos"))
    return lengths.select("conv_id", "n"), stash(first.union(rest), "rebuilt", within)


def own_turns(turns: DataFrame, within: str) -> tuple[DataFrame, DataFrame]:
    """The same for conversations as they are."""
    sums = stash(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all")), "sums", within)
    out = turns.join(sums, "conv_id")
    out = out.select("conv_id", "pos", "dig", "chars", F.expr("`all` - before").alias("rest"), F.col("conv_id").alias("from_id"), F.col("pos").alias("from_pos"))
    return sums.select("conv_id", "n"), stash(out, "rebuilt", within)


def sequences(convs: DataFrame, turns: DataFrame, within: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, rep) of each conversation, and (rep, n, copies) of each distinct sequence; rep is its smallest conversation."""
    marks = turns.groupBy("conv_id").agg(*[F.expr(f"bit_xor(xxhash64({k}L, pos, dig))").alias(f"m{k}") for k in (1, 2)])
    marked = convs.join(marks, "conv_id", "left").na.fill(0, ["m1", "m2"])
    marked = stash(marked, "marks", within)
    key = ["n", "m1", "m2"]
    same = stash(marked.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sequences", within)
    return marked.join(same, key).select("conv_id", "rep"), same.select("rep", "n", "copies")


def member_digests(members: DataFrame) -> DataFrame:
    """(rep, sha): SHA-256 of the ids of a sequence's conversations, ascending, joined by commas."""
    parts = _parts(members.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, ids = batch.column("rep").to_numpy(), batch.column("conv_id").to_pylist()
            cuts = np.append(np.flatnonzero(np.diff(rep, prepend=rep[0] - 1)) if len(rep) else [], len(rep)).astype(int)
            spans = [(a, min(a + PIECE, hi)) for lo, hi in zip(cuts[:-1], cuts[1:]) for a in range(lo, hi, PIECE)]
            at = [a for a, _ in spans]
            yield pa.record_batch([pa.array(rep[at]), pa.array([ids[a] for a in at], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans])], ["rep", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda x: pa.record_batch([pa.array([r for r, _ in x], pa.int64()), pa.array([s for _, s in x], pa.string())], ["rep", "sha"])
        now, state, out = None, None, []
        for batch in batches:
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if rep != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = rep, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield told(out)
            out = []
        if state:
            yield told([(now, state.hexdigest())])

    made = members.repartitionByRange(parts, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").select("rep", "conv_id")
    made = made.mapInArrow(pieces, "rep long, first long, ids string")
    return made.repartition(parts, "rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(digest, "rep long, sha string")


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of some first turns: rows (top, stub, stub_low, at, rep, copies, pos, dig, chars)."""
    rows = rows.sort_values(["rep", "pos"], kind="stable")
    tops: dict[bytes, int] = {}
    below: list[dict[bytes, int]] = []
    made = [[] for _ in range(7)]  # depth, smallest member, parent, members, code points, sequence that ends, stub
    depth, low, parent, count, size, end, stub = made
    last, node = None, -1
    for top, of, of_low, rep, copies, pos, dig, chars in zip(*[rows[c].tolist() for c in ("top", "stub", "stub_low", "rep", "copies", "pos", "dig", "chars")]):
        if rep != last:
            if last is not None:
                end[node] = last
            last, children, up, up_low = rep, tops, -1, of_low
            key = top
        else:
            children, up, up_low, key = below[node], node, low[node], dig
        found = children.get(key)
        if found is None:
            found = children[key] = len(below)
            below.append({})
            for column, value in zip(made, (pos + 1, rep, (up, up_low), 0, chars, None, of if up < 0 else None)):
                column.append(value)
        node = found
        count[node] += copies
    if last is not None:
        end[node] = last
    n = len(below)
    leaves, saved = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (count[i] - 1) * size[i]
        up = parent[i][0]
        if up >= 0:
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    columns = (depth, low, [p[1] for p in parent], count, [len(b) for b in below], leaves, saved, pd.array(end, "Int64"), [p[0] < 0 for p in parent], stub)
    return pd.DataFrame(dict(zip(_NODES, columns)))


def prefix_trie(convs: DataFrame, turns: DataFrame, within: str, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """A row a node (see ``_BUILT``; end_sha for its own members) of conversations (conv_id, n) and turns (conv_id, pos, dig, chars, rest)."""
    spark = convs.sparkSession
    members, found = sequences(convs, turns, within)
    digests = stash(member_digests(members), "digests", within)
    seq = stash(found, "sequences", within)
    total, low, rows = seq.agg(F.sum("copies"), F.min("rep"), F.sum("n")).first()
    if not total:
        return spark.createDataFrame([], _BUILT + ", ends_sha256 string")
    limit = max(fewest, min(most, (rows or 0) // (2 * _parts(spark))))
    kept = stash(turns.join(seq.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "rep"), "kept", within)
    root = F.unhex(F.lit("00"))
    active = seq.withColumns({"stub": root, "stub_low": F.lit(low).cast("long"), "at": F.lit(0).cast("long")})
    # a stub: its key, that of the stub above, depth of its node, and the path of its sequences up to there
    levels = [spark.range(1).select(root.alias("top"), F.lit(None).cast("binary").alias("stub"), F.lit(None).cast("long").alias("stub_low"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("to"), F.lit(low).cast("long").alias("low"), F.lit(total).cast("long").alias("members"))]
    built, ended = [], []
    while True:
        ended.append(active.filter("n = at").select("stub", F.col("rep").alias("end")))
        going = active.filter("n > at").join(kept.select("rep", F.col("pos").alias("at"), "dig"), ["rep", "at"])
        going = stash(going.withColumn("top", _short(F.col("stub"), F.col("dig"))).drop("dig"), "going", within)
        sized = going.groupBy("top", "stub", "stub_low", "at").agg(F.sum(F.col("n") - F.col("at")).alias("size"), F.count(F.lit(1)).alias("k"), F.sum("copies").alias("members"), F.min("rep").alias("low"))
        sized = stash(sized, "sized", within)
        small, large = sized.filter(F.col("size") <= limit), sized.filter(F.col("size") > limit)
        held = small.agg(F.sum("size")).first()[0] or 0
        ahead = kept.withColumnRenamed("pos", "p")
        each = ahead.join(going, "rep").filter("p >= at")
        if held:
            one = each.join(small.select("top"), "top", "left_semi").withColumn("task", F.pmod(F.xxhash64("top"), F.lit(1 + 2 * held // limit)))
            one = one.select("task", "top", "stub", "stub_low", "rep", "copies", F.col("p").alias("pos"), "dig", "chars")
            built.append(stash(one.groupBy("task").applyInPandas(lambda x: build_tries(x), _BUILT), "built", within))
        alone = large.filter("k = 1").select("top")
        chain = each.join(alone, "top", "left_semi")
        isfirst, islast = F.col("p") == F.col("at"), F.col("p") + 1 == F.col("n")
        numbers = {
            "depth": F.col("p") + 1, "conv_id": F.col("rep"), "parent_conv_id": F.when(isfirst, F.col("stub_low")).otherwise(F.col("rep")), "n_convs": F.col("copies"),
            "n_children": F.when(islast, 0).otherwise(1).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.expr("(copies - 1) * rest"),
            "end": F.when(islast, F.col("rep")), "top": isfirst, "stub": F.when(isfirst, F.col("stub")),
        }
        built.append(stash(chain.select(*[v.alias(k) for k, v in numbers.items()]), "chains", within))
        parting = large.filter("k > 1")
        if parting.isEmpty():
            break
        seen = each.join(parting.select("top", "k"), "top").groupBy("top", "k", "p").agg(F.count(F.lit(1)).alias("c"), F.min("dig").alias("a"), F.max("dig").alias("b"))
        to = seen.groupBy("top").agg(F.coalesce(F.min(F.expr("case when c < k or a <> b then p end")), F.max("p") + 1).alias("to"))
        level = stash(parting.join(to, "top").select("top", "stub", "stub_low", "at", "to", "low", "members"), "stubs", within)
        levels.append(level)
        names = level.select("top", F.col("to"), F.col("low"))
        active = stash(going.drop("stub", "stub_low", "at").join(names, "top").select("rep", "n", "copies", F.col("top").alias("stub"), F.col("low").alias("stub_low"), F.col("to").alias("at")), "active", within)
    union = lambda x: reduce(DataFrame.unionByName, x)
    nodes, ends = union(built), stash(union(ended), "ended", within)
    hung = nodes.filter("top").groupBy("stub").agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    hung, paths = stash(hung, "hung", within), []
    for level in reversed(levels):
        summed = level.join(hung.withColumnRenamed("stub", "top"), "top", "left").na.fill(0, ["children", "leaves", "saved"])
        summed = summed.join(ends.withColumnRenamed("stub", "top"), "top", "left")
        below = kept.select(F.col("rep").alias("low"), F.col("pos").alias("to"), F.col("rest").alias("after"))
        summed = stash(summed.join(below, ["low", "to"], "left").na.fill(0, ["after"]), "summed", within)
        if level is levels[0]:
            break
        path = kept.select(F.col("rep").alias("low"), "pos", "rest").join(summed, "low").filter("pos >= at and pos < to")
        isfirst, islast = F.col("pos") == F.col("at"), F.col("pos") + 1 == F.col("to")
        numbers = {
            "depth": F.col("pos") + 1, "conv_id": F.col("low"), "parent_conv_id": F.when(isfirst, F.col("stub_low")).otherwise(F.col("low")), "n_convs": F.col("members"),
            "n_children": F.when(islast, F.col("children")).otherwise(1), "n_leaves": F.greatest(F.col("leaves"), F.lit(1)),
            "saved_tokens": F.expr("saved + (members - 1) * (rest - after)"), "end": F.when(islast, F.col("end")), "top": isfirst, "stub": F.when(isfirst, F.col("stub")),
        }
        path = stash(path.select(*[v.alias(k) for k, v in numbers.items()]), "paths", within)
        paths.append(path)
        more = path.filter("top").select("stub", F.lit(1).cast("long").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        hung = stash(hung.unionByName(more).groupBy("stub").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]), "hung", within)
    top = {
        "depth": F.lit(0).cast("long"), "conv_id": F.col("low"), "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.col("members"), "n_children": F.col("children"),
        "n_leaves": F.greatest(F.col("leaves"), F.lit(1)), "saved_tokens": F.col("saved"), "end": F.col("end"), "top": F.lit(False), "stub": F.lit(None).cast("binary"),
    }
    every = union([nodes, *paths, summed.select(*[v.alias(k) for k, v in top.items()])])
    none = hashlib.sha256().hexdigest()
    return every.join(digests.withColumnRenamed("rep", "end"), "end", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(none))).drop("sha")


def conversation_trie(conversations: DataFrame, rebuild: bool = True, texts: bool = False, **how) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one a node; with ``texts``
    also the role and text of its last turn."""
    within = fresh_dir(conversations.sparkSession, "trie")
    numbered = numbered_turns(conversations, within)
    convs, turns = (rebuilt_turns if rebuild else own_turns)(numbered.drop("role", "text"), within)
    out = prefix_trie(convs, turns, within, **how)
    out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if not texts:
        return out
    at = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "from_id", "from_pos")
    said = numbered.select(F.col("conv_id").alias("from_id"), F.col("pos").alias("from_pos"), "role", "text")
    return out.join(at, ["conv_id", "depth"], "left").join(said, ["from_id", "from_pos"], "left").drop("from_id", "from_pos")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_transform(string_split(cast(conv_id AS VARCHAR), ''), lambda x: cast(ascii(x) AS BIGINT)),
             lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT c.conv_id, 0 AS half, o.pos, o.text, o.dig FROM convs c JOIN own o ON o.conv_id = c.base WHERE o.pos < h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.text, o.dig FROM convs c JOIN own o ON o.conv_id = c.conv_id WHERE o.pos >= h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS d, length(text) AS chars, dig FROM parts),
seqs AS (SELECT conv_id, list(dig ORDER BY d) AS digs FROM turns GROUP BY conv_id),
paths AS (
  SELECT conv_id, 0 AS d, '' AS node, 0 AS chars FROM convs
  UNION ALL SELECT t.conv_id, t.d, md5(array_to_string(s.digs[1:t.d], ',')), t.chars FROM turns t JOIN seqs s USING (conv_id)),
deepest AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT node, d, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         coalesce(string_agg(cast(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE n = d), '') AS ends
  FROM paths p JOIN deepest USING (conv_id) GROUP BY node, d),
ups AS (SELECT n.node, p.node AS above, p.d AS above_d FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d),
parents AS (SELECT u.node, m.conv_id AS parent_conv_id, u.above FROM ups u JOIN nodes n ON n.node = u.node AND u.above_d = n.d - 1 JOIN nodes m ON m.node = u.above),
kids AS (SELECT above AS node, count(*) AS n_children FROM parents GROUP BY above),
subtrees AS (
  SELECT u.above AS node, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM ups u JOIN nodes n ON n.node = u.node LEFT JOIN kids k ON k.node = u.node GROUP BY u.above)
SELECT n.conv_id, cast(n.d AS BIGINT) AS depth, p.parent_conv_id, cast(n.n_convs AS BIGINT) AS n_convs, cast(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
       cast(s.n_leaves AS BIGINT) AS n_leaves, cast(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN parents p ON p.node = n.node LEFT JOIN kids k ON k.node = n.node JOIN subtrees s ON s.node = n.node
"""
