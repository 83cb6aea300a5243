"""Counts of relations by blocks of two tiles, against contacts and their counts; no contact is made a row."""

import random

import numpy as np
import pytest

from helixframe import queries
from helixframe.operators import topology


def points(spark):
    r = random.Random(3)
    rows = [("s", c, p, q, *(float(np.float32(r.uniform(0, 1))) for _ in "xyz")) for c, n in (("A", 90), ("B", 40), ("C", 1)) for p, q in enumerate(r.choices(range(-60, 60), k=n))]
    rows.append(("s", "A", 99, 7, None, 0.0, 0.0))
    return spark.createDataFrame(rows, "structure_id string, chain_id string, pos int, seq int, x float, y float, z float")


@pytest.mark.parametrize("tile, cells", [(1, 1), (7, 50), (33, 64), (16_384, 1 << 18)])
def test_blocks_equal_counts_of_contacts(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(topology, "CELLS", cells)
    held = points(spark)
    got = sorted(map(tuple, topology.near_counts(held, 0.45, 3, tile=tile).collect()))
    want = topology.relation_counts(topology.contacts(held, 0.45, 3)).collect()
    assert got == sorted(map(tuple, want)) and {r[1] for r in got} == {"A", "B"}


def test_counts_beyond_an_int(spark):
    told = topology._between_tiles(np.array([0, 1]), np.array([1 << 33, 1 << 33]), np.array([1 << 33, 1 << 33]), [(np.empty(0), np.empty(0))] * 2)
    assert told == (1 << 66, 0)


def test_the_queries_make_no_row_of_a_contact(spark, capsys):
    for query in (queries.psx_counts_join, queries.long_chain_counts):
        query(spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "cell" not in plan and "a_lo" not in plan


def test_no_points(spark):
    assert topology.near_counts(points(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        topology.near_counts(points(spark), separation=0)


@pytest.mark.parametrize("cells", [1, 40, 1 << 18])
def test_a_block_against_its_definition(monkeypatch, cells):
    monkeypatch.setattr(topology, "CELLS", cells)
    g = np.random.default_rng(5)
    for lows, highs in ((40, 40), (12, 60)):
        a, b = ((np.sort(g.integers(at, at + n, 30)).astype(np.int64), *g.random((3, 30), np.float32)) for at, n in ((0, lows), (20, highs)))
        near = sum((x[:, None] - y[None, :]).astype(np.float64) ** 2 for x, y in zip(a[1:], b[1:])) <= 0.2
        i, j = np.nonzero(near & (b[0][None, :] - a[0][:, None] >= 4))
        lo, hi = a[0][i], b[0][j]
        row, col, nested, equal = topology._block_counts(a, b, 0.2, 4)
        same = int(((lo[:, None] == lo) & (hi[:, None] == hi)).sum() - len(lo)) // 2
        assert (nested, equal) == (int(((lo[:, None] < lo) & (hi < hi[:, None])).sum()), same) and len(lo)
        assert row.tolist() == [int((lo == s).sum()) for s in np.unique(a[0])] and col.tolist() == [int((hi == s).sum()) for s in np.unique(b[0])]


def test_pairs_of_one_chain_are_dealt_to_many_tasks(spark):
    found = spark.range(400).selectExpr("'s' AS structure_id", "'A' AS chain_id", "cast(id as int) AS lo", "cast(id + 5 + id % 7 as int) AS hi")
    pairs = topology.contact_relations(found)
    sizes = [n for n in pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    rows = [(r["lo"], r["hi"]) for r in found.collect()]
    want = sum(len({*x, *y}) == 4 for i, x in enumerate(rows) for y in rows[:i])
    assert sum(sizes) == want and len(sizes) > 1 and max(sizes) < 0.8 * want
