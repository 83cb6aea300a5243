"""Counts of one long chain beyond a bigint are told, and those that fit are bigint."""

from decimal import Decimal

import numpy as np

from helixframe import queries
from helixframe.operators import topology


def test_counts_beyond_a_bigint_are_told(spark):
    n = 6 << 30
    rows = [("s", "A", t, n, n, 0, 0, 0, [], []) for t in (0, 1)]
    tiled = spark.createDataFrame(rows, f"structure_id string, chain_id string, {topology._TILED.replace(':', ' ')}")
    kinds = "structure_id string, chain_id string"
    got = topology.narrowed(topology._added(tiled, topology.CHAIN, kinds, wide=True)).first()
    assert got["contact_count"] == 2 * n and got["series_pair_count"] == Decimal(n) * n > 1 << 63
    assert got["contact_pair_count"] == Decimal(2 * n) * (2 * n - 1) / 2


def test_nested_pairs_beyond_a_bigint():
    ends = [np.array([2, 3]), np.array([2])]
    cells = [(ends[0], np.array([0, 1 << 33])), (ends[1], np.array([1 << 33])), (np.empty(0), np.empty(0)), (np.empty(0), np.empty(0))]
    zero = np.zeros(4, np.int64)
    assert topology._between_tiles(np.arange(4), zero, zero, cells) == (0, 1 << 66)


def test_counts_that_fit_are_bigint(spark):
    got = queries.long_chain_counts(spark, "/root/testdata/sf0.001")
    assert {k for c, k in got.dtypes if c != "chain_id"} == {"bigint"}
