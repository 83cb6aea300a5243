"""Counts of relations by tiles against definitions, and a chain of a million contacts dealt to many tasks."""

import random

import numpy as np
import pytest

from helixframe.operators import topology


def contacts(spark, chains):
    rows = [("s", c, int(a), int(b)) for c, pairs in chains.items() for a, b in pairs]
    return spark.createDataFrame(rows, "structure_id string, chain_id string, lo int, hi int")


def sample(n, span, seed):
    r = random.Random(seed)
    return [tuple(sorted(r.sample(range(-span // 2, span // 2), 2))) for _ in range(n)]


@pytest.mark.parametrize("tile", [1, 3, 17, 2_048])
def test_tiles_equal_the_join_and_the_kernel(spark, tile):
    chains = {"A": sample(300, 60, 1), "B": sample(150, 12, 2), "C": [(1, 5)], "D": [(1, 5), (1, 5), (5, 9), (2, 4)]}
    found = contacts(spark, chains)
    got = {r["chain_id"]: tuple(r)[2:] for r in topology.relation_counts(found, tile=tile).collect()}
    assert got == {r["chain_id"]: tuple(r)[2:] for r in topology.relation_counts_sql(found).select(*topology.relation_counts(found).columns).collect()}
    for c, pairs in chains.items():
        s, p, x = topology.count_relations(*np.array(pairs).T)
        assert got[c] == (len(pairs), s + p + x, s, p, x)


def test_a_chain_of_a_million_contacts_is_dealt_to_many_tasks(spark):
    n, tile = 1_000_000, 2_048
    found = spark.range(n, numPartitions=8).selectExpr("'s' AS structure_id", "'A' AS chain_id", "cast(id div 10 as int) as lo", "cast(id div 10 + 4 + pmod(xxhash64(id), IF(id % 10 = 0, 40000, 300)) as int) as hi")
    pdf = found.toPandas()
    s, p, x = topology.count_relations(pdf["lo"].to_numpy(), pdf["hi"].to_numpy())
    assert tuple(topology.relation_counts(found, tile=tile).first())[2:] == (n, s + p + x, s, p, x)
    # no group of the first step holds much of the chain, and the last has a row a tile
    of = lambda c: (pdf[c] // tile)
    largest = max((of("lo").value_counts().add(of("hi").value_counts(), fill_value=0)))
    assert of("lo").nunique() > 40 and largest < n / 20


def test_no_contacts(spark):
    assert topology.relation_counts(contacts(spark, {"A": [(1, 5)]}).limit(0)).count() == 0
