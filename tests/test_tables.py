"""Versioned tables, routed writes, and counts taken by the write itself."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from helixframe.operators.atlas import route_atlas
from helixframe.plans import steps
from helixframe.schemas import ATLAS, DOMAIN_MAPPING, JOIN_FAILURES, names
from helixframe.sources import tables

from test_fixtures import folder  # noqa: F401  (a fixture)


def plan(df):
    told = io.StringIO()
    with redirect_stdout(told):
        df.explain("formatted")
    return told.getvalue()


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("name", ["t", "t.csv"])
def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path, name):
    path, schema = str(tmp_path / name), "id long, x double, s string"
    rows = lambda n: spark.range(n).selectExpr("id", "id / 3.0D + 1234 as x", "IF(id % 2 = 0, '', 'a,\"b') as s")
    assert tables.put(rows(100), path) == {"rows": 100}
    reader = tables.get(spark, path, schema)
    broken = spark.range(0, 400, 1, 8).selectExpr("id", "IF(id = 399, raise_error('midway'), 1.0D) as x", "'new' as s")
    seen = []

    def during(batches):
        for batch in batches:
            yield batch

    with pytest.raises(Exception, match="midway"):
        tables.put(broken.mapInArrow(during, broken.schema), path)
    seen.append(tables.get(spark, path, schema).count())
    assert seen == [100] and reader.count() == 100 and reader.filter("s = 'new'").isEmpty()
    # a version made of the one before it; readers of that go on
    assert tables.put(tables.get(spark, path, schema).filter("id < 40"), path)["rows"] == 40
    assert reader.count() == 100 and tables.get(spark, path, schema).count() == 40
    first = tables.get(spark, path, schema).orderBy("id").first()
    assert (first["x"], first["s"]) == (1234.0, None)
    back = tables.get(spark, path, schema).filter("id = 4").first()
    assert back["x"] == 1235.333333
    if name.endswith(".csv"):
        assert tables.read_csv(spark, path, schema).count() == 40
        assert tables.read_csv(spark, path, schema).filter("id = 4").first()["x"] == 1235.333333


def test_a_view_is_switched_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long"
    tables.put(spark.range(5), path)
    tables.publish(spark, "helixframe_t", path, schema)
    tables.put(spark.range(7), path)
    assert spark.table("helixframe_t").count() == 5
    tables.publish(spark, "helixframe_t", path, schema)
    assert spark.table("helixframe_t").count() == 7
    for n in range(4):
        tables.put(spark.range(n), path)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2


def test_tables_of_users(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,s\r\n1,\"a\nb\"\r\n2,\r\n")
    assert [tuple(r) for r in tables.get(spark, str(tmp_path / "one.csv"), "id long, s string").collect()] == [(1, "a\nb"), (2, None)]
    tables.put(spark.range(0).selectExpr("id", "'' as s"), str(tmp_path / "none.csv"))
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), "id long, s string").count() == 0
    assert "id,s" in "".join(p.read_text() for p in (tmp_path / "none.csv").glob("part*"))


def test_export_is_one_file(spark, tmp_path):
    tables.put(spark.range(0, 1000, 1, 8), str(tmp_path / "t"))
    step = steps.export_table(spark, str(tmp_path / "t"), str(tmp_path / "t.one.csv"))
    lines = (tmp_path / "t.one.csv").read_text().split()
    assert step.code == 0 and lines[0] == "id" and sorted(map(int, lines[1:])) == list(range(1000))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("t.one.csv.")]


def test_steps_have_no_single_task(spark):
    rows = spark.range(0, 1000, 1, 8)
    assert "Coalesce" not in plan(tables.as_written(rows))
    domain = spark.range(50).selectExpr("'d' || id as domain_id", "'s' || id % 7 as structure_id", "IF(id % 5 = 0, NULL, 'A') as chain_id", "1 as residue_start", "2 as residue_end", "60 as domain_length", "'bacteria' as kingdom", "'a.1' as scope_id", "'' as cath_id", "'' as ecod_id")
    top = spark.range(5).selectExpr("'s' || id as structure_id", "'A' as chain_id", "0.5D as s_fraction", "0.25D as p_fraction", "0.25D as x_fraction", "id as pos")
    both = route_atlas(domain.select(names(DOMAIN_MAPPING)), top)
    assert plan(both).count("Join (") + plan(both).count("Join LeftOuter") <= 2 and "Coalesce" not in plan(both)
    found, counts = tables.routes(both, "route", ["hit", "miss"], {"hit": names(ATLAS), "miss": names(JOIN_FAILURES)})
    assert counts == {"hit": found["hit"].count(), "miss": found["miss"].count()} and sum(counts.values()) == 50
    for name, df in found.items():
        assert df.columns == names({"hit": ATLAS, "miss": JOIN_FAILURES}[name])
        assert "PartitionFilters: [isnotnull(route" in plan(df) and "Join" not in plan(df)


def test_a_mapping_reads_each_input_once(spark, folder, tmp_path):  # noqa: F811
    mapping, seen = steps.watched_mapping(spark, folder)
    scans = [x for x in plan(mapping).split("\n") if "Location:" in x and folder in x]
    # the header line of one of the files is looked up before its rows are; records of JSON have been written by then
    assert sorted(x.rpartition("/")[2].rstrip("]") for x in scans) == sorted(["scope_cla.txt", "scope_des.txt", "scope_astral_40.fa", "ecod_domains.txt", "ecod_domains.txt"])
    tables.put(mapping, str(tmp_path / "m"))
    told, n = jobs(spark, "told", seen.told)
    assert n == 0 and ("read", "scope domains", 5) in told and ("kingdoms", "unknown", 1) in told


def test_counts_of_what_a_plan_left_out(spark):
    seen = tables.Watched()
    left = seen.watch(spark.range(0), "a", rows=F.count(F.lit(1)))
    right = seen.watch(spark.range(9).withColumnRenamed("id", "k").withColumn("id", F.col("k")), "b", rows=F.count(F.lit(1)), most=F.max("k"))
    assert left.join(right, "id", "left").collect() == []
    assert seen.told() == [("a", "rows", 0), ("b", "rows", 9), ("b", "most", 8)]
