"""Residue numbers that the four columns of a PDB file cannot hold as decimals."""

import pytest

from helixframe import rendered
from helixframe.sources.coordinates import parse_pdb, residue_number

KNOWN = {"9999": 9999, "A000": 10_000, "A00A": 10_010, "ZZZZ": 1_223_055, "a000": 1_223_056, "zzzz": 2_436_111, "-999": -999, "   7": 7}


def test_hybrid_numbers(spark):
    assert {c: residue_number(c) for c in KNOWN} == KNOWN
    rows = spark.createDataFrame([(n,) for n in KNOWN.values()], "seq long").selectExpr("seq", f"{rendered._SEQ} as cell")
    assert {r["cell"]: r["seq"] for r in rows.collect()} == KNOWN


@pytest.mark.parametrize("cell", ["A0", "Ab00", "1A00", "    ", "A-00"])
def test_other_text_is_no_number(cell):
    with pytest.raises(ValueError):
        residue_number(cell)


def test_a_long_chain_is_read():
    line = "ATOM      1  CA  GLY A{}    " + "".join(f"{v:8.3f}" for v in (1, 2, 3)) + "  1.00  0.00"
    _, rows = parse_pdb("\n".join(line.format(c) for c in ("9999", "A000")))
    assert [r[3] for r in rows] == [9999, 10_000] and all(r[-3:] == (1.0, 2.0, 3.0) for r in rows)


def test_rendered_chains_beyond_9999_equal_their_tables(spark, tmp_path):
    spark.range(24, numPartitions=1).selectExpr("119976 + id as vec_id", "0 as label", "array_repeat(0.25f, 4) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["structure_id"]: (r["residue_count"], r["max_resseq"]) for r in rendered.chain_manifest(spark, str(tmp_path)).collect()}
    assert got["s002"] == (2, 10_000) and got["s008"] == (1, 10_000)
    assert not [r["file"] for r in rendered.ingest_failures(spark, str(tmp_path)).collect() if r["file"].endswith(".ent")]
