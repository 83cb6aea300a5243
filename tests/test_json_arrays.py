"""JSON arrays read in splits of any size against json.loads."""

import json
import random

import pytest

from helixframe.sources import classifications
from helixframe.sources.json_arrays import read_json_array

R = random.Random(6)
ODD = ['a"b', "{", "}", "}{", "[", "\\", 'x\\"}', "é😀", "]}", '"data": [', "", "plain text", "\n\t", '{"data": [{}]}']


def record(i):
    out = {"domain_id": f"{i:04d}A{i % 100:02d}", "pdb_code": f"{i:04d}", "superfamily_id": R.choice(ODD), "note": R.choice(ODD), "n": i}
    if i % 3 == 0:
        out["nested"] = {"data": [{"x": R.choice(ODD)}, {}], R.choice(ODD): [1, [2, {"y": "}"}]]}
    if i % 50 == 7:
        out["long"] = R.choice(ODD) * 400
    return out


DOCS = {
    "bare": [record(i) for i in range(60)],
    "object": {"before": {"data": [{"no": 1}], "x": [{"data": 2}]}, "other": [{"a": 1}, {}], 'k"data': [{"no": 2}], "data": [record(i) for i in range(60)], "after": [{"no": 3}], "z": {"data": [1, 2]}},
    "flat": [{}, 1, "s", [{"inner": 1}], {"a": "}"}, None],
    "empty": {"data": []},
    "none": {"other": [{"a": 1}]},
    "one": {"data": [{"long": "}{" * 900}]},
}


def wanted(doc):
    found = doc if isinstance(doc, list) else doc.get("data", [])
    return [x for x in found if isinstance(x, dict)]


@pytest.mark.parametrize("split", ["777b", "64m"])
@pytest.mark.parametrize("name", DOCS)
def test_any_split_gives_the_records(spark, tmp_path, name, split):
    for indent, ascii in ((None, True), (1, False))[: 2 if name in ("bare", "object") else 1]:
        path = tmp_path / f"{indent}.json"
        path.write_text(json.dumps(DOCS[name], indent=indent, ensure_ascii=ascii) + ("\n" if indent else ""), encoding="utf-8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            frame = read_json_array(spark, str(path))
            got = frame.orderBy("pos").collect()
            if split == "777b" and path.stat().st_size > 10_000:
                assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 4
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [json.loads(r["value"]) for r in got] == wanted(DOCS[name])


def test_files_that_do_not_match(spark, tmp_path):
    text = json.dumps({"data": [record(i) for i in range(20)]})
    for k, cut in enumerate((text[:-5], text[: len(text) // 2], text + '"', '{"data": [{"a": "x')):
        (tmp_path / f"{k}.json").write_text(cut)
    (tmp_path / "whole.json").write_text(text)
    assert {r["file"].rpartition("/")[2] for r in read_json_array(spark, str(tmp_path)).collect()} == {"whole.json"}


def test_cath_needs_no_whole_file(spark, tmp_path):
    import io
    from contextlib import redirect_stdout

    (tmp_path / "c.json").write_text(json.dumps(DOCS["object"]))
    frame, told = classifications.read_cath(spark, str(tmp_path / "c.json")), io.StringIO()
    with redirect_stdout(told):
        frame.explain("formatted")
    assert "wholetext" not in told.getvalue().lower()
    assert sorted(r["domain_id"] for r in frame.collect()) == sorted(r["domain_id"] for r in DOCS["object"]["data"])
