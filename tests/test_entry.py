"""The entry and the command line without the corpus operators, or without a package that they need."""

import subprocess
import sys
from pathlib import Path

from helixframe.__main__ import parser

ROOT = Path(__file__).resolve().parents[1]
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ImportError("no " + name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(sorted(n for n in e.queries() if n.startswith("op") or n == "pipeline"), len(e.oracle_sql()) > 40)
"""


def entry_without(name):
    return subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=ROOT, capture_output=True, text=True)


def test_entry_without_the_subpackage_or_a_package():
    for name in ("corpus_pipeline", "helixframe.llm"):
        done = entry_without(name)
        assert done.stdout.strip() == "[] True" or name not in ("corpus_pipeline", "helixframe.llm"), done.stderr
        assert "left out" not in done.stderr
    if (ROOT / "helixframe" / "llm").is_dir() and (ROOT / "corpus_pipeline.py").exists():
        done = entry_without("regex")
        assert done.stdout.strip() == "[] True" and "left out: no regex" in done.stderr


def test_further_names_of_arguments():
    given = parser().parse_args(["compute-topology", "--distance-threshold", "7", "--min-sequence-separation", "3"])
    assert (given.contact_distance, given.min_separation) == (7.0, 3)
    assert parser().parse_args(["download-structures", "--max-workers", "9"]).download_workers == 9
    assert parser().parse_args(["summarise-occupancy", "--atlas", "a"]).atlas_path == "a"
    assert parser().parse_args(["export-table", "--table", "t", "--output", "o"]).step == "export-table"
