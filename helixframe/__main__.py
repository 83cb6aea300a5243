"""Command line: ``python -m helixframe STEP ...``. Prints the step's report and exits with its code."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from .config import PipelineConfig
from .plans import steps

_DEFAULTS = PipelineConfig()
#: Arguments of each step: name, and its default below the folder of tables; None where it must be given.
_PATHS = {
    "download-classifications": {"output_dir": "classifications"},
    "build-domain-mapping": {"classifications_dir": "classifications", "output": "domain_mapping.csv"},
    "download-structures": {"domain_mapping": "domain_mapping.csv", "output_dir": "structures"},
    "ingest-structures": {
        "input_dir": None,
        "structure_output": "structure_manifest.csv",
        "chain_output": "chain_manifest.csv",
        "failures_output": "ingest_failures.csv",
        "parsed_path": "parsed",
    },
    "compute-topology": {"chain_manifest": "chain_manifest.csv", "parsed_path": "parsed", "output": "chain_topology_manifest.csv"},
    "build-atlas-table": {
        "chain_topology": "chain_topology_manifest.csv",
        "domain_mapping": "domain_mapping.csv",
        "output": "domain_atlas_table.csv",
        "failures_output": "atlas_join_failures.csv",
    },
    "summarise-occupancy": {"atlas_path": "domain_atlas_table.csv", "output": "occupancy_summary.csv"},
    "export-table": {"table": None, "output": None},
}
#: Parameters that each step takes besides.
_PARAMETERS = {
    "download-classifications": ("registry_timeout_s", "registry_least_ok", "download_workers"),
    "build-domain-mapping": ("min_length", "max_length"),
    "download-structures": ("download_workers", "downloaded_above_bytes", "structure_timeout_s"),
    "ingest-structures": ("more_residues",),
    "compute-topology": ("contact_distance", "min_separation", "representative_atoms", "more_residues"),
    "build-atlas-table": (),
    "summarise-occupancy": ("common_from", "rare_from"),
    "export-table": (),
}
#: Further names of arguments, which other scripts for these steps use.
_ALIASES = {
    "contact_distance": ("--distance-threshold",),
    "min_separation": ("--min-sequence-separation",),
    "download_workers": ("--max-workers",),
    "atlas_path": ("--atlas",),
}


def _options(name: str) -> tuple[str, ...]:
    return "--" + name.replace("_", "-"), *_ALIASES.get(name, ())


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="helixframe", description=__doc__.splitlines()[0])
    todo = out.add_subparsers(dest="step", required=True)
    kinds = {f.name: type(getattr(_DEFAULTS, f.name)) for f in fields(PipelineConfig)}
    for step, paths in _PATHS.items():
        p = todo.add_parser(step)
        p.add_argument("--tables", default=_DEFAULTS.output, help="folder of the tables that are not named")
        for name, default in paths.items():
            p.add_argument(*_options(name), dest=name, required=default is None)
        for name in _PARAMETERS[step]:
            if kinds[name] is tuple:
                p.add_argument(*_options(name), dest=name, nargs="*", default=getattr(_DEFAULTS, name))
            else:
                p.add_argument(*_options(name), dest=name, type=kinds[name], default=getattr(_DEFAULTS, name))
    return out


def run(spark: SparkSession, arguments: list[str]) -> steps.Step:
    given = parser().parse_args(arguments)
    kinds = {n: tuple(v) if isinstance(v, list) else v for n in _PARAMETERS[given.step] for v in [getattr(given, n)]}
    paths = {n: getattr(given, n) or f"{given.tables}/{default}" for n, default in _PATHS[given.step].items()}
    step = getattr(steps, given.step.replace("-", "_"))
    more = {"config": PipelineConfig(output=given.tables, **kinds)} if kinds else {}
    return step(spark, **paths, **more)


def main(arguments: list[str] | None = None) -> int:
    parser().parse_args(arguments)  # wrong arguments end here, before a session starts
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    done = run(spark, sys.argv[1:] if arguments is None else arguments)
    # a report has a row a figure
    for r in done.report.collect():
        print(f"{r['section']}\t{r['key']}\t{'' if r['value'] is None else format(r['value'], 'g')}")
    if done.code:
        print(f"step failed with code {done.code}", file=sys.stderr)
    return done.code


if __name__ == "__main__":
    raise SystemExit(main())
