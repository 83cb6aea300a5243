"""Queries that start from files: driver tables rendered into each file format, read by the library's own readers and run
through its steps, and the SQL on the tables that they must equal.

``part`` stands in for domains and ``supplier`` for species, with the odd lines that such files hold: comments, missing
fields, padded and over-long regions, repeated ids. ``embeddings`` stands in for residues: a vector's id is split into a
structure and a residue number, its label is the chain, and its first components are coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PipelineConfig
from .operators import occupancy, topology
from .plans import steps
from .schemas import ATLAS, CHAIN_MANIFEST, CHAIN_TOPOLOGY, DOMAIN_MAPPING, DOWNLOAD_FAILURES, JOIN_FAILURES, OCCUPANCY, STRUCTURE_MANIFEST
from .sources import classifications, components, downloads, tables
from .sources.structure_source import read_structures
from .streaming.ingest import ingest_versions, versions

#: Of a part: names shared by the rendering and the SQL. ``k`` is its key, ``z`` its size.
_PDB = "'P' || lpad(cast(k % 300 as string), 3, '0')"
_LETTER = "substr('ABCd0', cast(k % 5 + 1 as int), 1)"
_SCCS = "substr('abcdefg', cast(z % 7 + 1 as int), 1) || '.' || (z % 9) || '.1.1'"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    base = _table(spark, d, "part").selectExpr("p_partkey as k", "p_size as z")
    return base.selectExpr("k", "z", f"{_PDB} as pdb", f"{_LETTER} as chain", f"{_SCCS} as sccs")


_REGION = """CASE k % 8 WHEN 0 THEN chain || ':' WHEN 1 THEN chain || ':-' || (k % 7) || '-' || (60 + z)
    WHEN 2 THEN chain || ':5-' || (50 + z) || ',B:60-99' WHEN 3 THEN '-' WHEN 4 THEN ' ' || chain || ':1-' || (40 + z) || ' '
    WHEN 5 THEN chain || ':10P-80' WHEN 6 THEN '' ELSE chain || ':1-99999999999' END"""
_HIERARCHY = "CASE WHEN k % 10 = 9 THEN 'cl=1' ELSE 'cl=1,sp=' || (k % 60) || ',px=2' END"
_DESCRIPTION = """CASE k % 6 WHEN 0 THEN 'Escherichia coli K-12' WHEN 1 THEN 'Human (Homo sapiens)' WHEN 2 THEN 'Pyrococcus furiosus'
    WHEN 3 THEN 'Unknown' WHEN 4 THEN '' ELSE 'Methanococcus and human' END"""


def _scope_cla(spark: SparkSession, d: str, path: str) -> None:
    rows = _parts(spark, d).selectExpr("k", "z", "pdb", "chain", "sccs", f"{_REGION} as region", f"{_HIERARCHY} as hierarchy")
    last = "concat_ws('\t', 'd' || k, pdb, region, sccs, cast(100000 + k as string), IF(k % 11 = 10, NULL, hierarchy))"
    early = "concat_ws('\t', 'd' || k, 'xxxx', '-', 'z.0.0.0', '1', 'none')"
    lines = rows.selectExpr("k", "1 as n", f"{last} as value").union(rows.filter("k % 13 = 12").selectExpr("k", "0 as n", f"{early} as value"))
    head = spark.range(1).selectExpr("-1L as k", "0 as n", "'# a comment\tof\tmany\tfields\there\tand there' as value")
    tables.write_lines(lines.union(head), path, "k", "n")


def _scope_des(spark: SparkSession, d: str, path: str) -> None:
    rows = _table(spark, d, "supplier").selectExpr("s_suppkey as k")
    line = f"concat_ws('\t', cast(k as string), IF(k % 4 = 3, 'dm', 'sp'), 'a.1', '-', {_DESCRIPTION})"
    tables.write_lines(rows.selectExpr("k", f"{line} as value"), path, "k")


def _fasta(spark: SparkSession, d: str, path: str) -> None:
    rows = _parts(spark, d).filter("k % 9 <> 8")
    record = "'>d' || k || ' ' || sccs || '\n' || repeat('a', 40) || '\n' || repeat('b', cast(z + 3 * (k % 50) as int)) || '  \n'"
    early = rows.filter("k % 17 = 16").selectExpr("k", "0 as n", "'>d' || k || '\na' as value")
    head = spark.range(1).selectExpr("-1L as k", "0 as n", "'no record' as value")
    tables.write_lines(rows.selectExpr("k", "1 as n", f"{record} as value").union(early).union(head), path, "k", "n")


def _cath(spark: SparkSession, d: str, path: str) -> None:
    entry = """named_struct('domain_id', IF(k % 33 = 0, '', lower(pdb) || chain || '01'), 'pdb_code', pdb,
        'superfamily_id', '1.10.' || z, 'atom_length', cast(z as string))"""
    rows = _parts(spark, d).filter("k % 3 = 0").selectExpr("k", f"', ' || to_json({entry}) as value")
    ends = spark.range(2).selectExpr("IF(id = 0, -1L, 9223372036854775807L) as k", """IF(id = 0, '{"note": "a } in \\\\"data\\\\": [", "data": [{}', ']}') as value""")
    tables.write_lines(rows.union(ends), path, "k")


def _ecod(spark: SparkSession, d: str, path: str) -> None:
    cells = "cast(k as string), 'e' || k, '2004.' || z || '.1', IF(k % 28 = 5, '', pdb), chain, 'A:1-95', 'arch', 'x', IF(k % 20 = 1, '', 't')"
    rows = _parts(spark, d).filter("k % 4 = 1").selectExpr("k", f"concat_ws('\t', {cells}) as value")
    names = "uid\tecod_domain_id\tf_id\tpdb\tchain\tpdb_range\tarchitecture_name\tx_name\tt_name"
    head = spark.range(4).selectExpr("id - 4 as k", f"element_at(array('#/version', 'noise\tbefore', '## {names}', '#0\ta comment'), cast(id + 1 as int)) as value")
    tables.write_lines(rows.union(head), path, "k")


_RENDER = {"scope_cla.txt": _scope_cla, "scope_des.txt": _scope_des, "scope_astral_40.fa": _fasta, "cath_domain_list.txt": _cath, "ecod_domains.txt": _ecod}


def _put(files: DataFrame, folder: str, compress: bool = False) -> None:
    tables.write_files(files, folder, compress).write.format("noop").mode("overwrite").save()


def _file(spark: SparkSession, d: str, name: str) -> str:
    path = f"{tables.fresh_dir(spark, 'rendered')}/{name}"
    _RENDER[name](spark, d, path)
    return path


def _folder(spark: SparkSession, d: str) -> str:
    folder = tables.fresh_dir(spark, "rendered")
    for name, render in _RENDER.items():
        render(spark, d, f"{folder}/{name}")
    return folder


def scope_domains(spark: SparkSession, d: str) -> DataFrame:
    return classifications.read_scope_cla(spark, _file(spark, d, "scope_cla.txt")).drop("pos")


def scope_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return classifications.read_scope_des(spark, _file(spark, d, "scope_des.txt"))


def fasta_lengths(spark: SparkSession, d: str) -> DataFrame:
    return classifications.read_fasta_lengths(spark, _file(spark, d, "scope_astral_40.fa"))


def cath_domains(spark: SparkSession, d: str) -> DataFrame:
    return classifications.read_cath(spark, _file(spark, d, "cath_domain_list.txt")).drop("pos")


def ecod_domains(spark: SparkSession, d: str) -> DataFrame:
    return classifications.read_ecod(spark, _file(spark, d, "ecod_domains.txt")).drop("pos")


def domain_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The step's table, as it reads back."""
    folder = _folder(spark, d)
    steps.build_domain_mapping(spark, folder, f"{folder}/domain_mapping.csv")
    # the CSV parts that users get
    return tables.read_csv(spark, f"{folder}/domain_mapping.csv", DOMAIN_MAPPING)


def mapping_report(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, d)
    return steps.build_domain_mapping(spark, folder, f"{folder}/domain_mapping").report


#: Of a vector: structure s, residue number, kind of residue r (0 and 1 and 3 are residues of protein), thousandths of coordinates.
_VECTOR = """vec_id AS v, label % 3 AS label, vec_id % 12 AS s, vec_id {div} 12 + 1 AS seq, vec_id % 5 AS r,
    CAST(floor(CAST({at}[{a}] AS double) * 100000) AS bigint) AS mx, CAST(floor(CAST({at}[{b}] AS double) * 100000) AS bigint) AS my,
    CAST(floor(CAST({at}[{c}] AS double) * 100000) AS bigint) AS mz"""
_FILE_NAME = """CASE s % 3 WHEN 0 THEN 'f' || lpad(cast(s as string), 3, '0') || '.cif' WHEN 1 THEN 'sub/f' || lpad(cast(s as string), 3, '0') || '.mmcif.gz'
    ELSE 'f' || lpad(cast(s as string), 3, '0') || '.ent' END"""
_HEAD_CIF = """'data_x\n_entry.id S' || lpad(cast(s as string), 3, '0') || '\n_exptl.method \\'X-RAY DIFFRACTION\\'\n_refine.ls_d_res_high ?
_em_3d_reconstruction.resolution 3.' || s || '\n_pdbx_database_status.recvd_initial_deposition_date 2000-12-01
loop_\n_pdbx_audit_revision_history.ordinal\n_pdbx_audit_revision_history.revision_date\n1 2001-02-03\n2 2010-01-01
_struct.title\n;A title\n;\nloop_\n_atom_site.group_PDB\n_atom_site.label_atom_id\n_atom_site.label_alt_id\n_atom_site.auth_comp_id
_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.pdbx_PDB_ins_code\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z
_atom_site.occupancy\n_atom_site.pdbx_PDB_model_num\n'"""
_HEAD_PDB = """rpad('HEADER    HYDROLASE', 50, ' ') || '01-FEB-99   S' || lpad(cast(s as string), 3, '0') || '\nTITLE     A TITLE
EXPDTA    X-RAY DIFFRACTION\nREMARK   2 RESOLUTION.    1.9' || s || ' ANGSTROMS.\n'"""


#: A residue number in four columns: in hybrid-36 above 9999, as a PDB file has no wider place for it.
_SEQ = """CASE WHEN seq < 10000 THEN printf('%4d', seq) WHEN seq < 1223056 THEN conv(cast(seq + 456560 as string), 10, 36)
    ELSE lower(conv(cast(seq - 756496 as string), 10, 36)) END"""


def _structures(spark: SparkSession, d: str, folder: str | None = None, where: str = "true") -> str:
    """A folder of structure files. Structure 10 holds no protein, and an atom of structure 11 has no number for a place."""
    folder = folder or f"{tables.fresh_dir(spark, 'rendered')}/structures"
    _table(spark, d, "embeddings").createOrReplaceTempView("helixframe_vectors")
    vectors = spark.sql(f"SELECT {_VECTOR.format(div='div', at='embedding', a=0, b=1, c=2)} FROM helixframe_vectors")
    rows = vectors.filter(where).selectExpr("*", "explode(IF(s % 2 = 0, array(1, 2), array(1))) as model")
    rows = rows.selectExpr("*", "explode(IF(r in (1, 3), array('N', 'CA', 'CB'), array('CA'))) as atom")
    rows = rows.selectExpr(
        "s", "model", "label", "v", "atom", "chr(65 + label) as chain", "seq",
        "IF(r in (2, 4) OR s = 10, 'HETATM', 'ATOM') as kind",
        "element_at(array('GLY', 'ALA', 'MSE', 'SER', 'HOH'), cast(r + 1 as int)) as name",
        "(mx + CASE atom WHEN 'CB' THEN 1000 WHEN 'N' THEN -1000 ELSE 0 END + 50000 * (model - 1)) / 1000 as x",
        "my / 1000 as y", "mz / 1000 as z",
    )
    three = "printf('%.3f', x) || ' ' || printf('%.3f', y) || ' ' || printf('%.3f', z)"
    cif = f"concat_ws(' ', kind, atom, '.', name, chain, cast(seq as string), IF(v % 7 = 0, 'A', '?'), IF(s = 11, 'oops 0 0', {three}), '1.0', cast(model as string))"
    pdb = f"""printf('%-6s%5d %-4s %3s %1s%4s%1s   %8.3f%8.3f%8.3f%6.2f%6.2f', kind, 1, ' ' || atom, name, chain, {_SEQ},
        IF(v % 7 = 0, 'A', ' '), x, y, z, 1.0D, 0.0D)"""
    rows = rows.selectExpr("s", "model", "label", "v", "atom", f"IF(s % 3 = 2 AND s <> 11, {pdb}, {cif}) as line")
    # models of a PDB file stand between MODEL and ENDMDL lines
    joined = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda a: a[order[-1]]), "\n")
    by = rows.groupBy("s", "model").agg(joined("label", "v", "atom", "line").alias("body"))
    by = by.selectExpr("s", "model", "IF(s % 3 = 2 AND s <> 11, 'MODEL        ' || model || '\n' || body || '\nENDMDL', body) as body")
    files = by.groupBy("s").agg(joined("model", "body").alias("body"))
    name = f"IF(s = 11, 'broken.cif', {_FILE_NAME})"
    files = files.selectExpr(f"{name} as name", f"IF(s % 3 = 2 AND s <> 11, {_HEAD_PDB}, {_HEAD_CIF}) || body || '\n' as content")
    notes = spark.range(1).selectExpr("'notes.txt' as name", "'no structure' as content")
    _put(files.union(notes), folder, True)
    return folder


def _ingested(spark: SparkSession, d: str) -> str:
    folder = _structures(spark, d)
    out = f"{folder}-tables"
    steps.ingest_structures(spark, folder, f"{out}/structures", f"{out}/chains", f"{out}/failures", f"{out}/parsed")
    return out


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.element_at(F.split("source_path", "/"), -1)).drop("source_path")


def structure_files(spark: SparkSession, d: str) -> DataFrame:
    """The supported files, with their place in the listing's order."""
    found = tables.structure_files(spark, _structures(spark, d)).withColumn("at", F.monotonically_increasing_id())
    found = found.select(F.regexp_replace("path", "^.*/structures/", "").alias("file"), "format", "at")
    return found.select("file", "format", F.expr("row_number() over (order by at)").alias("place"))


def structure_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _named(tables.get(spark, f"{_ingested(spark, d)}/structures", STRUCTURE_MANIFEST))


def chain_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _named(tables.get(spark, f"{_ingested(spark, d)}/chains", CHAIN_MANIFEST))


def ingest_failures(spark: SparkSession, d: str) -> DataFrame:
    return _named(tables.get(spark, f"{_ingested(spark, d)}/failures", "source_path string, error string"))


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    folder = _structures(spark, d)
    names = [f"{folder}-tables/{x}" for x in ("structures", "chains", "failures", "parsed")]
    return steps.ingest_structures(spark, folder, *names).report


def structure_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What stands outside the coordinates, of each file; no atom is parsed for it."""
    return _named(read_structures(spark, _structures(spark, d), "metadata").filter("file_format in ('mmcif', 'pdb')"))


_KIND = """element_at(array('L-PEPTIDE LINKING', 'NON-POLYMER', 'D-PEPTIDE LINKING', 'RNA LINKING', 'PEPTIDE-LIKE', 'L-PEPTIDE COOH CARBOXY TERMINUS', 'saccharide'),
    cast(k % 7 + 1 as int))"""


def component_residues(spark: SparkSession, d: str) -> DataFrame:
    """Residues by chain where a dictionary of components, a block a part, tells amino acids: suppliers of line items stand
    in for structures, their parts for residues, an order's line number for the chain."""
    path = f"{tables.fresh_dir(spark, 'rendered')}/components.cif"
    quoted = f"IF(k % 2 = 0, '\"' || {_KIND} || '\"', '\\'' || {_KIND} || '\\'')"
    block = f"'data_Q' || k || '\n#\n_chem_comp.id   Q' || k || '\n_chem_comp.name \"NO PEPTIDE\"\n_chem_comp.type   ' || {quoted} || '\n_chem_comp.formula ?\n#'"
    tables.write_lines(_parts(spark, d).selectExpr("k", f"{block} as value"), path, "k")
    atom = {
        "structure_id": "'s' || l_suppkey", "source_path": "'-'", "file_format": "'mmcif'", "model_idx": "0", "chain_id": "cast(l_linenumber as string)", "chain_pos": "cast(l_linenumber as int)",
        "het_flag": "' '", "resseq": "cast(l_orderkey as int)", "resname": "'Q' || l_partkey", "res_pos": "cast(l_orderkey as int)",
    }
    atoms = _table(spark, d, "lineitem").selectExpr(*[f"{v} as {k}" for k, v in atom.items()])
    known = components.amino_acids(components.read_components(spark, path))
    found = topology.chain_stats(atoms, known=known)
    return found.select("structure_id", "chain_id", "residue_count", "min_resseq", "max_resseq")


def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Chains after three drops of files, with a run of the stream after each. The last brings new versions of structures 0
    and 4, without some of their chains, and one of structure 7, which holds no protein any more."""
    work = tables.fresh_dir(spark, "rendered")
    for n, where in enumerate(("s < 6", "s >= 6", "s in (0, 4) and label = 1 or s = 7 and r in (2, 4)")):
        _structures(spark, d, f"{work}/structures/drop{n}", where)
        ingest_versions(spark, f"{work}/structures", f"{work}/state", f"{work}/checkpoint").awaitTermination()
    return _named(versions(spark, f"{work}/state", "chains"))


def chain_residues(spark: SparkSession, d: str) -> DataFrame:
    found = read_structures(spark, _structures(spark, d), "residues", bytes_per_partition=100_000)
    return found.select("structure_id", "chain_id", "seq", *[F.col(c).cast("double").alias(c) for c in "xyz"])


def _topology(spark: SparkSession, d: str, out: str) -> None:
    steps.compute_topology(spark, f"{out}/chains", f"{out}/parsed", f"{out}/topology", PipelineConfig(contact_distance=18.0))


def chain_topology(spark: SparkSession, d: str) -> DataFrame:
    out = _ingested(spark, d)
    _topology(spark, d, out)
    found = _named(tables.get(spark, f"{out}/topology", CHAIN_TOPOLOGY))
    return found.drop("file").select(*[F.col(c).cast("long").alias(c) if c.endswith("count") else c for c in found.columns if c != "file"])


def _atlas(spark: SparkSession, d: str) -> str:
    """A mapping of parts to the rendered chains, some of which there are not, and the atlas of it."""
    out = _ingested(spark, d)
    _topology(spark, d, out)
    rows = _parts(spark, d).selectExpr(
        "'d' || k as domain_id", "'s' || lpad(cast(k % 13 as string), 3, '0') as structure_id",
        "IF(k % 29 = 0, NULL, chr(65 + k % 4)) as chain_id", "cast(IF(k % 3 = 0, NULL, -k) as int) as residue_start",
        "cast(k as int) as residue_end", "cast(z as int) as domain_length", "element_at(array('bacteria', 'archaea', NULL), cast(k % 3 + 1 as int)) as kingdom",
        "IF(k % 31 = 0, NULL, sccs) as scope_id", "IF(k % 2 = 0, NULL, '1.' || z) as cath_id", "IF(k % 5 = 0, NULL, 'f, \"' || z || '\"') as ecod_id",
    )
    tables.put(rows, f"{out}/mapping")
    steps.build_atlas_table(spark, f"{out}/topology", f"{out}/mapping", f"{out}/atlas", f"{out}/atlas_failures")
    return out


def atlas_table(spark: SparkSession, d: str) -> DataFrame:
    """The atlas after the occupancy step has filled in its tiers, in place."""
    out = _atlas(spark, d)
    steps.summarise_occupancy(spark, f"{out}/atlas", f"{out}/occupancy")
    return tables.get(spark, f"{out}/atlas", ATLAS)


def atlas_failures(spark: SparkSession, d: str) -> DataFrame:
    return tables.get(spark, f"{_atlas(spark, d)}/atlas_failures", JOIN_FAILURES)


def occupancy_table(spark: SparkSession, d: str) -> DataFrame:
    """The summary as it reads back, its map as text."""
    out = _atlas(spark, d)
    steps.summarise_occupancy(spark, f"{out}/atlas", f"{out}/occupancy")
    return tables.get(spark, f"{out}/occupancy", OCCUPANCY)


def occupancy_report(spark: SparkSession, d: str) -> DataFrame:
    out = _atlas(spark, d)
    told = steps.summarise_occupancy(spark, f"{out}/atlas", f"{out}/occupancy").report
    return told.withColumn("value", F.round("value", 6))


def pending_downloads(spark: SparkSession, d: str) -> DataFrame:
    """Files of 500 bytes are there, those of 50 are not."""
    folder = tables.fresh_dir(spark, "rendered")
    ids = _parts(spark, d).selectExpr("pdb as structure_id")
    there = ids.distinct().selectExpr("lower(structure_id) || '.cif.gz' as name", "cast(substr(structure_id, 2) as int) as n").filter("n % 3 <> 0")
    files = there.selectExpr("name", "repeat('x', IF(n % 3 = 1, 500, 50)) as content")
    _put(files, folder)
    return steps.plan_downloads(spark, ids, folder)


def source_registry(spark: SparkSession, d: str) -> DataFrame:
    return downloads.registry(spark)


def _uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{path}"


def registry_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The registry's step over local addresses: parts of ``region``, of which some are not there."""
    told = []
    for name, missing in (("most", 2), ("one", 4)):
        folder = tables.fresh_dir(spark, "rendered")
        rows = _table(spark, d, "region").selectExpr("r_regionkey as k", "r_name as content")
        files = rows.filter(f"k >= {missing}").selectExpr("'r' || k as name", "content")
        _put(files, f"{folder}/in")
        url = F.concat(F.lit(_uri(f"{folder}/in/r")), F.col("k")).alias("url")
        sources = rows.select(url, F.concat(F.lit("out"), F.col("k")).alias("dest"), F.col("content").alias("label"))
        step = steps.download_classifications(spark, f"{folder}/out", sources)
        got = spark.read.format("binaryFile").load(f"{folder}/out").agg(F.sum("length").cast("double").alias("value"))
        told.append(step.report.withColumn("run", F.lit(name)).withColumn("code", F.lit(step.code)))
        told.append(got.select(F.lit("bytes").alias("section"), F.lit("written").alias("key"), "value", F.lit(name).alias("run"), F.lit(step.code).alias("code")))
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


def structure_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The download step over local addresses, a third of which are there: its report, and the failures that it wrote."""
    folder = tables.fresh_dir(spark, "rendered")
    ids = _parts(spark, d).selectExpr("'d' || k as domain_id", "'P' || k as structure_id", "cast(k as int) as n")
    mapping = ids.select(*[F.col(c) if c in ids.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in DOMAIN_MAPPING.split(", "))])
    tables.put(mapping, f"{folder}/mapping")
    _put(ids.filter("n % 3 = 0").selectExpr("lower(structure_id) as name", "repeat('x', 200) as content"), f"{folder}/in")
    plan = ids.selectExpr("lower(structure_id) as pdb_id").withColumn("url", F.concat(F.lit(_uri(f"{folder}/in/")), F.col("pdb_id")))
    step = steps.download_structures(spark, f"{folder}/mapping", f"{folder}/out", plan)
    failed = tables.get(spark, f"{folder}/out/download_failures.csv", DOWNLOAD_FAILURES)
    failed = failed.select(F.lit("failed").alias("section"), F.col("pdb_id").alias("key"), F.col("error").isNotNull().cast("double").alias("value"))
    return step.report.unionByName(failed)


def step_codes(spark: SparkSession, d: str) -> DataFrame:
    """Steps without input: a failure for ingest, an empty table with its header for the failures of nothing."""
    folder = tables.fresh_dir(spark, "rendered")
    tables.make_dir(spark, f"{folder}/empty")
    names = [f"{folder}/{x}" for x in ("s.csv", "c.csv", "f.csv", "parsed")]
    code = steps.ingest_structures(spark, f"{folder}/empty", *names).code
    none = _table(spark, d, "region").filter("false").selectExpr("r_name as pdb_id", "r_name as error")
    some = _table(spark, d, "region").selectExpr("r_name as pdb_id", "r_name as error")
    wrote = [tables.write_failures(x, f"{folder}/{n}") for n, x in (("none", none), ("some", some))]
    tables.write_csv(none, f"{folder}/empty.csv")
    kept = tables.get(spark, f"{folder}/some", DOWNLOAD_FAILURES).count()
    blank = tables.read_csv(spark, f"{folder}/empty.csv", DOWNLOAD_FAILURES)
    rows = {
        "ingest without files": code,
        "failures of none written": int(wrote[0]),
        "failures of some written": int(wrote[1]),
        "failures read back": kept,
        "rows of an empty table": blank.count(),
        "columns of an empty table": len(blank.columns),
    }
    each = [F.struct(F.lit(k).alias("what"), F.lit(v).cast("long").alias("value")) for k, v in rows.items()]
    return spark.range(1).select(F.inline(F.array(*each)))


def tier_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Tiers with other bounds than the usual."""
    return occupancy.fold_counts(_table(spark, d, "orders"), "o_custkey", PipelineConfig(common_from=20, rare_from=12))




def _duck(sql: str) -> str:
    return sql.replace("as string)", "as VARCHAR)")


_P = f"p AS (SELECT p_partkey AS k, p_size AS z, {_duck(_PDB)} AS pdb, {_LETTER} AS chain, {_SCCS} AS sccs FROM part)"
_SCOPE = """scope AS (SELECT k, 'd' || k AS sid, lower(pdb) AS structure_id, CASE WHEN k % 8 NOT IN (3, 6) THEN chain END AS chain_id,
    cast(CASE k % 8 WHEN 1 THEN -(k % 7) WHEN 2 THEN 5 WHEN 4 THEN 1 WHEN 7 THEN 1 END AS INTEGER) AS residue_start,
    cast(CASE k % 8 WHEN 1 THEN 60 + z WHEN 2 THEN 50 + z WHEN 4 THEN 40 + z END AS INTEGER) AS residue_end, sccs,
    cast(100000 + k AS VARCHAR) AS sunid, CASE WHEN k % 10 = 9 THEN 'cl=1' ELSE 'cl=1,sp=' || (k % 60) || ',px=2' END AS hierarchy,
    CASE WHEN k % 10 <> 9 THEN cast(k % 60 AS VARCHAR) END AS species FROM p WHERE k % 11 <> 10
    UNION ALL SELECT k, 'd' || k, 'xxxx', NULL, NULL, NULL, 'z.0.0.0', '1', 'none', NULL FROM p WHERE k % 11 = 10 AND k % 13 = 12)"""
_DES = f"""des AS (SELECT cast(k AS VARCHAR) AS sunid, CASE WHEN k % 4 = 3 THEN 'dm' ELSE 'sp' END AS level, 'a.1' AS sccs, {_DESCRIPTION} AS description
    FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 6 <> 4)"""
_LENGTHS = "lengths AS (SELECT 'd' || k AS sid, cast(40 + z + 3 * (k % 50) AS INTEGER) AS domain_length FROM p WHERE k % 9 <> 8)"
_CATH_SQL = """cath AS (SELECT k, lower(pdb) AS structure_id, chain AS chain_id, '1.10.' || z AS cath_id, lower(pdb) || chain || '01' AS domain_id
    FROM p WHERE k % 3 = 0 AND k % 33 <> 0)"""
_ECOD_SQL = """ecod AS (SELECT k, lower(pdb) AS structure_id, chain AS chain_id, '2004.' || z || '.1' AS ecod_id, 'e' || k AS ecod_domain_id
    FROM p WHERE k % 4 = 1 AND k % 28 <> 5 AND k % 20 <> 1)"""
_MAPPING = """both_ AS (SELECT s.*, l.domain_length FROM scope s LEFT JOIN lengths l ON s.sid = l.sid),
mapping AS (SELECT b.sid AS domain_id, b.structure_id, b.chain_id, residue_start, residue_end, domain_length,
    CASE cast(species AS INTEGER) % 6 WHEN 0 THEN 'bacteria' WHEN 1 THEN 'eukaryotes' WHEN 2 THEN 'archaea' WHEN 5 THEN 'archaea' END AS kingdom_, d.sunid
    AS known, b.sccs AS scope_id, c.cath_id, e.ecod_id
    FROM both_ b LEFT JOIN (SELECT structure_id, chain_id, arg_min(cath_id, k) AS cath_id FROM cath GROUP BY ALL) c ON b.structure_id = c.structure_id AND
    b.chain_id = c.chain_id
    LEFT JOIN (SELECT structure_id, chain_id, arg_min(ecod_id, k) AS ecod_id FROM ecod GROUP BY ALL) e ON b.structure_id = e.structure_id AND b.chain_id = e.chain_id
    LEFT JOIN (SELECT sunid FROM des WHERE level = 'sp') d ON b.species = d.sunid WHERE domain_length BETWEEN 60 AND 180),
named AS (SELECT * EXCLUDE (kingdom_, known), CASE WHEN known IS NOT NULL THEN kingdom_ END AS kingdom FROM mapping)"""
_ALL = ", ".join([_P, _SCOPE, _DES, _LENGTHS, _CATH_SQL, _ECOD_SQL, _MAPPING])

_E = f"""e AS (SELECT {_VECTOR.format(div='//', at='embedding', a=1, b=2, c=3)}, chr(cast(65 + label % 3 AS INTEGER)) AS chain_id, 's' ||
    lpad(cast(vec_id % 12 AS VARCHAR), 3, '0') AS structure_id FROM embeddings),
f AS (SELECT DISTINCT s, {_duck(_FILE_NAME)} AS file, CASE WHEN s % 3 = 2 THEN 'pdb' ELSE 'mmcif' END AS file_format FROM e WHERE s < 11),
r AS (SELECT * FROM e WHERE r IN (0, 1, 3) AND s < 10)"""
_TOP = """q AS (SELECT structure_id, chain_id, cast(seq AS BIGINT) AS seq, cast((mx + CASE WHEN r = 0 THEN 0 ELSE 1000 END) / 1000.0::DOUBLE AS FLOAT)
    AS x, cast(my / 1000.0::DOUBLE AS FLOAT) AS y, cast(mz / 1000.0::DOUBLE AS FLOAT) AS z FROM r),
c AS (SELECT a.structure_id, a.chain_id, a.seq AS lo, b.seq AS hi FROM q a JOIN q b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id AND b.seq - a.seq >= 4
    AND cast((a.x - b.x) * (a.x - b.x) AS DOUBLE) + cast((a.y - b.y) * (a.y - b.y) AS DOUBLE) + cast((a.z - b.z) * (a.z - b.z) AS DOUBLE) <= 324.0::DOUBLE),
w AS (SELECT a.structure_id, a.chain_id, CASE WHEN a.hi < b.lo OR b.hi < a.lo THEN 's' WHEN (a.lo < b.lo AND b.hi < a.hi) OR (b.lo < a.lo AND a.hi <
    b.hi) THEN 'p' ELSE 'x' END AS k
    FROM c a JOIN c b ON a.structure_id = b.structure_id AND a.chain_id = b.chain_id AND (a.lo < b.lo OR (a.lo = b.lo AND a.hi < b.hi)) AND a.lo <> b.lo
    AND a.lo <> b.hi AND a.hi <> b.lo AND a.hi <> b.hi),
n AS (SELECT structure_id, chain_id, count(*) AS pairs, count(*) FILTER (WHERE k = 's') AS s, count(*) FILTER (WHERE k = 'p') AS p, count(*) FILTER
    (WHERE k = 'x') AS x FROM w GROUP BY ALL),
m AS (SELECT structure_id, chain_id, count(*) AS contacts FROM c GROUP BY ALL),
g AS (SELECT structure_id, chain_id, s, count(*) AS residues FROM q JOIN (SELECT DISTINCT structure_id, s FROM r) USING (structure_id) GROUP BY ALL),
topology AS (SELECT g.structure_id, g.chain_id, CASE WHEN g.s % 3 = 2 THEN 'pdb' ELSE 'mmcif' END AS file_format, residues AS eligible_residue_count,
    coalesce(contacts, 0) AS contact_count, coalesce(pairs, 0) AS contact_pair_count, coalesce(n.s, 0) AS series_pair_count, coalesce(n.p, 0) AS
    parallel_pair_count, coalesce(n.x, 0) AS cross_pair_count,
    cast(format('{:.6f}', n.s / cast(pairs AS DOUBLE)) AS DOUBLE) AS s_fraction, cast(format('{:.6f}', n.p / cast(pairs AS DOUBLE)) AS DOUBLE) AS
    p_fraction, cast(format('{:.6f}', n.x / cast(pairs AS DOUBLE)) AS DOUBLE) AS x_fraction
    FROM g LEFT JOIN m USING (structure_id, chain_id) LEFT JOIN n USING (structure_id, chain_id))"""
_ATLAS_SQL = """d AS (SELECT k, 'd' || k AS domain_id, 's' || lpad(cast(k % 13 AS VARCHAR), 3, '0') AS structure_id, CASE WHEN k % 29 <> 0 THEN
    chr(cast(65 + k % 4 AS INTEGER)) END AS chain_id,
    cast(CASE WHEN k % 3 <> 0 THEN -k END AS INTEGER) AS residue_start, cast(k AS INTEGER) AS residue_end, cast(z AS INTEGER) AS domain_length,
    CASE k % 3 WHEN 0 THEN 'bacteria' WHEN 1 THEN 'archaea' END AS kingdom, CASE WHEN k % 31 <> 0 THEN sccs END AS scope_id,
    CASE WHEN k % 2 <> 0 THEN '1.' || z END AS cath_id, CASE WHEN k % 5 <> 0 THEN 'f, "' || z || '"' END AS ecod_id FROM pp),
atlas AS (SELECT d.* EXCLUDE (k), 'S=' || coalesce(format('{:.6f}', s_fraction), '') || ';P=' || coalesce(format('{:.6f}', p_fraction), '') || ';X='
    || coalesce(format('{:.6f}', x_fraction), '') AS topology_representation,
    s_fraction AS ps_fraction, p_fraction AS pp_fraction, x_fraction FROM d JOIN topology t ON d.structure_id = t.structure_id AND d.chain_id = t.chain_id),
folds AS (SELECT scope_id, count(*) AS domain_count, CASE WHEN count(*) >= 10 THEN 'common' WHEN count(*) >= 3 THEN 'rare' ELSE 'ultra-rare' END AS
    occupancy_tier FROM atlas WHERE scope_id IS NOT NULL GROUP BY 1)"""
_FULL = ", ".join([_E, _TOP, _P.replace("p AS (", "pp AS (", 1), _ATLAS_SQL])
_METRICS = """(SELECT 'ps_fraction' AS metric, ps_fraction AS v
    FROM atlas
    UNION ALL SELECT 'pp_fraction', pp_fraction
    FROM atlas
    UNION ALL SELECT 'x_fraction', x_fraction
    FROM atlas)"""

SQL = {
    "scope_domains": f"WITH {_P}, {_SCOPE} SELECT * EXCLUDE (k) FROM scope",
    "scope_descriptions": f"WITH {_DES} SELECT * FROM des",
    "fasta_lengths": f"WITH {_P}, {_LENGTHS} SELECT * FROM lengths",
    "cath_domains": f"WITH {_P}, {_CATH_SQL} SELECT * EXCLUDE (k) FROM cath",
    "ecod_domains": f"WITH {_P}, {_ECOD_SQL} SELECT * EXCLUDE (k) FROM ecod",
    "domain_mapping": f"WITH {_ALL} SELECT * FROM named",
    "mapping_report": f"""WITH {_ALL} SELECT 'read' AS section, 'scope domains' AS key, count(*) AS value FROM scope UNION ALL SELECT 'read',
    'scope descriptions', count(*) FROM des
        UNION ALL SELECT 'read', 'sequences', count(*) FROM lengths UNION ALL SELECT 'read', 'cath domains', count(*) FROM cath UNION ALL SELECT 'read',
        'cath chains', count(DISTINCT structure_id || chain_id) FROM cath
        UNION ALL SELECT 'read', 'ecod domains', count(*) FROM ecod UNION ALL SELECT 'read', 'ecod chains', count(DISTINCT structure_id || chain_id) FROM ecod
        UNION ALL SELECT 'mapping', 'without length', count(*) FROM both_ WHERE domain_length IS NULL UNION ALL SELECT 'mapping', 'outside window', count(*)
        FROM both_ WHERE domain_length NOT BETWEEN 60 AND 180
        UNION ALL SELECT 'mapping', 'rows', count(*) FROM named UNION ALL SELECT 'mapping', 'with cath', count(cath_id) FROM named UNION ALL SELECT 'mapping',
        'with ecod', count(ecod_id) FROM named
        UNION ALL SELECT 'kingdoms', coalesce(kingdom, 'unknown'), count(*) FROM named GROUP BY 2""",
    "structure_files": f"""WITH {_E}, l AS (SELECT file, file_format AS format FROM f UNION ALL SELECT DISTINCT 'broken.cif', 'mmcif' FROM e WHERE s = 11)
        SELECT file, format, cast(row_number() OVER (ORDER BY string_split(file, '/')) AS INTEGER) AS place FROM l""",
    "structure_manifest": f"""WITH {_E} SELECT structure_id, regexp_replace(file, '^sub/', '') AS file, file_format, CASE WHEN file_format = 'pdb' THEN
    'x-ray diffraction' ELSE 'X-RAY DIFFRACTION' END AS experimental_method,
        CASE WHEN file_format = 'pdb' THEN '1.9' ELSE '3.' END || s AS resolution, CASE WHEN file_format = 'pdb' THEN '1999-02-01' ELSE '2000-12-01' END AS
        deposition_date, CASE WHEN file_format <> 'pdb' THEN '2001-02-03' END AS release_date,
        CASE WHEN file_format = 'pdb' THEN 'a title' ELSE 'A title' END AS title, cast(CASE WHEN s % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS model_count,
        cast(count(DISTINCT label) AS INTEGER) AS protein_chain_count,
        cast(count(*) AS INTEGER) AS protein_residue_count, string_agg(DISTINCT chain_id, ',' ORDER BY chain_id) AS protein_chain_ids FROM r JOIN f USING (s)
        GROUP BY structure_id, s, file, file_format""",
    "chain_manifest": f"""WITH {_E} SELECT structure_id, chain_id, regexp_replace(file, '^sub/', '') AS file, file_format, cast(count(*) AS INTEGER) AS
    residue_count, cast(count(*) AS INTEGER) AS resolved_residue_count,
        cast(min(seq) AS INTEGER) AS min_resseq, cast(max(seq) AS INTEGER) AS max_resseq FROM r JOIN f USING (s) GROUP BY ALL""",
    "component_residues": """SELECT 's' || l_suppkey AS structure_id, cast(l_linenumber AS VARCHAR) AS chain_id, cast(count(DISTINCT l_orderkey) AS INTEGER) AS residue_count,
        cast(min(l_orderkey) AS INTEGER) AS min_resseq, cast(max(l_orderkey) AS INTEGER) AS max_resseq FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE p_partkey % 7 IN (0, 2, 5) GROUP BY l_suppkey, l_linenumber""",
    "incremental_ingest": f"""WITH {_E} SELECT structure_id, chain_id, regexp_replace(file, '^sub/', '') AS file, file_format, cast(count(*) AS INTEGER) AS
    residue_count, cast(count(*) AS INTEGER) AS resolved_residue_count,
        cast(min(seq) AS INTEGER) AS min_resseq, cast(max(seq) AS INTEGER) AS max_resseq FROM r JOIN f USING (s) WHERE (s NOT IN (0, 4) OR label = 1) AND s <> 7 GROUP BY ALL""",
    "ingest_failures": f"""WITH {_E} SELECT DISTINCT CASE WHEN s = 11 THEN 'broken.cif' ELSE 'f010.mmcif.gz' END AS file, CASE WHEN s = 11 THEN
    'could not convert string to float: ''oops''' ELSE 'No protein chains detected in first model.' END AS error FROM e WHERE s >= 10""",
    "ingest_report": f"""WITH {_E} SELECT 'ingest' AS section, 'structures' AS key, cast(count(DISTINCT s) AS DOUBLE) AS value FROM r UNION ALL SELECT
    'ingest', 'chains', count(DISTINCT (s, label)) FROM r
        UNION ALL SELECT 'ingest', 'failures', count(DISTINCT s) FROM e WHERE s >= 10""",
    "structure_metadata": f"""WITH {_E}, h AS (SELECT DISTINCT s, structure_id, CASE WHEN s = 11 THEN 'broken.cif' ELSE {_duck(_FILE_NAME)} END AS file,
        CASE WHEN s % 3 = 2 AND s <> 11 THEN 'pdb' ELSE 'mmcif' END AS file_format FROM e)
        SELECT structure_id, regexp_replace(file, '^sub/', '') AS file, file_format, CASE WHEN file_format = 'pdb' THEN 'x-ray diffraction' ELSE
        'X-RAY DIFFRACTION' END AS experimental_method, CASE WHEN file_format = 'pdb' THEN '1.9' ELSE '3.' END || s AS resolution,
        CASE WHEN file_format = 'pdb' THEN '1999-02-01' ELSE '2000-12-01' END AS deposition_date, CASE WHEN file_format <> 'pdb' THEN '2001-02-03' END AS
        release_date, CASE WHEN file_format = 'pdb' THEN 'a title' ELSE 'A title' END AS title, cast(0 AS INTEGER) AS atoms_parsed, cast(NULL AS VARCHAR) AS error FROM h""",
    "chain_residues": f"""WITH {_E}, {_TOP} SELECT structure_id, chain_id, cast(seq AS INTEGER) AS seq, cast(x AS DOUBLE) AS x, cast(y AS DOUBLE) AS y, cast(z AS DOUBLE) AS z
        FROM q""",
    "chain_topology": f"WITH {_E}, {_TOP} SELECT * FROM topology",
    "atlas_table": f"WITH {_FULL} SELECT a.*, occupancy_tier FROM atlas a LEFT JOIN folds f ON a.scope_id = f.scope_id",
    "atlas_failures": f"""WITH {_FULL} SELECT domain_id, structure_id, chain_id, 'Missing chain topology summary for domain join.' AS error FROM d WHERE NOT EXISTS (SELECT 1
        FROM topology t WHERE t.structure_id = d.structure_id AND t.chain_id = d.chain_id)""",
    "occupancy_table": f"""WITH {_FULL}, k AS (SELECT scope_id, coalesce(kingdom, 'unknown') AS kind, count(*) AS n FROM atlas WHERE scope_id IS NOT NULL GROUP BY ALL)
        SELECT f.*, '{{' || t.kingdoms || '}}' AS kingdoms FROM folds f JOIN (SELECT scope_id, string_agg('''' || kind || ''': ' || n, ', ' ORDER BY n DESC,
        kind) AS kingdoms FROM k GROUP BY 1) t ON f.scope_id = t.scope_id""",
    "occupancy_report": f"""WITH {_FULL}, gg AS (SELECT metric, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM {_METRICS} WHERE
    v IS NOT NULL GROUP BY 1),
        u AS (SELECT 'totals' AS section, 'domains' AS key, cast(count(*) AS DOUBLE) AS value FROM atlas UNION ALL SELECT 'totals', 'folds', count(*) FROM folds
        UNION ALL SELECT 'tiers', v.t, count(f.scope_id) FROM (VALUES ('common'), ('rare'), ('ultra-rare')) v(t) LEFT JOIN folds f ON f.occupancy_tier = v.t GROUP BY 2
        UNION ALL SELECT 'kingdoms', coalesce(kingdom, 'unknown'), count(*) FROM atlas GROUP BY 2
        UNION ALL SELECT 'class domains', substr(scope_id, 1, 1), sum(domain_count) FROM folds GROUP BY 2 UNION ALL SELECT 'class folds', substr(scope_id, 1,
        1), count(*) FROM folds GROUP BY 2
        UNION ALL SELECT 'coverage', 'cath_id', 100.0::DOUBLE * count(cath_id) / count(*) FROM atlas UNION ALL SELECT 'coverage', 'ecod_id', 100.0::DOUBLE *
        count(ecod_id) / count(*) FROM atlas
        UNION ALL SELECT 'fraction mean', metric, mean FROM gg UNION ALL SELECT 'fraction std', metric, std FROM gg UNION ALL SELECT 'fraction min', metric,
        min FROM gg UNION ALL SELECT 'fraction max', metric, max FROM gg)
        SELECT section, key, round(value, 6) AS value FROM u""",
    "pending_downloads": f"WITH {_P} SELECT DISTINCT lower(pdb) AS pdb_id, 'https://files.rcsb.org/download/' || pdb || '.cif.gz' AS url FROM p WHERE (k % 300) % 3 <> 1",
    "source_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{n}', '{x}')" for u, n, x in downloads.SOURCES) + ") v(url, dest, label)",
    "registry_fetch": """SELECT run, code, section, key, value FROM (SELECT 'most' AS run, 2 AS missing, 0 AS code UNION ALL SELECT 'one', 4, 1),
        LATERAL (SELECT 'downloads' AS section, 'completed' AS key, cast(count(*) AS DOUBLE) AS value FROM region WHERE r_regionkey >= missing UNION ALL
        SELECT 'downloads', 'failed', cast(missing AS DOUBLE)
        UNION ALL SELECT 'bytes', 'written', sum(strlen(r_name)) FROM region WHERE r_regionkey >= missing)""",
    "structure_fetch": f"""WITH {_P}, i AS (SELECT 'p' || k AS id, k FROM p) SELECT 'structures' AS section, 'needed' AS key, cast(count(*)
    AS DOUBLE) AS value FROM i
        UNION ALL SELECT 'structures', 'there before', 0 UNION ALL SELECT 'structures', 'downloaded', count(*) FROM i WHERE k % 3 = 0 UNION ALL SELECT
        'structures', 'failures', count(*) FROM i WHERE k % 3 <> 0
        UNION ALL SELECT 'failed', id, 1 FROM i WHERE k % 3 <> 0""",
    "step_codes": """SELECT * FROM (VALUES ('ingest without files', 1::BIGINT), ('failures of none written', 0), ('failures of some written', 1),
    ('failures read back', 5), ('rows of an empty table', 0), ('columns of an empty table', 2)) v(what, value)""",
    "tier_bounds": """SELECT o_custkey, count(*) AS domain_count, CASE WHEN count(*) >= 20 THEN 'common' WHEN count(*) >= 12 THEN 'rare' ELSE 'ultra-rare' END AS
        occupancy_tier FROM orders GROUP BY 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}
