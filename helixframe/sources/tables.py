"""Tables of the steps, CSV in and out, and listings of files.

A table of a step is Parquet in versions: a folder each, and a pointer to the present one that is replaced by one rename. So
a write that fails leaves the old version whole, and readers of it go on. A table whose path ends in .csv is also put out
as CSV parts at that path, for users; the next step reads the Parquet, which stands in a folder there that CSV readers
pass over. A CSV table without it, as users make them, is read as it is.
"""

from __future__ import annotations

import gzip
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import dict_text, six_decimals, structure_format

_CSV = {"header": True, "quote": '"', "escape": '"'}


def position() -> F.Column:
    """Of a row of a text source, its place in the input."""
    at = {"f": F.col("_metadata.file_path"), "b": F.col("_metadata.file_block_start"), "i": F.monotonically_increasing_id()}
    return F.struct(*[c.alias(n) for n, c in at.items()])


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of ``spark.checkpoint.dir``, or of ``setCheckpointDir``; a
    temporary one where neither is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = of_context.get() if of_context.isDefined() else spark.conf.get("helixframe.tables", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="helixframe-tables-")
        spark.conf.set("helixframe.tables", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"


#: Schemes of Hadoop's stores by their names in pyarrow. Databricks mounts its own as a local folder.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a URI as Spark writes it, or of a local path."""
    if m := re.match(r"dbfs:/*", uri):
        uri = f"/dbfs/{uri[m.end() :]}"
    elif (m := re.match(r"([a-z][a-z0-9+.-]*)://", uri)) and m[1] in _SCHEMES:
        uri = f"{_SCHEMES[m[1]]}{uri[m.end(1) :]}"
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{os.path.abspath(uri)}")


def put_bytes(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file under a name of its own and rename it when it is whole, so that readers never see a part. Its size."""
    store, path = store_of(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part, size = f"{folder}/.{name}.{uuid.uuid4().hex}.part", 0
    try:
        with store.open_output_stream(part, compression=None) as out:
            for chunk in chunks:
                out.write(chunk)
                size += len(chunk)
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type == pafs.FileType.File:
            store.delete_file(part)
        raise
    return size


def write_files(rows: DataFrame, folder: str, compress: bool = False) -> DataFrame:
    """Rows (name, content) as files below a folder, names in .gz compressed if so wished; (name, length) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column("name"), []
            for name, content in zip(names.to_pylist(), batch.column("content").to_pylist()):
                body = gzip.compress(content, mtime=0) if compress and name.endswith(".gz") else content
                sizes.append(put_bytes(f"{folder}/{name}", [body]))
            yield pa.record_batch([names, pa.array(sizes, pa.int64())], ["name", "length"])

    kept = rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    return kept.mapInArrow(run, "name string, length long")


def write_lines(rows: DataFrame, path: str, *order) -> None:
    """Rows (value) as one text file in a folder, in the order of columns."""
    rows.coalesce(1).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headed CSV files with an explicit schema; blank cells are null, cells may hold line ends."""
    return spark.read.options(**_CSV, multiLine=True, enforceSchema=False).schema(schema).csv(path)


def as_written(df: DataFrame) -> DataFrame:
    """Fractions with six decimals, maps and arrays as text, blank text as null: cells as they come back from a table."""
    columns = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind == "double":
            c = six_decimals(c).cast("double")
        elif kind.startswith("map<"):
            ranked = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k"))))
            c = dict_text(F.transform(ranked, lambda e: F.struct(e["k"].alias("key"), (-e["m"]).alias("n"))))
        elif kind.startswith("array<"):
            c = F.array_join(c, ",")
        elif kind == "string":
            c = F.nullif(c, F.lit(""))
        columns.append(c.alias(f.name))
    return df.select(columns)


def write_csv(df: DataFrame, path: str, line_end: str = "\r\n") -> None:
    """A folder of headed CSV parts, rewritten; one with a header alone where there are no rows."""
    shown = as_written(df)
    shown = shown.select(*[six_decimals(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in shown.dtypes])
    shown.write.mode("overwrite").options(**_CSV, emptyValue="", nullValue="", lineSep=line_end).csv(path)


def export_csv(df: DataFrame, file: str) -> None:
    """One CSV file of that name, by one task: for tables that people open."""
    folder = f"{file}.{uuid.uuid4().hex}"
    write_csv(df.coalesce(1), folder)
    fs, there = _hadoop(df.sparkSession, file)
    (part,) = [x.getPath() for x in fs.globStatus(there(f"{folder}/part-*"))]
    fs.delete(there(file), True)
    fs.rename(part, there(file))
    fs.delete(there(folder), True)


def _store(path: str) -> str:
    """The folder of a table's versions."""
    return f"{path}/_table" if path.endswith(".csv") else path


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's present version; none where there is no pointer."""
    fs, there = _hadoop(spark, path)
    pointer = there(f"{_store(path)}/_CURRENT")
    if not fs.exists(pointer):
        return None
    source = fs.open(pointer)
    try:
        size = fs.getFileStatus(pointer).getLen()
        return f"{_store(path)}/{bytes(source.readNBytes(size)).decode()}"
    finally:
        source.close()


def _switch(spark: SparkSession, path: str, version: str, before: str | None) -> None:
    """Point at another version: a new pointer is renamed over the old one. The version before it stays for those who read
    it; older ones go, and what writes that failed have left. A table has one writer at a time."""
    fs, there = _hadoop(spark, path)
    jvm, store = spark.sparkContext._jvm, _store(path)
    new = there(f"{store}/_{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(there(f"{store}/_CURRENT")), options)
    kept = {version, (before or "").rpartition("/")[2]}
    for x in fs.listStatus(there(store)):
        if (name := x.getPath().getName()).startswith("v") and name not in kept:
            fs.delete(x.getPath(), True)


def put(df: DataFrame, path: str, **counts) -> dict[str, int]:
    """A new version of a table, which ``df`` may read: its rows, and further sums, as the write itself counts them."""
    spark, seen = df.sparkSession, Observation()
    before = current(spark, path)
    n = int(before.rpartition("/v")[2].split("-")[0]) + 1 if before else 0
    version = f"v{n:09d}-{uuid.uuid4().hex}"
    shown = as_written(df).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()])
    shown.write.parquet(f"{_store(path)}/{version}")
    _switch(spark, path, version, before)
    if path.endswith(".csv"):
        _put_parts(spark, path, f"{_store(path)}/{version}")
    return seen.get


def _put_parts(spark: SparkSession, path: str, version: str) -> None:
    """CSV parts of a version in place of those at ``path``."""
    fs, there = _hadoop(spark, path)
    new = f"{path}/_new"
    write_csv(spark.read.parquet(version), new)
    for old in fs.globStatus(there(f"{path}/part-*")):
        fs.delete(old.getPath(), False)
    for part in fs.globStatus(there(f"{new}/part-*")):
        fs.rename(part.getPath(), there(f"{path}/{part.getPath().getName()}"))
    fs.delete(there(new), True)


def get(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The present version of a table, or a CSV table that no step has written."""
    found = current(spark, path)
    plain = schema.replace("map<string,bigint>", "string")
    return spark.read.schema(plain).parquet(found) if found else read_csv(spark, path, plain)


def publish(spark: SparkSession, view: str, path: str, schema: str) -> None:
    """A view of the present version; a view that was made of an earlier one goes on with that until then."""
    get(spark, path, schema).createOrReplaceTempView(view)


def routes(df: DataFrame, route: str, names: list[str], schema: dict[str, list[str]]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """One write of ``df`` by the values of a column, and each of ``names`` as a table that reads its own files alone; and
    how many rows each has, as the write counts them."""
    spark, seen = df.sparkSession, Observation()
    work = fresh_dir(spark, "routes")
    df.observe(seen, *[F.count_if(F.col(route) == n).alias(n) for n in names]).write.partitionBy(route).parquet(work)
    kinds = df.schema
    return {n: spark.read.schema(kinds).parquet(work).filter(F.col(route) == n).select(schema[n]) for n in names}, seen.get


class Watched:
    """Counts that are taken of tables while others are made of them."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation, dict, DataFrame]] = []

    def watch(self, df: DataFrame, section: str, **counts) -> DataFrame:
        seen = Observation()
        self._seen.append((section, seen, counts, df))
        return df.observe(seen, *[c.alias(k) for k, c in counts.items()])

    def told(self) -> list[tuple[str, str, int]]:
        """(section, key, value), once the tables are made. What the plan left out, as where a join had no rows, is counted by itself."""
        out = []
        for section, seen, counts, df in self._seen:
            found = seen.get
            if not found:
                found = df.agg(*[c.alias(k) for k, c in counts.items()]).first().asDict()
            out += [(section, k, found[k]) for k in counts]
        return out


def write_failures(df: DataFrame, path: str) -> bool:
    """Writes only where there are rows; says whether it did."""
    if df.isEmpty():
        return False
    put(df, path)
    return True


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path
    return there(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def make_dir(spark: SparkSession, path: str) -> None:
    fs, there = _hadoop(spark, path)
    fs.mkdirs(there(path))


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a folder in another's place by renames; the old one goes when the new one is there."""
    old = f"{path}.old"
    fs, there = _hadoop(spark, path)
    fs.delete(there(old), True)
    if fs.exists(there(path)):
        fs.rename(there(path), there(old))
    fs.rename(there(new), there(path))
    fs.delete(there(old), True)


def replace_table(df: DataFrame, path: str) -> None:
    """A new version of a Parquet table beside the old one, which ``df`` may read, then swapped in."""
    df.write.mode("overwrite").parquet(f"{path}.new")
    _swap(df.sparkSession, f"{path}.new", path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, pos): lines in valid UTF-8, with their order in the input."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("value"), position().alias("pos"))


def structure_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, format) of supported files below a folder, in order of path components; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found.select("path", "length")
    return found.withColumn("format", structure_format(F.col("path"))).filter("format is not null").orderBy(F.split("path", "/"))
