"""What the corpus operators share: durable intermediate tables, row keys, bitmaps and table access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys up to which ``rows_without`` sends them to all tasks (8 bytes each).
FEW_KEYS = 200_000
#: Deletes a query's shuffle files when it ends, not when the driver next collects its garbage; a later reader of them would make them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a bitmap that is sent to all tasks, at most.
BITMAP_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that of ``setCheckpointDir``. Where neither is set, a local master gets a
    temporary one for the session; on a cluster, where its members would not share it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = of_context.get() if of_context.isDefined() else spark.conf.get("helixframe.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("helixframe.scratch", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str = "stash", within: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or to ``within``, a folder there) and read it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{within}/{name}-{uuid.uuid4().hex}" if within else fresh_dir(spark, name)
    schema, usual = df.schema, spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, usual)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of stashes that later ones replace, and let Spark drop the shuffles of plans that are done."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def text_bytes(df: DataFrame, text: str = "text"):
    """Column: UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """A hash of id and text; a null differs from any value."""
    return F.xxhash64(docs[doc_id].cast("long"), docs[text].cast("string"))


#: Places in a hash from which its bits in a bitmap are taken.
_PROBES = (0, 19, 37)


def bitmap(keys: DataFrame, column: str, most: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of hashes (a Bloom filter of three probes) with 64 bits for each, but ``most`` at most: up to then about one
    of 10,000 other hashes passes. Gathered as numbers of 64 bits."""
    bits = min(most, 1 << max(16, (64 * max(1, keys.count()) - 1).bit_length()))
    slots = [F.shiftrightunsigned(F.col(column), n).bitwiseAND(F.lit(bits - 1)) for n in _PROBES]
    slot = keys.select(F.explode(F.array(*slots)).alias("slot"))
    one = F.expr("bit_or(shiftleft(1L, cast(slot & 63L as int)))")
    rows = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(one.alias("held")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("held").to_numpy()
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the (unsigned) hashes that may be in a bitmap."""
    at, most = np.arange(len(h)), np.uint64(8 * len(bits) - 1)
    for n in _PROBES:
        slot = (h[at] >> np.uint64(n)) & most
        at = at[(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


def rows_near(keyed: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``keys`` (one column of that name), and a few others, told by a bitmap without a shuffle."""
    bits = keyed.sparkSession.sparkContext.broadcast(bitmap(keys, key))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.take(pa.array(in_bitmap(bits.value, h), pa.int64()))

    return keyed.mapInArrow(run, keyed.schema)


def rows_without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is not in ``keys``. Few keys are sent to all tasks; of many, a bitmap is, so
    that the rows that it clears are not shuffled."""
    spark, key = docs.sparkSession, uuid.uuid4().hex
    keyed = docs.withColumn(key, row_key(docs))
    gone = keys.select(F.col("row_key").alias(key))
    if keys.count() <= FEW_KEYS:
        return keyed.join(F.broadcast(gone), key, "left_anti").select(docs.columns)
    bits = spark.sparkContext.broadcast(bitmap(keys, "row_key"))

    def split(held: bool):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                h = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).view(np.uint64)
                mask = np.full(len(h), not held)
                mask[in_bitmap(bits.value, h)] = held
                yield batch.filter(pa.array(mask))

        return keyed.mapInArrow(run, keyed.schema)

    return split(False).union(split(True).join(gone, key, "left_anti").select(keyed.columns)).select(docs.columns)
