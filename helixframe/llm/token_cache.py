"""Token counts through a digest cache.

Each text's digest (SHA-256 of the normalised content) is joined with the cache's rows of the tokenizer's version (a
digest of its vocabulary file). Digests that the cache lacks are misses: one document of each is encoded, whatever the
number of its copies, and the counts are appended to the cache as Parquet. Counts are then joined back by digest. While
the misses are few, tasks know them by a bitmap, which lets one in 10,000 copies be encoded again; else texts are joined
with them.

The normalisation is the tokenizer's own, which is none for a byte-level vocabulary, so that counts are exact.

Counting is as ``tokenizers`` does it, without special tokens around a text, and with special strings inside one as its
default has it. The same ranks in ``tiktoken`` give the same counts several times faster, so texts of the blocks where
both engines' character classes were compared (Latin, common punctuation) take that way; all others take ``tokenizers``.

Defined cases: null text is empty and has 0 tokens; repeated rows return repeated rows; null ids are kept; other columns
are ignored; an empty table gives no rows and leaves the cache as it is. A cache that was appended to twice (a retried
job) holds equal counts twice, and is read distinct.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, fresh_dir, in_bitmap, stash, table, text_bytes

#: Misses up to which a bitmap of them is sent to the tasks, so that no text is shuffled (16 MB at most).
FEW = 2_000_000
#: Texts that hold any other character are counted by ``tokenizers`` itself.
_COMPARED = regex.compile(r"[\t\n\r\x20-\x7E¡-¬®-ɏ‐-‧€]*")
#: How byte-level vocabularies of this family split a text (fixed pattern of the public tokenizer).
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def _engines(path: str):
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = [x["content"] for x in model["added_tokens"]]
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    ordered = [vocab[a + b] for a, b in pairs]
    pre = model["pre_tokenizer"]
    plain = pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer")
    if not plain or ordered != sorted(ordered) or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in model["added_tokens"]):
        return whole, None, None
    fast = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
    return whole, fast, regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    whole, fast, special = _engines(path)
    out, slow = [0] * len(texts), []
    for i, text in enumerate(texts):
        if not text:
            continue
        if fast is None or not _COMPARED.fullmatch(text):
            slow.append(i)
            continue
        parts = special.split(text)
        out[i] = len(parts) - 1 + sum(len(fast.encode_ordinary(x)) for x in parts if x)
    for i in slow:
        out[i] = len(whole.encode(texts[i], add_special_tokens=False).ids)
    return out


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _encoder(path: str, version: str, wanted=None):
    """Counts of texts; of those alone whose key ``wanted``, a bitmap, has, if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
                batch = batch.take(pa.array(in_bitmap(wanted.value, keys)))
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n = count_tokens(part.column("text").to_pylist(), path)
                cells = [part.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())]
                yield pa.record_batch(cells, ["digest", "version", "n_tokens"])

    return run


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    schema = "digest string, version string, n_tokens long"
    try:
        found = spark.read.schema(schema).parquet(cache)
    except AnalysisException as e:  # there is no cache yet
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        found = spark.createDataFrame([], schema)
    return found.filter(F.col("version") == version).select("digest", "n_tokens").distinct()


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit). ``cache`` is a folder of a store that all executors share."""
    spark, version = docs.sparkSession, version_of(path)
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    slim = stash(texts.select("doc_id", "digest", text_bytes(texts).alias("n_bytes")), "digests")
    lacking = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).join(cached(spark, cache, version), "digest", "left_anti")
    lacking = stash(lacking.select("digest", "first"), "misses")
    # a document stands for its digest; an id that repeats, or is null, may stand for it more than once
    kinds = "digest string, version string, n_tokens long"
    if lacking.count() <= FEW:
        key = F.xxhash64("digest", "first").alias("key")
        wanted = spark.sparkContext.broadcast(bitmap(lacking.select(key), "key"))
        ask = texts.select("digest", "text", F.xxhash64("digest", "doc_id").alias("key"))
        encoded = ask.mapInArrow(_encoder(path, version, wanted), kinds)
    else:
        stands = (texts["digest"] == lacking["digest"]) & texts["doc_id"].eqNullSafe(lacking["first"])
        ask = texts.join(lacking, stands, "left_semi").select("digest", "text")
        encoded = ask.mapInArrow(_encoder(path, version), kinds)
    encoded.write.mode("append").parquet(cache)
    return slim.join(cached(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_dir(spark, "token-cache"))
