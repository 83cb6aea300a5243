"""What is to be downloaded, and fetching it. Only the steps that are named so fetch anything."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators.relational import constants
from ..schemas import REGISTRY
from .tables import put_bytes, store_of

# Address, file name and label of each source.
SOURCES = (
    ("https://scop.berkeley.edu/downloads/parse/dir.cla.scope.2.08-stable.txt", "scope_cla.txt", "SCOPe 2.08 classification"),
    ("https://scop.berkeley.edu/downloads/parse/dir.des.scope.2.08-stable.txt", "scope_des.txt", "SCOPe 2.08 descriptions"),
    ("https://scop.berkeley.edu/downloads/scopeseq-2.08/astral-scopedom-seqres-gd-sel-gs-bib-40-2.08.fa", "scope_astral_40.fa", "SCOPe ASTRAL 40% domain representatives"),
    ("https://www.cathdb.info/version/v4_3_0/api/rest/domain_summary", "cath_domain_list.txt", "CATH v4.3 domain list"),
    ("http://prodata.swmed.edu/ecod/distributions/ecod.latest.domains.txt", "ecod_domains.txt", "ECOD domain list"),
)
STRUCTURE_URL = "https://files.rcsb.org/download/{}.cif.gz"

#: Bytes that are committed together.
_PIECE = 8 << 20
_RESULT = "name string, ok boolean, length long, error string"


def registry(spark: SparkSession) -> DataFrame:
    return constants(spark, list(SOURCES), *[f.split()[0] for f in REGISTRY.split(", ")])


def pending(ids: DataFrame, files: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(pdb_id, url) of structures without a file of more than the least size. files: (path, length)."""
    wanted = ids.select(F.lower("structure_id").alias("pdb_id")).filter("pdb_id <> ''").distinct()
    there = files.filter(F.col("length") > config.downloaded_above_bytes)
    there = there.select(F.regexp_extract("path", r"([^/]+)\.cif\.gz$", 1).alias("pdb_id"))
    before, after = STRUCTURE_URL.split("{}")
    url = F.concat(F.lit(before), F.upper("pdb_id"), F.lit(after)).alias("url")
    return wanted.join(there, "pdb_id", "left_anti").select("pdb_id", url).orderBy("pdb_id")


class _Cut(Exception):
    """A body that ended before its length."""


def _pieces(url: str, folder: str, timeout: int) -> int:
    """Fetch what is missing of a body into pieces in ``folder``, each named by its offset and committed by a rename, so that
    an attempt goes on where the last one, here or in another task, broke off. The body's size. Where the server gives no
    ranges, or has another version by now, the pieces are dropped and the body is fetched from its start."""
    store, inner = store_of(folder)
    selector = pafs.FileSelector(inner, allow_not_found=True)
    held = sorted((i for i in store.get_file_info(selector) if i.base_name.isdigit()), key=lambda i: int(i.base_name))
    at = 0
    for i in held:
        if int(i.base_name) != at:
            break
        at += i.size
    tag_file = f"{inner}/tag"
    tag = ""
    if at and store.get_file_info(tag_file).type == pafs.FileType.File:
        with store.open_input_stream(tag_file, compression=None) as f:
            tag = f.read().decode()
    ask = urllib.request.Request(url, headers={"Range": f"bytes={at}-"} | ({"If-Range": tag} if tag else {}) if at and tag else {})
    try:
        body = urllib.request.urlopen(ask, timeout=timeout)
    except urllib.error.HTTPError as e:
        if e.code == 416 and at:  # nothing is missing, or the body is another
            if e.headers.get("Content-Range", "").rpartition("/")[2] == str(at):
                return at
            store.delete_dir_contents(inner, missing_dir_ok=True)
        raise
    with body:
        if at and getattr(body, "status", None) != 206:
            store.delete_dir_contents(inner, missing_dir_ok=True)
            at = 0
        now = body.headers.get("ETag") or body.headers.get("Last-Modified") or ""
        if now and not at and not now.startswith("W/"):
            put_bytes(f"{folder}/tag", [now.encode()])
        length = body.headers.get("Content-Length")
        whole = at + int(length) if length else None
        while True:
            part, cut = [], None
            size = 0
            try:
                while size < _PIECE and (chunk := body.read1(1 << 16) if hasattr(body, "read1") else body.read(1 << 16)):
                    part.append(chunk)
                    size += len(chunk)
            except (OSError, http.client.HTTPException) as e:
                cut = e
            if size:
                put_bytes(f"{folder}/{at}", part)
                at += size
            if cut:
                raise cut
            if size < _PIECE:
                break
        if whole is not None and at < whole:
            raise _Cut(f"{at} of {whole} bytes")
    return at


def _join(folder: str, target: str) -> int:
    """The pieces as one file, and without them; none make an empty file."""
    store, inner = store_of(folder)
    found = sorted((i for i in store.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if i.base_name.isdigit()), key=lambda i: int(i.base_name))

    def chunks() -> Iterator[bytes]:
        for i in found:
            with store.open_input_stream(i.path, compression=None) as f:
                while chunk := f.read(1 << 20):
                    yield chunk

    size = put_bytes(target, chunks())
    if store.get_file_info(inner).type == pafs.FileType.Directory:
        store.delete_dir(inner)
    return size


def _lasting(e: Exception) -> bool:
    """Whether another attempt would end the same way."""
    if isinstance(e, urllib.error.HTTPError):
        return e.code < 500 and e.code not in (408, 416, 425, 429)
    return isinstance(e, urllib.error.URLError) and isinstance(e.reason, (FileNotFoundError, str))


def fetch(plan: DataFrame, folder: str, timeout: int, tasks: int, attempts: int = 4, wait_s: float = 0.5) -> DataFrame:
    """Runs a plan (name, url): rows (name, ok, length, error). Bodies go to files below ``folder``, in any store that all
    executors reach. Certificates are verified. A failure is a row.

    What has come of a body is committed in pieces in a folder beside its file, so attempts, retried tasks and later runs ask
    for the rest alone, by range. Attempts wait twice as long each time. ``tasks`` is how many files a host is asked for at
    once: its addresses are dealt to so many groups, each in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, url in zip(batch.column("name").to_pylist(), batch.column("url").to_pylist()):
                pieces = f"{folder}/.{name}.pieces"
                for attempt in range(attempts):
                    try:
                        _pieces(url, pieces, timeout)
                        rows.append((name, True, _join(pieces, f"{folder}/{name}"), ""))
                        break
                    except Exception as e:  # each failure is a row
                        if attempt + 1 == attempts or _lasting(e):
                            rows.append((name, False, 0, str(e) or type(e).__name__))
                            break
                        time.sleep(wait_s * 2**attempt)
            types = [pa.string(), pa.bool_(), pa.int64(), pa.string()]
            cells = list(zip(*rows)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, types)], ["name", "ok", "length", "error"])

    host = F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit(""))
    dealt = plan.select("name", "url", host.alias("host"), F.pmod(F.xxhash64("name"), F.lit(tasks)).alias("slot"))
    return dealt.repartition(tasks, "host", "slot").select("name", "url").mapInArrow(run, _RESULT)


def fetch_registry(sources: DataFrame, folder: str, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Fetches rows (url, dest, label): (name, ok, length, error)."""
    plan = sources.select(F.col("dest").alias("name"), "url")
    return fetch(plan, folder, config.registry_timeout_s, config.download_workers)


def fetch_structures(plan: DataFrame, folder: str, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Fetches rows (pdb_id, url): (pdb_id, ok, length, error)."""
    named = plan.select(F.concat("pdb_id", F.lit(".cif.gz")).alias("name"), "url")
    found = fetch(named, folder, config.structure_timeout_s, config.download_workers)
    return found.select(F.regexp_replace("name", r"\.cif\.gz$", "").alias("pdb_id"), "ok", "length", "error")


def download_failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("ok")).select("pdb_id", "error")
