"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Writing: tasks write a file each to a shared folder, under a name of their own for each attempt; only files that a
finished task has reported belong to the archive. A payload that other pages repeat is stored once, as the response of
the smallest page_id, and the others are revisit records that name its digest and URI.

Reading: files are cut into byte ranges of ``split`` bytes. A task scans its range for gzip magic, takes a place for a
member if its first bytes decode to the head of a WARC record, and owns the records whose member starts inside, reading
beyond its end as the last one needs.

Defined cases: null html is an empty payload, null url an empty URI; payloads under 100 bytes, empty ones too, are all
responses; of repeated rows, all with the smallest page_id are responses; a null page_id is kept as null, and is never
the smallest unless all are null; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, stash, table

MAGIC = b"\x1f\x8b\x08"
LEAST = 100
#: Repeated digests up to which they are sent to all tasks (about 100 bytes each).
FEW_DIGESTS = 200_000
SPLIT = 4 << 20
_CHUNK = 1 << 20
_DATE = "2024-01-01T00:00:00Z"


def _open_dir(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def decisions(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to): refers_to is the response's page_id where the payload is a repeat."""
    some = lambda c: F.coalesce(pages[c].cast("string"), F.lit(""))
    p = pages.select(pages[page_id].cast("long").alias("page_id"), some(url).alias("url"), some(html).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    long = F.length("payload") >= LEAST
    by = p.filter(long).groupBy("digest").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    again = stash(by.filter("n > 1").select("digest", "low"), "repeats")
    # sent to the tasks while they are few, so that no payload is shuffled; short payloads have no part in the join
    again = F.broadcast(again) if again.count() <= FEW_DIGESTS else again
    out = p.join(again.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & long, "left")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("low"))
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("low").isNotNull() & later, F.col("low")).alias("refers_to"))


def _record(page: int | None, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    ident = "" if page is None else str(page)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{ident}:{digest}")
    clean = re.sub(r"[\r\n]", " ", url)
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", ident),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers is not None:
        first = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers}:{digest}")
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{first}>"),
            ("X-Refers-To-Page", str(refers)),
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if refers is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8") + body + b"\r\n\r\n"


def _writer(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open_dir(uri)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    store.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                press = zlib.compressobj(5, zlib.DEFLATED, 31)
                member = press.compress(_record(page, url, payload, digest, refers)) + press.flush()
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["name", "size", "records"])

    return run


def write_archive(rows: DataFrame, uri: str) -> DataFrame:
    """Write ``decisions`` rows below ``uri``; the manifest (name, size, records), a row a file."""
    return stash(rows.mapInArrow(_writer(uri), "name string, size long, records long"), "manifest")


def _members(read, start: int, end: int, size: int) -> Iterator[bytes]:
    """The records of the members that start in start..end. read(offset, n) gives bytes of the file."""
    at = start
    while at < end:
        window = read(at, min(_CHUNK, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        found = _decode(read, at, size)
        if found is None:
            at += 1
            continue
        record, length = found
        yield record
        at += length


def _decode(read, at: int, size: int) -> tuple[bytes, int] | None:
    """The whole member at ``at`` and its length; None where no record starts."""
    inflate, parts, used, checked = zlib.decompressobj(31), [], 0, False
    while not inflate.eof:
        if at + used >= size:
            return None
        data = read(at + used, 4096 if not used else 1 << 18)
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            return None
        used += len(data)
        if not checked and (inflate.eof or sum(map(len, parts)) >= 10):
            if not b"".join(parts).startswith(b"WARC/1."):
                return None
            checked = True
    return b"".join(parts), used - len(inflate.unused_data)


def parse(record: bytes) -> dict[str, object]:
    """Header fields (in lower case), the block, and the payload after the HTTP head."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return {"fields": fields, "block": block, "payload": block.partition(b"\r\n\r\n")[2]}


def _reader(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open_dir(uri)
        for batch in batches:
            for name, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "start", "end"))):
                rows: list[tuple] = []
                with store.open_input_file(f"{path}/{name}") as file:

                    def read(offset: int, n: int, file=file, size=size) -> bytes:
                        file.seek(offset)
                        return file.read(max(0, min(n, size - offset)))

                    for record in _members(read, start, end, size):
                        rows.append(_row(parse(record)))
                        if len(rows) == 256:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return run


def _row(got: dict) -> tuple:
    """Of a parsed record, a row of _OUT: a response's size and digest are those of its payload, a revisit's are told."""
    f = got["fields"]
    page = int(f["x-page-id"]) if f["x-page-id"] else None
    if f["warc-type"] == "response":
        payload = got["payload"]
        return page, f["warc-target-uri"], "response", len(payload), hashlib.sha256(payload).hexdigest(), None, payload
    digest = f["warc-payload-digest"].removeprefix("sha256:")
    return page, f["warc-target-uri"], "revisit", int(f["x-payload-length"]), digest, int(f["x-refers-to-page"]), None


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_OUT = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in _FIELDS.split(", "))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def read_archive(manifest: DataFrame, uri: str, split: int = SPLIT) -> DataFrame:
    """Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload), the payload of revisits null."""
    starts = manifest.filter("size > 0").select("name", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = starts.select("name", "size", "start", F.least(F.col("start") + split, F.col("size")).alias("end"))
    n = max(1, ranges.count())
    return ranges.repartition(n, "name", "start").mapInArrow(_reader(uri), _FIELDS)


def round_trip(pages: DataFrame, uri: str | None = None, split: int = SPLIT) -> DataFrame:
    uri = uri or fresh_dir(pages.sparkSession, "warc")
    return read_archive(write_archive(decisions(pages), uri), uri, split)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, cast(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS low FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > low THEN low END AS refers_to
FROM r
"""
