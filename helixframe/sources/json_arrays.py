"""Records of a large JSON array, read in splits.

A text source cuts the file at closing braces, each piece to the split it starts in. Whether a brace is inside a string, how
deep it is, and whether it is in the wanted array depends on all that comes before; so a first scan tells what each split
would do to these from either start (inside a string or not), the splits of a file are put in a row, and a second scan
starts each split as the one before it ends, and writes what it finds. A record that goes on in later splits is put
together from its parts.

The array is the document itself, or a field of an object that is the document. Its records are the objects that stand
right in it. A file whose braces or quotes do not match gives no records, but for a last brace that is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import fresh_dir

_OPEN, _CLOSE, _QUOTE, _SLASH = (ord(c) for c in '{}"\\')
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
#: Pieces that are scanned at once.
_BATCH = 4_096
_SUMMARY = "file string, start long, odd boolean, root string, " + ", ".join(f"delta{s} long, low{s} long, opens{s} array<array<long>>" for s in (0, 1))


def _marks(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that begin or end a string: those after an even run of backslashes."""
    at = np.flatnonzero(data == _QUOTE)
    if len(at) and (data == _SLASH).any():
        other = np.where(data != _SLASH, np.arange(len(data)), -1)
        last = np.maximum.accumulate(other)
        before = np.where(at > 0, last[at - 1], -1)
        at = at[(at - 1 - before) % 2 == 0]
    return at


def _scan(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and steps of depth outside strings, and how many quotes there are."""
    marks = _marks(data)
    at = np.flatnonzero(_STEP[data] != 0)
    outside = (np.searchsorted(marks, at) + inside) % 2 == 0
    at = at[outside]
    return at, _STEP[data[at]].astype(np.int64), len(marks)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start of the split, some of its pieces), in order."""
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
        values = batch.column("value").to_pylist()
        cuts = [0, *(i for i in range(1, len(starts)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]), len(starts)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for i in range(lo, hi, _BATCH):
                yield files[lo], int(starts[lo]), b"".join(v + b"}" for v in values[i : min(i + _BATCH, hi)])


def _summaries(field: bytes):
    named = re.compile(rb'(?<!\\)"' + re.escape(field) + rb'"\s*:\s*$')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def told():
            cells = [[now[0]], [now[1]], [held["quotes"] % 2 == 1], [held["root"]]]
            for s in (0, 1):
                cells += [[held[s][0]], [held[s][1]], [held[s][2]]]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), *[pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64()))] * 2]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds)], [x.split()[0] for x in _SUMMARY.split(", ")])

        for file, start, raw in _pieces(batches):
            if (file, start) != now:
                if now:
                    yield told()
                # of each start: depth gained, the least depth on the way, and where a field's array opens: depth before it, and the least after
                now, held = (file, start), {"quotes": 0, "root": None, 0: [0, 0, []], 1: [0, 0, []]}
            data = np.frombuffer(raw, np.uint8)
            if held["root"] is None and (head := raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]):
                held["root"] = head.decode("latin-1")
            for s in (0, 1):
                at, step, quotes = _scan(data, (s + held["quotes"]) % 2 == 1)
                depth, low, opens = held[s]
                after = depth + np.cumsum(step)
                lowest = int(after.min()) if len(after) else depth
                opens = [[d, min(m, lowest)] for d, m in opens]
                for i in np.flatnonzero(data[at] == ord("[")):
                    if named.search(raw, max(0, int(at[i]) - 256), int(at[i])):
                        opens.append([int(after[i]) - 1, int(after[i:].min())])
                held[s] = [int(after[-1]) if len(after) else depth, min(low, lowest), opens]
            held["quotes"] += quotes
        if now:
            yield told()

    return run


def _starts(part: pa.Table) -> pa.Table:
    """How each split of a file starts: inside a string, at which depth, in the array, and the depth of records."""
    rows = sorted(part.to_pylist(), key=lambda r: r["start"])
    inside, depth, within, base, out = False, 0, False, None, []
    for r in rows:
        if base is None and r["root"]:
            base = 1 if r["root"] == "[" else 2
            within = base == 1
        out.append((inside, depth, within, base or 2))
        s = int(inside)
        least = lambda low: depth + low >= (base or 2)
        within = (within and (least(r[f"low{s}"]) or (base == 1 and depth == 0))) or any(base == 2 and depth + d == 1 and least(low) for d, low in r[f"opens{s}"])
        inside, depth = inside != r["odd"], depth + r[f"delta{s}"]
    # a file that does not end in a brace has one more here, of its last piece
    matched = not inside and depth in (0, -1)
    names = ("file", "start", "inside", "depth", "within", "base")
    columns = dict(zip(names, ([r["file"] for r in rows], [r["start"] for r in rows], *map(list, zip(*out)))))
    return pa.table(columns).slice(0, None if matched else 0)


def _records(field: bytes, state: dict[tuple[str, int], tuple[bool, int, bool, int]]):
    named = re.compile(rb'(?<!\\)"' + re.escape(field) + rb'"\s*:\s*$')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, 0
        inside = depth = within = base = open_ = None
        tail: list[bytes] = []

        def told(rows):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], ["file", "start", "n", "begins", "ends", "body"])

        for file, start, raw in _pieces(batches):
            rows = []
            if (file, start) != now:
                if now and open_:
                    rows.append((*now, count, begun, False, b"".join(tail)))
                now, count, begun, tail = (file, start), 0, False, []
                inside, depth, within, base = state.get(now, (False, 0, False, 1))
                known = now in state
                open_ = within and depth > base
            if not known:
                continue
            data = np.frombuffer(raw, np.uint8)
            at, step, quotes = _scan(data, inside)
            after = depth + np.cumsum(step)
            first = 0
            for i, place in enumerate(at.tolist()):
                kind, d = raw[place], int(after[i])
                if kind == 0x5B and d == base and (base == 1 or named.search(raw, max(0, place - 256), place)):
                    within = True
                elif kind == 0x5D and d == base - 1:
                    within = False
                elif within and kind == _OPEN and d == base + 1:
                    open_, first, begun = True, place, True
                elif within and open_ and kind == _CLOSE and d == base:
                    rows.append((*now, count, begun, True, b"".join([*tail, raw[first : place + 1]])))
                    open_, tail, count, begun = False, [], count + 1, False
            if open_:
                tail.append(raw[first:])
            inside, depth = inside != (quotes % 2 == 1), int(after[-1]) if len(after) else depth
            yield told(rows)
        if now and open_:
            yield told([(*now, count, begun, False, b"".join(tail))])

    return run


def read_json_array(spark: SparkSession, path: str, field: str = "data") -> DataFrame:
    """(file, pos, value): the objects of a JSON array, or of the array in ``field`` of an object, as text; ``pos`` orders those of a file."""
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    name = field.encode()
    told = pieces.mapInArrow(_summaries(name), _SUMMARY)
    starts = told.groupBy("file").applyInArrow(_starts, "file string, start long, inside boolean, depth long, within boolean, base long")
    # a row a split
    state = {(r["file"], r["start"]): (r["inside"], r["depth"], r["within"], r["base"]) for r in starts.collect()}
    kinds = "file string, start long, n long, begins boolean, ends boolean, body binary"
    work = fresh_dir(spark, "records")
    pieces.mapInArrow(_records(name, state), kinds).write.parquet(work)
    parts = spark.read.schema(kinds).parquet(work)
    pos = F.struct("start", "n").alias("pos")
    whole = parts.filter("begins and ends").select("file", pos, F.col("body").cast("string").alias("value"))
    # of each split its last, and of the next ones what goes on: two parts a split at most
    cut = parts.filter("not (begins and ends)")
    order = Window.partitionBy("file").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("pos", F.last(F.when(F.col("begins"), F.struct("start", "n")), True).over(order)).filter("pos is not null")
    joined = cut.groupBy("file", "pos").agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("start", "n", "body"))).alias("all"))
    body = F.aggregate("all", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["body"]))
    return whole.union(joined.filter("ends").select("file", "pos", body.cast("string").alias("value")))
