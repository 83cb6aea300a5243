"""Residues, contacts, relations of contacts, and their counts by chain."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.scalar import fraction

CHAIN = ["structure_id", "chain_id"]
#: Residue numbers that a tile of a chain spans, in counting relations.
TILE = 2_048
#: Residue numbers that a tile spans where contacts are found and counted in blocks of two tiles, and cells compared at once.
BLOCK, CELLS = 16_384, 1 << 18
# The standard residues, and common modified or ambiguous ones that count as amino acids.
AMINO_ACIDS = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO",
    "SER", "THR", "TRP", "TYR", "VAL", "ASX", "GLX", "SEC", "PYL", "XLE", "UNK", "MSE", "SEP", "TPO", "PTR",
    "CSO", "MLY", "HYP", "KCX", "LLP", "CME", "PCA", "CSD", "OCS", "M3L", "NLE", "CSS", "ALY", "DAL", "SAR",
)


#: Residue names up to which their table is sent to all tasks; a dictionary of components has some thousand.
_FEW_NAMES = 100_000


def protein_atoms(atoms: DataFrame, config: PipelineConfig = PipelineConfig(), known: DataFrame | None = None) -> DataFrame:
    """Atoms of amino acids in the first model that are not hetero residues. Amino acids are those of ``known`` (resname),
    as ``sources.components`` reads them, and of ``more_residues``; where none are given, the usual ones."""
    first = atoms.filter((F.col("model_idx") == 0) & (F.col("het_flag") == " "))
    if known is None:
        return first.filter(F.col("resname").isin(*AMINO_ACIDS, *config.more_residues))
    more = F.explode(F.array(*map(F.lit, config.more_residues)).cast("array<string>"))
    names = known.select("resname").union(known.sparkSession.range(1).select(more.alias("resname"))).distinct()
    names = F.broadcast(names) if names.limit(_FEW_NAMES + 1).count() <= _FEW_NAMES else names
    return first.join(names, "resname", "left_semi").select(atoms.columns)


def chain_stats(atoms: DataFrame, config: PipelineConfig = PipelineConfig(), known: DataFrame | None = None) -> DataFrame:
    """(structure, chain) residue counts and range, of protein residues."""
    residue = ["structure_id", "source_path", "file_format", "chain_id", "chain_pos", "res_pos", "resseq"]
    one = protein_atoms(atoms, config, known).select(residue).distinct()
    by = one.groupBy("structure_id", "source_path", "file_format", "chain_id", "chain_pos")
    out = by.agg(F.count(F.lit(1)).cast("int").alias("residue_count"), F.min("resseq").alias("min_resseq"), F.max("resseq").alias("max_resseq"))
    return out.withColumn("resolved_residue_count", F.col("residue_count"))


def residues(atoms: DataFrame, config: PipelineConfig = PipelineConfig(), known: DataFrame | None = None) -> DataFrame:
    """(structure, chain, pos, seq, x, y, z): the first representative atom that each residue has."""
    point = F.struct("x", "y", "z")
    best = [F.max(F.when(F.col("atom_name") == a, point)) for a in config.representative_atoms]
    key = ["structure_id", "source_path", "file_format", "chain_id"]
    held = protein_atoms(atoms, config, known).filter(F.col("atom_name").isin(*config.representative_atoms))
    by = held.groupBy(*key, F.col("res_pos").alias("pos"), F.col("resseq").alias("seq"))
    return by.agg(F.coalesce(*best).alias("p")).filter("p is not null").select(*key, "pos", "seq", "p.x", "p.y", "p.z")


def contacts(points: DataFrame, distance: float = 8.0, separation: int = 4, key: list[str] = CHAIN) -> DataFrame:
    """(key, lo, hi) of residues close in space and apart in sequence.

    Squares are single precision and their sum double, so that a pair at the very threshold is decided as by
    single-precision coordinates. Points are joined by cells of a grid as wide as the distance (and a little more, for
    rounding): each is sent to its own cell and the 13 neighbours on one side of it, so a pair meets once, and a long
    chain is dealt to many tasks.
    """
    size = float(distance) * (1 + 1e-5) or 1e-30
    own = points.select(*key, "pos", "seq", *"xyz", *[F.floor(F.col(c).cast("double") / F.lit(size)).alias(f"{c}_cell") for c in "xyz"])
    side = [(i, j, k) for i in (0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    cell = lambda at: F.struct(*[(F.col(f"{c}_cell") + n).alias(c) for c, n in zip("xyz", at)], F.lit(any(at)).alias("other"))
    near = own.withColumn("cell", F.explode(F.array(*map(cell, side))))
    a, b = own.alias("a"), near.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col(f"a.{c}_cell") == F.col(f"b.cell.{c}") for c in "xyz"]
    square = sum((x * x).cast("double") for x in (F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"))
    apart = F.abs(F.col("b.seq") - F.col("a.seq")) >= separation
    once = F.when(F.col("b.cell.other"), F.col("a.pos") != F.col("b.pos")).otherwise(F.col("a.pos") < F.col("b.pos"))
    found = once & apart & (square <= F.lit(float(distance)) * F.lit(float(distance)))
    for c in on:
        found = found & c
    ends = F.least("a.seq", "b.seq").alias("lo"), F.greatest("a.seq", "b.seq").alias("hi")
    return a.join(b, found).select(*[F.col(f"a.{k}").alias(k) for k in key], *ends)


def relation(i, j, k, l) -> F.Column:  # noqa: E741
    """Of contacts (i, j) and (k, l): series, parallel or cross; null if they share an end."""
    shared = (i == k) | (i == l) | (j == k) | (j == l)
    nested = ((i < k) & (l < j)) | ((k < i) & (j < l))
    return F.when(shared, None).when((j < k) | (l < i), "series").when(nested, "parallel").otherwise("cross")


def contact_relations(found: DataFrame, key: list[str] = CHAIN) -> DataFrame:
    """Every unordered pair of a chain's contacts with four distinct ends, and its relation.

    The pairs are many where the contacts are few, so a chain's contacts are dealt to many tasks on one side, and all go to
    each on the other. These tasks are not put together by size, as they are little to read and much to do.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("lo", "hi"), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    sides = ((part, "a"), (every, "b"))
    # one column to join by, as a constant key would be left out of several, and the dealing with it
    dealt = [found.dropna(subset=key).withColumn("part", p).select("lo", "hi", F.struct(*key, "part").alias("deal")).repartition(4 * parts, "deal").alias(s) for p, s in sides]
    on = (F.col("a.deal") == F.col("b.deal")) & ((F.col("a.lo") < F.col("b.lo")) | ((F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") < F.col("b.hi"))))
    for i in ("lo", "hi"):
        for j in ("lo", "hi"):
            on = on & (F.col(f"a.{i}") != F.col(f"b.{j}"))
    # equal contacts share their ends, so they are no pair, and the strict order loses none
    ends = [(f"{s}.{c}", f"{s}_{c}") for s in "ab" for c in ("lo", "hi")]
    kind = relation(*[F.col(c) for c, _ in ends]).alias("relation")
    return dealt[0].join(dealt[1].hint("shuffle_hash"), on).select(*[F.col(f"a.deal.{k}").alias(k) for k in key], *[F.col(c).alias(n) for c, n in ends], kind)


def inversions(v: np.ndarray) -> int:
    """Pairs p < q of places with v[p] > v[q], for numbers from 0: by the highest bit in which they differ."""
    total, order = 0, np.arange(len(v))
    for bit in range(int(v.max()).bit_length() - 1 if len(v) else -1, -1, -1):
        group = v[order] >> (bit + 1)
        one = v[order] >> bit & 1
        ones = np.cumsum(one)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        before = np.repeat(ones[first] - one[first], np.diff(np.append(first, len(v))))
        total += int((ones - before)[one == 0].sum())
        order = order[np.lexsort((order, v[order] >> bit))]
    return total


def _pairs(counts: np.ndarray) -> int:
    return int((counts.astype(np.int64) * (counts - 1) // 2).sum())


def _tile_counts(lo: np.ndarray, hi: np.ndarray, kind: np.ndarray, width: int) -> dict[str, int]:
    """What one tile of residues tells of a chain's pairs. ``kind`` says which end of a contact is in it: the lower (0), the
    upper (1), or both (2).

    Nested pairs whose lower ends share the tile are inversions of hi in order of (lo, hi); those of other lower tiles whose
    upper ends share it are inversions of hi in order of (tile of lo, hi). Series pairs that meet here have one upper end and
    one lower end in the tile. Pairs with a common end meet in its tile; equal contacts share both.
    """
    below, above = kind != 1, kind != 0
    order = np.lexsort((hi[below], lo[below]))
    low, high = lo[below][order], hi[below][order]
    ends = hi[above]
    order = np.lexsort((ends, lo[above] // width))
    after = np.searchsorted(low, ends, "right")
    first = np.flatnonzero((np.diff(low, prepend=0) != 0) | (np.diff(high, prepend=0) != 0) | (np.arange(len(low)) == 0))
    shared = _pairs(np.unique(low, return_counts=True)[1]) + _pairs(np.unique(ends, return_counts=True)[1])
    shared += int((after - np.searchsorted(low, ends, "left")).sum()) - _pairs(np.diff(np.append(first, len(low))))
    rank = lambda v: np.unique(v, return_inverse=True)[1]
    return {
        "lower": len(low),
        "upper": len(ends),
        "series": int((len(low) - after).sum()),
        "parallel": inversions(rank(high)) + inversions(rank(ends[order])),
        "shared": shared,
    }


def _between_tiles(tile: np.ndarray, lower: np.ndarray, upper: np.ndarray, cells: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Series and nested pairs that share no tile, from each tile's counts in order, and its contacts by tile of the upper end."""
    above = lower.sum() - np.cumsum(lower)
    series = sum(int(u) * int(a) for u, a in zip(upper, above))
    place = {int(t): i for i, t in enumerate(tile)}
    seen, nested = np.zeros(len(tile), np.int64), 0
    for ends, counts in reversed(cells):  # from the highest lower tile
        if len(ends):
            at = np.array([place[int(e)] for e in ends])
            inside = np.cumsum(seen) - seen
            nested += int(counts.astype(object) @ inside[at].astype(object))  # of Python's numbers, as it may exceed a bigint
            seen[at] += counts
    return series, nested


def count_relations(lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, int]:
    """Series, parallel and cross pairs of contacts lo < hi, by sorting: pairs are counted, never made."""
    n = len(lo)
    if not n:
        return 0, 0, 0
    width = int(hi.max()) - int(lo.min()) + 1
    low = int(lo.min())
    told = _tile_counts(lo.astype(np.int64) - low, hi.astype(np.int64) - low, np.full(n, 2), width)
    return told["series"], told["parallel"], n * (n - 1) // 2 - told["series"] - told["parallel"] - told["shared"]


def relation_counts(found: DataFrame, key: list[str] = CHAIN, tile: int = TILE) -> DataFrame:
    """(key, contact_count, contact_pair_count, series, parallel and cross counts); pairs are counted, never made.

    A chain's residues are cut into tiles, and a contact goes to the tile of each of its ends. A task counts the pairs that
    share a tile, of its own tiles; the rest are told by how many contacts join each two tiles. So a chain is no one group:
    a tile's contacts are bounded by its residues, and the last step has a row a tile.
    """
    spans = found.select(*key, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    of = lambda end: F.floor(F.col(end) / F.lit(tile))
    each = F.when(of("lo") == of("hi"), F.array(F.struct(of("lo").alias("tile"), F.lit(2).alias("kind"))))
    each = each.otherwise(F.array(*[F.struct(of(c).alias("tile"), F.lit(k).alias("kind")) for k, c in enumerate(("lo", "hi"))]))
    spans = spans.withColumn("at", F.explode(each)).select(*key, "at.tile", "at.kind", "lo", "hi")
    kinds = ", ".join(f"{k} {found.schema[k].dataType.simpleString()}" for k in key)

    lists = lambda v: pa.array([v], pa.list_(pa.int64()))

    def count(part: pa.Table) -> pa.Table:
        lo, hi, kind = (part.column(c).to_numpy() for c in ("lo", "hi", "kind"))
        told = _tile_counts(lo, hi, kind, tile)
        ends, counts = np.unique(hi[kind != 1] // tile, return_counts=True)
        own = {k: part.column(k).slice(0, 1) for k in [*key, "tile"]}
        return pa.table(own | {k: [v] for k, v in told.items()} | {"ends": lists(ends), "counts": lists(counts)})

    tiled = spans.groupBy(*key, "tile").applyInArrow(count, f"{kinds}, {_TILED}")
    return _added(tiled, key, kinds).withColumn("contact_count", F.col("contact_count").cast("int"))


_TILED = "tile long, lower long, upper long, series long, parallel long, shared long, ends array<long>, counts array<long>"


def _added(tiled: DataFrame, key: list[str], kinds: str, wide: bool = False) -> DataFrame:
    """Counts by chain, of what its tiles tell: bigint, or decimals of 38 digits if ``wide``."""
    number, whole = ("decimal(38,0)", pa.decimal128(38, 0)) if wide else ("bigint", pa.int64())

    def add(part: pa.Table) -> pa.Table:
        part = part.sort_by("tile")
        column = lambda c: part.column(c).to_numpy()
        cells = [(np.array(e), np.array(c)) for e, c in zip(part.column("ends").to_pylist(), part.column("counts").to_pylist())]
        series, nested = _between_tiles(column("tile"), column("lower"), column("upper"), cells)
        told = {c: sum(part.column(c).to_pylist()) for c in ("lower", "series", "parallel", "shared")}
        n, s, p = told["lower"], series + told["series"], nested + told["parallel"]
        x = n * (n - 1) // 2 - s - p - told["shared"]
        counts = {"contact_count": n} | {f"{k}_pair_count": v for k, v in (("contact", s + p + x), ("series", s), ("parallel", p), ("cross", x))}
        return pa.table({k: part.column(k).slice(0, 1) for k in key} | {k: pa.array([Decimal(v) if wide else v], whole) for k, v in counts.items()})

    out = f"{kinds}, contact_count {number}, " + ", ".join(f"{k}_pair_count {number}" for k in ("contact", "series", "parallel", "cross"))
    return tiled.groupBy(*key).applyInArrow(add, out)


def _block_counts(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], square: float, separation: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Contacts of residues of a tile with those of the same or a later one, each (seq, x, y, z) by seq: how many each residue
    number of either has, how many pairs are nested, and how many are of equal contacts. None is kept beyond its rows."""
    starts = [np.flatnonzero(np.diff(t[0], prepend=t[0][0] - 1)) for t in (a, b)]
    ends, several = np.append(starts[0], len(a[0])), len(starts[1]) < len(b[0])
    row, col, nested, equal = np.zeros(len(starts[0]), np.int64), np.zeros(len(starts[1]), np.int64), 0, 0
    step = max(1, CELLS // len(b[0]))
    for r in range(0, len(row), step):
        at = slice(ends[r], ends[min(r + step, len(row))])
        total = 0.0
        for x, y in zip(a[1:], b[1:]):
            d = x[at, None] - y[None, :]
            d *= d
            total = total + d.astype(np.float64)
        met = total <= square
        if b[0][0] - a[0][at.stop - 1] < separation:
            met &= b[0][None, :] - a[0][at, None] >= separation
        if not met.any():
            continue
        if several or at.stop - at.start > min(step, len(row) - r):
            met = np.add.reduceat(np.add.reduceat(met.astype(np.int64), starts[0][r : r + step] - at.start, axis=0), starts[1], axis=1)
            equal += _pairs(met)
        count = met.astype(np.int64)
        # of each cell, contacts of smaller lower and larger upper ends
        before = np.cumsum(count, axis=0) - count + col
        outside = before.sum(axis=1, keepdims=True) - np.cumsum(before, axis=1)
        nested += int(outside[met].sum()) if met.dtype == bool else int((outside * met).sum())
        row[r : r + step] = count.sum(axis=1)
        col += count.sum(axis=0)
    return row, col, nested, equal


def _tile_of_blocks(rows: list[tuple[int, np.ndarray]], cols: list[tuple[int, np.ndarray]], n: int, equal: int) -> dict[str, int]:
    """What ``_tile_counts`` tells, of a tile's counts by residue number: those of contacts from it, by the tile they go to, and
    of contacts to it, by the tile they come from. Pairs of one block are not among them."""
    after = lambda v: v.sum() - np.cumsum(v)
    nested, low, high = 0, np.zeros(n, np.int64), np.zeros(n, np.int64)
    for _, v in sorted(rows, key=lambda x: -x[0]):  # those that go further enclose
        nested += int(v @ (np.cumsum(low) - low))
        low = low + v
    for _, v in sorted(cols, key=lambda x: x[0]):  # those that come from before enclose
        nested += int(v @ after(high))
        high = high + v
    shared = _pairs(low) + _pairs(high) + int(low @ high) - equal
    return {"lower": int(low.sum()), "upper": int(high.sum()), "series": int(high @ after(low)), "parallel": nested, "shared": shared}


def near_counts(points: DataFrame, distance: float = 8.0, separation: int = 4, key: list[str] = CHAIN, tile: int = BLOCK, wide: bool = False) -> DataFrame:
    """``relation_counts`` of the contacts of points, for chains with very many: contacts are found and counted in blocks of
    two tiles of residues, and neither shuffled nor kept. A block tells how many contacts each of its residue numbers has.

    Every two residues are compared, in bounded memory and dealt to tasks by block. What is shuffled is each tile once for
    each tile of its chain, and two numbers a residue and block. Residues at least one number apart can meet.
    Counts are bigint, or decimals of 38 digits if ``wide``.
    """
    if separation < 1:
        raise ValueError("separation is 1 at least")
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in key)
    of = F.floor(F.col("seq") / F.lit(tile)).cast("long").alias("tile")
    held = points.filter("seq is not null").select(*key, of, F.col("seq").cast("long").alias("seq"), *"xyz")
    types = ["<i8", *["<f8" if points.schema[c].dataType.simpleString() == "double" else "<f4" for c in "xyz"]]
    columns = ["seq", *"xyz"]

    def pack(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("seq").to_numpy(), kind="stable")
        cells = {c: pa.array([part.column(c).to_numpy()[order].astype(t).tobytes()], pa.binary()) for c, t in zip(columns, types)}
        return pa.table({k: part.column(k).slice(0, 1) for k in [*key, "tile"]} | cells)

    def block(part: pa.Table) -> pa.Table:
        at = {t: i for i, t in enumerate(part.column("tile").to_pylist())}
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        a, b = ([np.frombuffer(part.column(c)[at[t]].as_buffer(), k) for c, k in zip(columns, types)] for t in (low, high))
        row, col, nested, equal = _block_counts(a, b, float(distance) * float(distance), separation)
        rows = 2 if row.any() else 0
        own = {k: pa.chunked_array([part.column(k).slice(0, 1).combine_chunks()] * 2).slice(0, rows) for k in key}
        cells = {"tile": [low, high], "other": [high, low], "upper": [False, True], "counts": [row.tobytes(), col.tobytes()], "nested": [nested, 0], "equal": [equal, 0]}
        return pa.table(own | {k: pa.array(v[:rows]) for k, v in cells.items()}).cast(blocks)

    def meet(part: pa.Table) -> pa.Table:
        found = [(o, u, np.frombuffer(c, np.int64)) for o, u, c in zip(*(part.column(c).to_pylist() for c in ("other", "upper", "counts")))]
        rows, cols = ([(o, c) for o, u, c in found if u == side] for side in (False, True))
        told = _tile_of_blocks(rows, cols, len(found[0][2]), sum(part.column("equal").to_pylist()))
        told["parallel"] += sum(part.column("nested").to_pylist())
        rows = sorted((o, int(c.sum())) for o, c in rows)
        ends = {c: pa.array([[r[i] for r in rows]], pa.list_(pa.int64())) for i, c in enumerate(("ends", "counts"))}
        return pa.table({k: part.column(k).slice(0, 1) for k in [*key, "tile"]} | {k: [v] for k, v in told.items()} | ends)

    tiles = held.select(*key, "tile").distinct()
    others = tiles.join(tiles.withColumnRenamed("tile", "other"), key).groupBy(*key, "tile").agg(F.collect_list("other").alias("others"))
    packed = held.groupBy(*key, "tile").applyInArrow(pack, f"{kinds}, tile long, " + ", ".join(f"{c} binary" for c in columns))
    sent = packed.join(others, [*key, "tile"]).withColumn("other", F.explode("others")).drop("others")
    sent = sent.select(*key, "tile", *columns, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    # a block is little to read and much to do, so its tasks are not put together by size
    parts = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = f"{kinds}, tile long, other long, upper boolean, counts binary, nested long, equal long"
    arrow = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
    blocks = pa.schema([(n, arrow[t]) for n, t in (f.split() for f in told.split(", "))])
    found = sent.repartition(parts, *key, "low", "high").groupBy(*key, "low", "high").applyInArrow(block, told)
    return _added(found.groupBy(*key, "tile").applyInArrow(meet, f"{kinds}, {_TILED}"), key, kinds, wide)


def narrowed(counts: DataFrame) -> DataFrame:
    """Wide counts as bigint, the type that SQL counts in, if all fit; else as they are. The counts, a row a chain, are kept, as
    this looks at them."""
    kept = counts.persist()
    wide = [c for c, kind in kept.dtypes if kind == "decimal(38,0)"]
    most = kept.agg(F.max(F.greatest(*wide))).first()[0]
    return kept if most is not None and most >= 1 << 63 else kept.withColumns({c: F.col(c).cast("long") for c in wide})


def relation_counts_sql(found: DataFrame, key: list[str] = CHAIN) -> DataFrame:
    """The same counts by the pair-level join, for short chains and as a check."""
    n = found.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("contact_count"))
    counts = [F.count_if(F.col("relation") == r).alias(f"{r}_pair_count") for r in ("series", "parallel", "cross")]
    by = contact_relations(found, key).groupBy(*key).agg(F.count(F.lit(1)).alias("contact_pair_count"), *counts)
    return n.join(by, key, "left").na.fill(0)


def chain_topology(points: DataFrame, chains: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """The topology table: a row a manifest chain, zeros and null fractions where there are no contacts."""
    names = ["structure_id", "source_path", "file_format", "chain_id"]
    key = ["structure_id", "source_path", "chain_id"]
    wanted = points.join(chains.select(CHAIN).distinct(), CHAIN, "left_semi")
    sizes = wanted.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("eligible_residue_count"))
    counts = relation_counts(contacts(wanted, config.contact_distance, config.min_separation, key), key)
    out = chains.select(names).distinct().join(sizes, key, "left").join(counts, key, "left")
    kinds = {"s": "series", "p": "parallel", "x": "cross"}
    numbers = ["eligible_residue_count", "contact_count", "contact_pair_count", *[f"{k}_pair_count" for k in kinds.values()]]
    out = out.na.fill(0, numbers)
    shares = [fraction(F.col(f"{k}_pair_count"), F.col("contact_pair_count")).alias(f"{c}_fraction") for c, k in kinds.items()]
    return out.select("structure_id", "chain_id", "source_path", "file_format", *numbers, *shares)
