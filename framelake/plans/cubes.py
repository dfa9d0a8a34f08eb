"""Window analyses from additive cubes: a window's counts are the difference of two prefix sums, never a copy of its rows.

Points of a key are cut into short runs, a cube holds what all runs before each one add up to, and the counts before any
time are the cube's entry and the part of one run. So a window costs two look-ups however many points it holds, and
points cost the same however many windows overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framelake.plans.ordered import CHUNK_US, Carry, chunk_of, running
from framelake.session import cut_lineage

#: Points of a run of a large cube, and cells up to which every point is a run of its own.
RUN = 16
SMALL = 1 << 22
#: Look-ups answered at once.
SLICE = 2048
#: Parts that the keys of one time chunk are dealt to; windows are repeated for each.
PARTS = 4
#: Windows that one group holds in :func:`windows_in_turn`; beyond that they are dealt to several groups.
WINDOWS = 1 << 18
#: Rows of a batch that leaves a task.
OUT = 1 << 14


def _runs(n: int, width: int) -> int:
    """Points of a run: one where all prefixes fit a small table, else a number that bounds both the cube and a look-up."""
    return 1 if (n + 1) * width <= SMALL else RUN


class Cube:
    """Prefix counts of the distinct values of points in order: column j counts ``levels[j]``."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, self.codes = np.unique(values, return_inverse=True)
        n, width = len(values), len(self.levels)
        self.run = _runs(n, width)
        runs = np.bincount((np.arange(n) // self.run + 1) * width + self.codes, minlength=(-(-n // self.run) + 1) * width)
        self.before = np.cumsum(runs.reshape(-1, width), axis=0, dtype=np.int32)

    def upto(self, at: np.ndarray) -> np.ndarray:
        """Counts per value of the first ``at`` points, a row for each."""
        run = at // self.run
        if self.run == 1:
            return self.before[run].astype(np.int64)
        inside = run[:, None] * self.run + np.arange(self.run)[None, :]
        row, col = np.nonzero(inside < at[:, None])
        width = len(self.levels)
        part = np.bincount(row * width + self.codes[inside[row, col]], minlength=len(at) * width)
        return self.before[run] + part.reshape(-1, width)


class BitCube:
    """Prefix counts of set bits; ``bits`` has a row per point: its bits, or how often each is set where a point is a sum."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        n, width = bits.shape
        self.run = _runs(n, width)
        runs = np.add.reduceat(bits, np.arange(0, n, self.run), axis=0, dtype=np.int32) if n else np.zeros((0, width), np.int32)
        self.before = np.concatenate([np.zeros((1, width), np.int32), np.cumsum(runs, axis=0, dtype=np.int32)])

    def upto(self, at: np.ndarray) -> np.ndarray:
        run = at // self.run
        if self.run == 1:
            return self.before[run].astype(np.int64)
        inside = run[:, None] * self.run + np.arange(self.run)[None, :]
        part = inside < at[:, None]
        return self.before[run] + (self.bits[np.minimum(inside, len(self.bits) - 1)] * part[:, :, None]).sum(axis=1, dtype=np.int64)


Fold = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]
ArrowFold = Callable[[pa.Table, pa.Table], pa.Table]


def _parted(points: DataFrame, spread: Sequence[str], parts: int) -> DataFrame:
    return points.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int") if spread else F.lit(0))


def _for_all_parts(rows: DataFrame, parts: int) -> DataFrame:
    return rows.select("*", F.explode(F.array(*[F.lit(p) for p in range(parts)])).alias("_part"))


def _both(points: DataFrame, others: DataFrame, key: Sequence[str], fold: Fold, schema: str) -> DataFrame:
    """``fold`` of the groups that have rows on both sides."""
    names = [c.split()[0] for c in schema.split(", ")]

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fold(left, right) if len(left) and len(right) else pd.DataFrame(columns=names)

    return points.groupBy(*key).cogroup(others.groupBy(*key)).applyInPandas(both, schema)


def _placed(windows: DataFrame, lo: Column, hi: Column, t: str, chunk_us: int) -> tuple[DataFrame, Column]:
    """The windows with their class and chunk, written as a table, and the classes and chunks that a point at ``t`` is in."""
    spans = windows.select("*", lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi")).where("_lo < _hi")
    span = F.col("_hi") - F.col("_lo")
    level = F.when(span > chunk_us, F.ceil(F.log2(span / F.lit(float(chunk_us))))).otherwise(0).cast("int")
    spans = cut_lineage(spans.withColumn("_class", F.when(span > chunk_us, F.greatest(level, F.lit(1))).otherwise(0)))
    longest = {r["_class"]: r["longest"] for r in spans.groupBy("_class").agg(F.max(span).alias("longest")).collect()}  # one for each power of two
    widths = {c: chunk_us << c for c in longest}
    while 0 in widths and longest[0] <= widths[0] // 2:
        widths[0] //= 2
    number = F.lit(None).cast("bigint")
    for c, width in widths.items():
        number = F.when(F.col("_class") == c, chunk_of("_lo", width)).otherwise(number)
    spans = spans.withColumn("_chunk", number)
    near = F.array(*[
        F.struct(F.lit(c).alias("_class"), (chunk_of(t, width) + d).alias("_chunk")) for c, width in widths.items() for d in (0, -1)
    ]) if widths else F.array().cast("array<struct<_class:int,_chunk:bigint>>")
    return spans, near


def per_window(
    points: DataFrame, windows: DataFrame, by: Sequence[str], spread: Sequence[str], lo: Column, hi: Column, fold: Fold | ArrowFold, schema: str | StructType,
    t: str = "ts_us", chunk_us: int = CHUNK_US, parts: int = PARTS, arrow: bool = False,
) -> DataFrame:
    """``fold`` of the points and the windows of each (``by``, time chunk, part of the ``spread`` keys).

    A window belongs to the chunk of its start ``lo``, and its chunk has all points up to its end: chunks are as wide as
    the longest window of their class, so a point is in two chunks at most. Windows of up to ``chunk_us`` are one class,
    whose chunks are halved as long as the longest of them fits: a group holds no more points than its windows ask for.
    Longer classes double in width, a long window among short ones widens only its own. All points of a ``spread`` key
    are in one part. With ``arrow`` the fold gets and returns Arrow tables, one of which may be empty.
    """
    spans, near = _placed(windows, lo, hi, t, chunk_us)
    needed = spans.select(*by, "_class", "_chunk").distinct()
    copies = _parted(points.select("*", F.inline(near)).join(needed, [*by, "_class", "_chunk"], "left_semi"), spread, parts)
    key = [*by, "_class", "_chunk", "_part"]
    if arrow:
        return copies.groupBy(*key).cogroup(_for_all_parts(spans, parts).groupBy(*key)).applyInArrow(fold, schema)
    return _both(copies, _for_all_parts(spans, parts), key, fold, schema)


Rows = dict[str, "pa.Array | np.ndarray"]


def breaks(batch: pa.RecordBatch, before: pa.RecordBatch | None, names: Sequence[str]) -> np.ndarray:
    """Whether a row differs in one of the columns from the row before it, the first one from the last of ``before``."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = before is None
    flags = lambda x: x.to_numpy(zero_copy_only=False)
    for name in names:
        c = batch.column(name) if before is None else pa.concat_arrays([before.column(name), batch.column(name)])
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differs = flags(pc.fill_null(pc.not_equal(a, b), False)) | (flags(a.is_null()) != flags(b.is_null()))
        out[batch.num_rows - len(differs) :] |= differs.astype(bool)
    return out


def _in_turn(
    points: DataFrame, others: DataFrame, key: Sequence[str], series: Sequence[str], order: Sequence[str], opened: Callable[[pa.Table], Any],
    fold: Callable[[Any, pa.Table], Iterable[Rows]], schema: str, t: str = "ts_us", whole: bool = True,
) -> DataFrame:
    """``fold`` of what ``opened`` makes of a group's other rows and, one after the other, of its series of points.

    Rows come sorted, a group's ``others`` by ``t`` and ``order`` before its points by series and ``t``, and what is found leaves in
    small batches. So a task holds the other rows of one group and one series, however much a group has; sorting can spill.
    Without ``whole`` points are given to the fold as they come, a few thousand rows of any series. Groups that lack a side give nothing.
    """
    both = points.withColumn("_side", F.lit(1)).unionByName(others.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    lined = both.repartition(*key).sortWithinPartitions(*key, "_side", *series, t, *order)
    shape = to_arrow_schema(StructType.fromDDL(schema))
    inner = ["_side", *(series if whole else [])]

    def cuts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, bool, bool, pa.RecordBatch]]:
        before = None
        for batch in (b for b in batches if b.num_rows):
            group = breaks(batch, before, key)
            begins = group | breaks(batch, before, inner)
            starts = np.nonzero(begins)[0]
            starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
            side = batch.column("_side").to_numpy()
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                yield bool(group[a]), bool(begins[a]) or not whole, bool(side[a]), batch.slice(a, b - a)
            before = batch.slice(batch.num_rows - 1)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[Rows]:
        held: list[pa.RecordBatch] = []
        mine: list[pa.RecordBatch] = []
        state = None
        for group, begins, is_point, part in cuts(batches):
            if begins and mine:
                yield from fold(state, pa.Table.from_batches(mine).combine_chunks())
                mine = []
            if group:
                held, state = [], None
            if not is_point:
                held.append(part)
            elif state is not None or held:
                if state is None:
                    state, held = opened(pa.Table.from_batches(held).combine_chunks()), []
                mine.append(part)
        if mine:
            yield from fold(state, pa.Table.from_batches(mine).combine_chunks())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        for rows in found(batches):
            cells = [rows[f.name] for f in shape]
            arrays = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)) for c in cells]
            out.append(pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, shape)], schema=shape))
            if sum(b.num_rows for b in out) >= OUT:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return lined.mapInArrow(run, schema)


def windows_in_turn(
    points: DataFrame, windows: DataFrame, by: Sequence[str], series: Sequence[str], lo: Column, hi: Column, opened: Callable[[pa.Table], Any],
    fold: Callable[[Any, pa.Table], Iterable[Rows]], schema: str, t: str = "ts_us", chunk_us: int = CHUNK_US, parts: int = PARTS,
) -> DataFrame:
    """:func:`per_window` with the groups of :func:`_in_turn`: ``opened`` gets the windows of a group, ``fold`` one series at a time.

    More than ``WINDOWS`` windows of a chunk are dealt to several groups, which all get the chunk's points.
    """
    spans, near = _placed(windows, lo, hi, t, chunk_us)
    place = [*by, "_class", "_chunk"]
    deals = F.ceil(F.count("*") / F.lit(WINDOWS)).cast("int").alias("_deals")
    # a row for each chunk; written, its size is known and the join need not shuffle the points
    needed = cut_lineage(spans.groupBy(*place).agg(deals))
    copies = points.select("*", F.inline(near)).join(needed, place).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")
    dealt = spans.join(needed, place).withColumn("_deal", F.pmod(F.xxhash64("_lo", "_hi", *[c for c in windows.columns if c not in by]), F.col("_deals")).cast("int")).drop("_deals")
    marks = _for_all_parts(dealt.withColumn(t, F.col("_lo")).drop("_lo"), parts)
    return _in_turn(_parted(copies, series, parts), marks, [*place, "_part", "_deal"], series, ["_hi"], opened, fold, schema, t)


def chunks_in_turn(
    points: DataFrame, marks: DataFrame, by: Sequence[str], series: Sequence[str], opened: Callable[[pa.Table], Any],
    fold: Callable[[Any, pa.Table], Iterable[Rows]], schema: str, t: str = "ts_us", chunk_us: int = CHUNK_US,
) -> DataFrame:
    """``fold`` of the points and the marks of each (``by``, time chunk), a few thousand points at a time; every row is in one chunk."""
    placed = lambda df: df.where(F.col(t).isNotNull()).withColumn("_chunk", chunk_of(t, chunk_us))
    return _in_turn(placed(points), placed(marks), [*by, "_chunk"], series, [], opened, fold, schema, t, whole=False)


def gathered(windows: pd.DataFrame, found: list[tuple], names: Sequence[str], columns: Sequence[str]) -> pd.DataFrame:
    """A table from parts (positions of windows, then values or arrays for ``columns``), with the windows' own columns ``names``."""
    found = [f for f in found if len(f[0])]
    if not found:
        return pd.DataFrame(columns=[*names, *columns])
    rows = np.concatenate([f[0] for f in found])
    out = {c: windows[c].to_numpy()[rows] for c in names}
    for i, c in enumerate(columns, start=1):
        if all(isinstance(f[i], np.ndarray) for f in found):
            out[c] = np.concatenate([f[i] for f in found])
            continue
        cells: list = []
        for f in found:
            cells.extend(f[i] if isinstance(f[i], (np.ndarray, list)) else [f[i]] * len(f[0]))
        out[c] = cells
    return pd.DataFrame(out)


def window_totals(points: DataFrame, windows: DataFrame, by: Sequence[str], ident: Sequence[str], borders: dict[str, Column], t: str = "ts_us", checksum: str = "sequence", chunk_us: int = CHUNK_US) -> DataFrame:
    """Per window (``by``, ``ident``) and border, the points before it: (border, n, checksum), the latter the xor of a column.

    Points and borders are put in one order and counted along it, so the work is that of their sum; what lies between
    two borders is the difference of their counts, and of xors their xor.
    """
    nothing = [F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in ident]
    kinds = F.array(*[F.struct(F.lit(name).alias("border"), c.cast("bigint").alias("_t")) for name, c in borders.items()])
    probes = windows.select(*by, *ident, F.inline(kinds)).select(*by, "_t", F.lit(0).alias("_side"), *ident, "border", F.lit(0).cast("bigint").alias("_x"))
    marks = points.select(*by, F.col(t).cast("bigint").alias("_t"), F.lit(1).alias("_side"), *nothing, F.lit(None).cast("string").alias("border"), F.col(checksum).cast("bigint").alias("_x"))
    lined = marks.unionByName(probes).withColumn("_chunk", chunk_of("_t", chunk_us))
    seen = running(lined, by, ["_t", "_side"], {"n": Carry("sum", F.col("_side").cast("bigint")), "checksum": Carry("xor", F.col("_x"))}, ["_chunk"])
    return seen.where("_side = 0").select(*by, *ident, "border", "n", "checksum")
