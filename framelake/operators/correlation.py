"""Correlation of payload changes with annotations, operator phases and reference speeds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import BLOCK, extract_words, with_words
from framelake.operators.activity import select_dominant_dlc
from framelake.plans.cubes import OUT, PARTS, SLICE, BitCube, Cube, Rows, breaks, chunks_in_turn, gathered, per_window, window_totals, windows_in_turn
from framelake.plans.ordered import CHUNK_US
from framelake.plans.stats import pearson
from framelake.plans.timejoin import asof_backward, interval_join, nearest_within


def align_annotations(transcript: DataFrame, epoch_us: int) -> DataFrame:
    """Transcript rows (idx, start_s, end_s, text) on the capture clock."""
    return transcript.select(
        F.col("idx").alias("annotation_idx"),
        (F.lit(epoch_us) + F.round(F.col("start_s") * 1e6).cast("bigint")).alias("start_us"),
        (F.lit(epoch_us) + F.round(F.col("end_s") * 1e6).cast("bigint")).alias("end_us"),
        "text",
    )


def annotation_window_join(
    frames: DataFrame, annotations: DataFrame, baseline_us: int, bin_us: int = CHUNK_US, by: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Frames in [start - baseline, end) of each annotation, with ``action`` telling the phase.

    ``by`` names the capture key that both sides carry: an annotation only meets frames of its own capture.
    """
    windows = annotations.select(*by, "annotation_idx", "start_us", "end_us")
    joined = interval_join(frames, windows, F.col("start_us") - baseline_us, F.col("end_us"), on=by, bin_us=bin_us)
    return joined.withColumn("action", F.col("ts_us") >= F.col("start_us")).drop("start_us", "end_us")


def annotation_window_totals(
    frames: DataFrame, annotations: DataFrame, baseline_us: int, by: Sequence[str] = ("session_id",), chunk_us: int = CHUNK_US
) -> DataFrame:
    """Frames per annotation and phase, with the xor of their sequence numbers, without joining frames to annotations."""
    borders = {"lo": F.col("start_us") - baseline_us, "start": F.least("start_us", "end_us"), "end": F.col("end_us")}
    seen = window_totals(frames, annotations.where(F.col("start_us") - baseline_us < F.col("end_us")), by, ["annotation_idx"], borders, chunk_us=chunk_us)

    def between(first: str, last: str, action: bool) -> Column:
        count = F.sum(F.when(F.col("border") == last, F.col("n")).when(F.col("border") == first, -F.col("n")))
        mark = F.bit_xor(F.when(F.col("border").isin(first, last), F.col("checksum")))
        return F.struct(F.lit(action).alias("action"), count.alias("frames"), mark.alias("checksum"))

    told = seen.groupBy(*by, "annotation_idx").agg(F.array(between("lo", "start", False), between("start", "end", True)).alias("phases"))
    return told.select(*by, "annotation_idx", F.inline("phases")).where("frames > 0")


def _byte(points: pd.DataFrame, i: int) -> np.ndarray:
    """Byte ``i`` of blocks opened by ``with_words``."""
    word, shift = ("w_hi", 24 - 8 * i) if i < 4 else ("w_lo", 56 - 8 * i)
    return (points[word].to_numpy() >> shift) & 255


def _millionths(x: np.ndarray) -> np.ndarray:
    """Numbers rounded to 6 digits as Spark's ``round`` does (half up, of the shortest decimal text), as whole millionths."""
    scaled = x * 1e6
    out = np.floor(scaled + 0.5)
    for i in np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3)[0]:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    return out


def _strongest(found: list[tuple[np.ndarray, ...]], top: int, rounded: bool) -> list[tuple[np.ndarray, ...]]:
    """Of (window, id number, byte, statistics) the ``top`` of each window, in the order that :func:`_top` ranks by."""
    each = [np.concatenate(c) for c in zip(*found)]
    rows, number, byte, _, _, base, action, distance = each
    score = 100.0 * distance + 20.0 * np.abs(action - base) / 255
    tie = 1 if rounded else -1
    order = np.lexsort((tie * byte, tie * number, -(_millionths(score) if rounded else score), rows))
    here = np.arange(len(order))
    first = np.concatenate([[True], rows[order][1:] != rows[order][:-1]])
    kept = order[here - np.maximum.accumulate(np.where(first, here, 0)) < top]
    return [tuple(c[kept] for c in each)]


#: Rows that a group of windows gathers before only the strongest of them are kept.
GATHERED = 1 << 18


def distribution_shift(
    frames: DataFrame, annotations: DataFrame, baseline_us: int, min_obs: int, bin_us: int = CHUNK_US, by: Sequence[str] = ("session_id",),
    top: int | None = None, rounded: bool = False,
) -> DataFrame:
    """Per (capture, annotation, interface, id, byte): value histograms before and during, their distance and score.

    The histograms of a window are differences of prefix cubes per (id, byte), so a frame is read once or twice however
    many windows overlap it. Windows from start - baseline to end; values before start are the baseline. With ``top``
    a group of ids returns only the bytes of a window that can be among its ``top`` by score (``rounded`` to 6 digits,
    then the smaller key; else the larger key first), so neither a task nor the ranking holds all bytes of all windows.
    """
    least = max(min_obs, 1)
    stats = ["n_base", "n_action", "mean_base", "mean_action", "distance"]

    def fold(points: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        borders = [windows[c].to_numpy() for c in ("_lo", "start_us", "end_us")]
        series = list(points.sort_values("ts_us", kind="stable").groupby(["iface", "arb_id", "w_block"], sort=False, dropna=False))
        known = lambda v: () if pd.isna(v) else (v.encode() if isinstance(v, str) else v,)
        ids = sorted({tuple(known(v) for v in key[:2]): key[:2] for key, _ in series}.items())  # nulls first
        numbers = {k: i for i, (k, _) in enumerate(ids)}
        found: list[tuple[np.ndarray, ...]] = []
        for key, g in series:
            number, block = numbers[tuple(known(v) for v in key[:2])], int(key[2])
            times, held = g["ts_us"].to_numpy(), g["w_len"].to_numpy()
            for i in range(int(held.max())):
                has = held > i
                ts = times[has]
                at = [np.searchsorted(ts, x, "left") for x in borders]
                enough = np.nonzero((at[1] - at[0] >= least) & (at[2] - at[1] >= least))[0]
                cube = Cube(_byte(g, i)[has]) if len(enough) else None
                for s in range(0, len(enough), SLICE):
                    rows = enough[s : s + SLICE]
                    before, middle, after = (cube.upto(x[rows]) for x in at)
                    b, a = middle - before, after - middle
                    nb, na = b.sum(axis=1), a.sum(axis=1)
                    gap = np.abs(b * na[:, None] - a * nb[:, None]).sum(axis=1).astype(float)
                    same = lambda v: np.full(len(rows), v)
                    found.append((rows, same(number), same(block * BLOCK + i), nb, na, (b @ cube.levels) / nb, (a @ cube.levels) / na, gap / (nb.astype(float) * na) / 2))
                if top is not None and sum(len(f[0]) for f in found) > GATHERED:
                    found = _strongest(found, top, rounded)
        if top is not None and found:
            found = _strongest(found, top, rounded)
        names = [np.array([k[i] for _, k in ids]) for i in range(2)]
        parts = [(f[0], names[0][f[1]], names[1][f[1]], *f[2:]) for f in found]
        return gathered(windows, parts, [*by, "annotation_idx"], ["iface", "arb_id", "byte_index", *stats])

    wide = with_words(frames.select(*by, "ts_us", "iface", "arb_id", "data")).where("w_len > 0").drop("data", "w_next")
    windows = annotations.select(*by, "annotation_idx", "start_us", "end_us")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"{c} {kind(frames, c)}" for c in by], f"annotation_idx {kind(windows, 'annotation_idx')}", "iface string", "arb_id bigint", "byte_index int", "n_base bigint", "n_action bigint", "mean_base double", "mean_action double", "distance double"])
    scored = per_window(wide, windows, by, ["iface", "arb_id", "w_block"], F.col("start_us") - baseline_us, F.col("end_us"), fold, schema, chunk_us=bin_us)
    change = F.abs(F.col("mean_action") - F.col("mean_base"))
    return scored.withColumn("score", F.lit(100.0) * F.col("distance") + F.lit(20.0) * change / 255)


def _top(scored: DataFrame, order: list[Column], k: int, by: Sequence[str]) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "annotation_idx").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def window_correlation(
    frames: DataFrame,
    annotations: DataFrame,
    baseline_us: int = 5_000_000,
    min_obs: int = 3,
    k: int = 8,
    bin_us: int = CHUNK_US,
    by: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Top ``k`` bytes per annotation; equal scores go to the larger (interface, id, byte)."""
    scored = distribution_shift(frames, annotations, baseline_us, min_obs, bin_us, by, top=k)
    return _top(scored, [F.desc("score"), F.desc("iface"), F.desc("arb_id"), F.desc("byte_index")], k, by)


def voice_correlation(
    frames: DataFrame,
    annotations: DataFrame,
    baseline_us: int = 5_000_000,
    after_us: int = 750_000,
    min_span_us: int = 50_000,
    min_obs: int = 3,
    k: int = 8,
    bin_us: int = CHUNK_US,
    by: Sequence[str] = ("session_id",),
) -> DataFrame:
    """As :func:`window_correlation` with a stretched action window and scores rounded to 6 digits before ranking.

    Equal scores have no defined order in the voice variant; here the smaller (interface, id, byte) comes first.
    """
    stretched = annotations.withColumn(
        "end_us", F.greatest(F.col("end_us"), F.col("start_us") + min_span_us) + after_us
    )
    scored = distribution_shift(frames, stretched, baseline_us, min_obs, bin_us, by, top=k, rounded=True).withColumn("score", F.round("score", 6))
    return _top(scored, [F.desc("score"), F.asc("iface"), F.asc("arb_id"), F.asc("byte_index")], k, by)


BIT_KEY = ["discovery_id", "iface", "arb_id", "is_extended", "length", "w_block"]


def _bit_points(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per block of eight bytes of a usable frame: ``n`` of 1 and ``ones`` as :func:`_packed`."""
    usable = frames.where(~F.col("remote") & (F.length("data") > 0)).select(*by, "ts_us", "iface", "arb_id", "is_extended", F.length("data").alias("length"), "data")
    last = F.floor((F.col("length") - 1) / F.lit(BLOCK)).cast("int")
    blocks = usable.select("*", F.explode(F.sequence(F.lit(0), last)).alias("w_block"))
    bytes_ = F.rpad(F.substr("data", F.col("w_block") * BLOCK + 1, F.lit(BLOCK)), F.lit(BLOCK), F.lit(b"\0"))
    return blocks.select(*by, "ts_us", *_BIT_SERIES, F.lit(1).cast("bigint").alias("n"), bytes_.alias("ones"))


_BIT_SERIES = ["iface", "arb_id", "is_extended", "length", "w_block"]
_BITS = BLOCK * 8
#: Bytes of packed counts and the numbers in them: eight bytes of bits, else 64 counts, as small as they fit.
_COUNTS = {_BITS: np.dtype("u1"), 2 * _BITS: np.dtype("<u2"), 4 * _BITS: np.dtype("<u4")}


def _packed(ones: np.ndarray) -> pa.Array:
    """Counts of 64 bits, a row for each, as binary values: a single frame's are its eight bytes."""
    most = ones.max(axis=1, initial=0)
    sizes = np.select([most <= 1, most < 1 << 8, most < 1 << 16], [BLOCK, *list(_COUNTS)[:2]], list(_COUNTS)[2])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(offsets[-1], np.uint8)
    for size in np.unique(sizes):
        at = np.nonzero(sizes == size)[0]
        rows = np.packbits(ones[at].astype(np.uint8), axis=1, bitorder="little") if size == BLOCK else ones[at].astype(_COUNTS[size]).view(np.uint8)
        data[offsets[at][:, None] + np.arange(size)] = rows
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ones), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _unpacked(packed: pa.Array) -> np.ndarray:
    """The counts of :func:`_packed` values."""
    packed = packed.cast(pa.large_binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    held = packed.buffers()[2]
    data, sizes = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), np.diff(offsets)
    kinds = np.unique(sizes)
    out = np.zeros((len(packed), _BITS), np.uint8 if not len(kinds) or kinds[-1] <= _BITS else np.int32)
    for size in kinds:
        at = np.nonzero(sizes == size)[0]
        rows = data[offsets[at][:, None] + np.arange(size)]
        out[at] = np.unpackbits(rows, axis=1, bitorder="little") if size == BLOCK else rows.view(_COUNTS[int(size)])
    return out


def _bit_groups(points: pd.DataFrame) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, BitCube]]:
    """Per id, length and block: its key, times, frames before each time and cube of 64 bits, least significant bit of each byte first."""
    for key, g in points.sort_values("ts_us", kind="stable").groupby(_BIT_SERIES, sort=False, dropna=False):
        bits = _unpacked(pa.array(g["ones"].to_numpy(), pa.large_binary()))
        yield key, g["ts_us"].to_numpy(), np.concatenate([[0], np.cumsum(g["n"].to_numpy())]), BitCube(bits)


def phase_bit_counts(frames: DataFrame, phases: DataFrame, bin_us: int = CHUNK_US, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Frames and one-counts of the 64 bits of each block per (key, phase); additive, so batches of a stream can be summed.

    ``phases`` has (discovery_id, phase, lo_us, hi_us) and the capture key ``by``, with phase baseline, event or after.
    Counts are differences of prefix cubes per id, so overlapping phases do not repeat frames.
    """
    return _phase_counts(_bit_points(frames, by), phases, bin_us, by)


def _phase_counts(points: DataFrame, phases: DataFrame, bin_us: int, by: Sequence[str]) -> DataFrame:

    def fold(points: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for key, ts, frames, cube in _bit_groups(points):
            first, last = (np.searchsorted(ts, windows[c].to_numpy(), "left") for c in ("lo_us", "hi_us"))
            some = np.nonzero(last > first)[0]
            for s in range(0, len(some), SLICE):
                rows = some[s : s + SLICE]
                found.append((rows, *key, frames[last[rows]] - frames[first[rows]], list(cube.upto(last[rows]) - cube.upto(first[rows]))))
        return gathered(windows, found, [*by, "discovery_id", "phase"], [*_BIT_SERIES, "n", "ones"])

    windows = phases.select(*by, "discovery_id", "phase", "lo_us", "hi_us")
    schema = ", ".join([*[f"{c} {windows.schema[c].dataType.simpleString()}" for c in [*by, "discovery_id"]], "phase string", _BIT_SCHEMA, "n bigint", "ones array<bigint>"])
    return per_window(points, windows, by, _BIT_SERIES, F.col("lo_us"), F.col("hi_us"), fold, schema, chunk_us=bin_us)


def piece_bit_counts(frames: DataFrame, phases: DataFrame, bin_us: int = CHUNK_US, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Frames and one-counts of the 64 bits of each block per piece of time, named by its start ``ts_us``.

    The borders of all phases cut the time (and so do the ends of chunks), so a phase is a whole number of pieces. Pieces
    without frames have no row: there are no more rows than blocks of frames, however many phases overlap. Additive.
    """

    def fold(cuts: np.ndarray, points: pa.Table) -> Iterator[Rows]:
        points = points.to_batches()[0]
        ts = points.column("ts_us").to_numpy()
        piece = np.searchsorted(cuts, ts, "right") - 1
        first = np.nonzero(breaks(points, None, names) | (np.diff(piece, prepend=-2) != 0))[0]
        ones, n = points.column("ones"), points.column("n").to_numpy()
        if len(first) < len(ts):
            ones, n = _packed(np.add.reduceat(_unpacked(ones), first, axis=0, dtype=np.int64)), np.add.reduceat(n, first)
        starts = np.where(piece[first] < 0, ts[first], cuts[piece[first]]) if len(cuts) else ts[first]
        yield {**{c: points.column(c).take(pa.array(first)) for c in names}, "ts_us": starts, "n": n, "ones": ones}

    names = [*by, *_BIT_SERIES]
    borders = phases.where("lo_us < hi_us").select(*by, F.explode(F.array(F.col("lo_us").cast("bigint"), F.col("hi_us").cast("bigint"))).alias("ts_us"))
    points = _bit_points(frames, by)
    width = max(1, bin_us // PARTS)  # as many groups as parts of the ids would give, and no border is repeated for them
    # chunks without a border are one piece; the chunk's own start stands for it
    starts = points.select(*by, (F.floor(F.col("ts_us") / F.lit(width)).cast("bigint") * width).alias("ts_us"))
    borders = borders.unionByName(starts.join(phases.select(*by).distinct(), [*by], "left_semi")).distinct()
    schema = ", ".join([*[f"{c} {phases.schema[c].dataType.simpleString()}" for c in by], _BIT_SCHEMA, "ts_us bigint", "n bigint", "ones binary"])
    cuts = lambda held: np.unique(held.column("ts_us").to_numpy())
    return chunks_in_turn(points, borders, by, _BIT_SERIES, cuts, fold, schema, chunk_us=width)


_BIT_SCHEMA = "iface string, arb_id bigint, is_extended boolean, length int, w_block int"
_PHASES = ("baseline", "event", "after")


def bit_event_candidates(
    frames: DataFrame,
    phases: DataFrame,
    min_frames: int = 3,
    min_change: float = 0.65,
    max_restore: float = 0.20,
    bin_us: int = CHUNK_US,
    by: Sequence[str] = ("session_id",),
) -> DataFrame:
    """Bits that change during an event and return to their baseline afterwards.

    All phases of a discovery are one window, so its counts meet where they are made and only candidates leave the task.
    A phase may consist of several intervals; other phase names take no part.
    """
    return bits_of_points(_bit_points(frames, by), phases, min_frames, min_change, max_restore, bin_us, by)


def bits_of_points(
    points: DataFrame,
    phases: DataFrame,
    min_frames: int = 3,
    min_change: float = 0.65,
    max_restore: float = 0.20,
    bin_us: int = CHUNK_US,
    by: Sequence[str] = ("session_id",),
) -> DataFrame:
    """:func:`bit_event_candidates` of opened frames, or of the pieces of :func:`piece_bit_counts`."""
    least = max(min_frames, 1)

    def fold(windows: _Windows, points: pa.Table) -> Iterator[Rows]:
        points = points.to_batches()[0]
        length, block = points.column("length")[0].as_py(), points.column("w_block")[0].as_py()
        width = min(length - block * BLOCK, BLOCK) * 8
        n = points.column("n").to_numpy()
        bits = _unpacked(points.column("ones"))[:, :width]
        # bits that never change are no candidates unless no change is asked for
        kept = np.nonzero(~((bits == 0).all(axis=0) | (bits == n[:, None]).all(axis=0)))[0] if min_change > 0 else np.arange(width)
        if not len(kept):
            return
        cube, frames = BitCube(np.ascontiguousarray(bits[:, kept])), np.concatenate([[0], np.cumsum(n)])
        first, last, cells, same = windows.places(points.column("ts_us").to_numpy())
        counts = np.bincount(cells, weights=frames[last] - frames[first], minlength=3 * len(same)).astype(np.int64).reshape(-1, 3)
        full = np.nonzero((counts >= least).all(axis=1))[0]
        starts, ends = np.searchsorted(cells, 3 * full), np.searchsorted(cells, 3 * full + 3)
        for s in range(0, len(full), SLICE):
            rows = full[s : s + SLICE]
            held = ends[s : s + SLICE] - starts[s : s + SLICE]
            at = np.repeat(starts[s : s + SLICE] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            ones = cube.upto(last[at]) - cube.upto(first[at])
            if len(at) > 3 * len(rows):  # phases of several intervals
                ones = np.add.reduceat(ones, np.nonzero(np.diff(cells[at], prepend=-1))[0], axis=0)
            p = ones.reshape(-1, 3, len(kept)) / counts[rows][:, :, None]
            change = np.abs(p[:, 1] - (p[:, 0] + p[:, 2]) / 2)
            restore = np.abs(p[:, 0] - p[:, 2])
            w, bit = np.nonzero((change >= min_change) & (restore <= max_restore))
            found = (kept[bit], p[w, 0, bit], p[w, 1, bit], p[w, 2, bit], change[w, bit] - restore[w, bit] / 2)
            # each for all windows that hold the same points
            begin, total = same[rows[w]], np.cumsum(windows.alike(same, rows[w]))
            for a in range(0, int(total[-1]) if len(total) else 0, OUT):
                out = np.arange(a, min(a + OUT, int(total[-1])))
                k = np.searchsorted(total, out, "right")
                place = begin[k] + out - np.where(k > 0, total[k - 1], 0)
                bit_of, base, event, after, score = (x[k] for x in found)
                key = lambda c: points.column(c).take(pa.array(np.zeros(len(out), np.int64)))
                cells_of = [*[key(c) for c in by], windows.ids.take(pa.array(place)), *[key(c) for c in _BIT_SERIES[:4]], block * BLOCK + bit_of // 8, bit_of % 8, base, event, after, score]
                yield dict(zip(names, cells_of))

    asked = phases.where(F.col("phase").isin(*_PHASES)).select(*by, "discovery_id", F.col("lo_us").cast("bigint").alias("lo_us"), F.col("hi_us").cast("bigint").alias("hi_us"), "phase").where("lo_us < hi_us")
    number = F.when(F.col("phase") == _PHASES[0], 0).when(F.col("phase") == _PHASES[1], 1).otherwise(2).cast("bigint")
    intervals = F.array_sort(F.collect_list(F.struct(number.alias("phase"), "lo_us", "hi_us")))
    flat = F.flatten(F.transform(intervals, lambda x: F.array(x["phase"], x["lo_us"], x["hi_us"])))
    windows = asked.groupBy(*by, "discovery_id").agg(F.min("lo_us").alias("lo_us"), F.max("hi_us").alias("hi_us"), flat.alias("intervals"))
    keys = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in [*by, "discovery_id"])
    schema = keys + ", channel string, id bigint, extended boolean, length int, byte_index int, bit_index int, p_base double, p_event double, p_after double, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    return windows_in_turn(points, windows, by, _BIT_SERIES, F.col("lo_us"), F.col("hi_us"), _Windows, fold, schema, chunk_us=bin_us)


class _Windows:
    """Discoveries of a group in order: the intervals of their phases, and where these begin and end among points."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids = rows.column("discovery_id").combine_chunks()
        lists = rows.column("intervals").combine_chunks()
        phase, lo, hi = lists.flatten().to_numpy().reshape(-1, 3).T
        sizes = lists.value_lengths().to_numpy() // 3
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.cells = owner * 3 + phase
        self.starts = np.cumsum(sizes) - sizes
        self.cuts, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        self.lo, self.hi = at[: len(lo)].astype(np.int32), at[len(lo) :].astype(np.int32)
        # an interval's place in the window before; windows of other phases than the one before are never the same
        self.before = np.maximum(np.arange(len(owner)) - sizes[owner], 0)
        alike = np.concatenate([[False], sizes[1:] == sizes[:-1]])
        self.other = ~(alike[owner] & (phase == phase[self.before]))

    def places(self, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For points in order of time, the points before each interval's begin and end, the intervals' cells (three for each
        distinct window, numbered in order), and the first window of each run of windows whose intervals hold the same points."""
        at = np.cumsum(np.bincount(np.searchsorted(self.cuts, ts, "right"), minlength=len(self.cuts) + 1))[:-1].astype(np.int32)
        first, last = at[self.lo], at[self.hi]
        moved = self.other | (first != first[self.before]) | (last != last[self.before])
        new = np.logical_or.reduceat(moved, self.starts)
        new[0] = True
        mine = np.nonzero(new[self.cells // 3])[0]
        number = np.cumsum(new) - 1
        cells = self.cells[mine]
        return first[mine], last[mine], number[cells // 3] * 3 + cells % 3, np.nonzero(new)[0]

    def alike(self, same: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many windows each of the runs at ``rows`` has."""
        return np.append(same, len(self.ids))[rows + 1] - same[rows]


def candidates_from_counts(
    counts: DataFrame, min_frames: int = 3, min_change: float = 0.65, max_restore: float = 0.20, by: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Verdict over (summed) bit counts."""
    key = [*by, *BIT_KEY]
    held = F.least(F.col("length") - F.col("w_block") * BLOCK, F.lit(BLOCK)) * 8
    bits = counts.select(*key, "phase", "n", F.posexplode(F.slice("ones", F.lit(1), held)).alias("bit", "hits"))

    def of(phase: str, column: str) -> Column:
        return F.sum(F.when(F.col("phase") == phase, F.col(column)).otherwise(0))

    p = bits.groupBy(*key, "bit").agg(
        *[of(ph, c).alias(f"{c}_{ph}") for ph in ("baseline", "event", "after") for c in ("n", "hits")]
    )
    enough = [F.col(f"n_{ph}") >= max(min_frames, 1) for ph in ("baseline", "event", "after")]
    q = p.where(enough[0] & enough[1] & enough[2]).select(
        *key,
        "bit",
        (F.col("hits_baseline") / F.col("n_baseline")).alias("p_base"),
        (F.col("hits_event") / F.col("n_event")).alias("p_event"),
        (F.col("hits_after") / F.col("n_after")).alias("p_after"),
    )
    change = F.abs(F.col("p_event") - (F.col("p_base") + F.col("p_after")) / 2)
    restore = F.abs(F.col("p_base") - F.col("p_after"))
    return q.where((change >= min_change) & (restore <= max_restore)).select(
        *by,
        "discovery_id",
        F.col("iface").alias("channel"),
        F.col("arb_id").alias("id"),
        F.col("is_extended").alias("extended"),
        "length",
        (F.col("w_block") * BLOCK + F.floor(F.col("bit") / 8)).cast("int").alias("byte_index"),
        (F.col("bit") % 8).alias("bit_index"),
        "p_base",
        "p_event",
        "p_after",
        (change - restore / 2).alias("score"),
    )


def speed_confidence(abs_r: Column) -> Column:
    return (
        F.when(abs_r >= 0.95, "strongCandidate")
        .when(abs_r >= 0.80, "candidate")
        .when(abs_r >= 0.60, "weakCandidate")
        .otherwise("background")
    )


def signal_speed_correlation(
    frames: DataFrame,
    speeds: DataFrame,
    tol: int = 6_000_000,
    min_overlap: int = 20,
    k: int | None = 50,
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """Pearson r of every byte and adjacent word with the nearest speed of the same session.

    ``speeds`` has (session_id, sequence, ts_us, speed). Frames get their speed once, before the payload is opened;
    the 22 readings per frame then only feed map-side aggregates.
    """
    rows = select_dominant_dlc(frames).select("session_id", "iface", "arb_id", "ts_us", "sequence", "data")
    paired = nearest_within(rows, speeds, ["session_id"], tol, ["speed"], right_dup="first", chunk_us=chunk_us)
    x, y = F.col("x").cast("double"), F.col("speed").cast("double")
    stats = (
        extract_words(paired.select("iface", "arb_id", "speed", "data"))
        .groupBy("iface", "arb_id", "kind", "offset")
        .agg(pearson(x, y).alias("r"), F.count("*").alias("overlap"))
        .where(F.col("overlap") >= min_overlap)
    )
    out = stats.select(
        F.col("iface").alias("bus"),
        F.col("arb_id").alias("can_id"),
        "kind",
        "offset",
        F.round("r", 6).alias("r"),
        F.abs(F.round("r", 6)).alias("abs_r"),
        "overlap",
        speed_confidence(F.abs(F.round("r", 6))).alias("confidence"),
        F.lit("candidateOnly").alias("mapping_status"),
    )
    return out if k is None else top_speed_candidates(out, k)


def top_speed_candidates(candidates: DataFrame, k: int = 50) -> DataFrame:
    """Strongest candidates; ties by bus, id, then bytes before words, offset, little before big endian."""
    words_last = F.when(F.col("kind") == "u8", 0).otherwise(1)
    big_last = F.when(F.col("kind") == "u16be", 1).otherwise(0)
    return candidates.orderBy(
        F.desc("abs_r"), F.desc("overlap"), F.asc("bus"), F.asc("can_id"), words_last, F.asc("offset"), big_last
    ).limit(k)


def live_validation_steps(samples: DataFrame, step_markers: DataFrame, chunk_us: int = CHUNK_US, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Raw value statistics per operator target; a sample belongs to the latest marker at or before it.

    ``samples`` has (ts_us, sequence, raw_value), ``step_markers`` (ts_us, sequence, target_mph), both with the capture
    key ``by``. A marker without target pauses the validation.
    """
    return step_statistics(asof_backward(samples, step_markers, by, ["target_mph"], chunk_us=chunk_us), by)


def step_statistics(tagged: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Raw value statistics per target of tagged samples."""
    return (
        tagged.where("target_mph IS NOT NULL")
        .groupBy(*by, "target_mph")
        .agg(
            F.count("*").alias("samples"),
            F.min("raw_value").alias("raw_min"),
            F.max("raw_value").alias("raw_max"),
            (F.sum("raw_value") / F.count("*")).alias("raw_mean"),
        )
    )


def decode_candidate(frames: DataFrame, can_id: int, kind: str, offset: int) -> DataFrame:
    """Raw readings of one candidate signal."""
    words = extract_words(frames.where(F.col("arb_id") == can_id))
    return words.where((F.col("kind") == kind) & (F.col("offset") == offset)).withColumnRenamed("x", "raw_value")
