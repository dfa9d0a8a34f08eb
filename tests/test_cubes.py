"""Window analyses from cubes against direct counts over all pairs of frames and windows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators.correlation import annotation_window_join, annotation_window_totals, bit_event_candidates, candidates_from_counts, distribution_shift, phase_bit_counts
from framelake.plans import cubes


def capture(make_frames, n, seed=3, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        arb = 0x100 if rng.random() < hot else 0x100 + rng.randrange(1, 4)
        rows.append((i * 0.5 + rng.choice([0, 0, 0.25]), "can0", arb, "".join(f"{rng.choice([0, 1, 17, rng.randrange(256)]):02X}" for _ in range(rng.choice([1, 3, 8, 11])))))
    return make_frames(rows)


def windows_of(spark, n, span_us, seed=5):
    """Windows of 2 to 40 s, and some of more than ten chunks."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(span_us)
        rows.append(("s", i, start, start + rng.choice([2, 9, 40, 400]) * 1_000_000))
    rows += [("other", 0, 0, span_us), ("s", n, 5_000_000, 5_000_000), ("s", n + 1, 9_000_000, 4_000_000)]
    return spark.createDataFrame(rows, "session_id STRING, annotation_idx INT, start_us BIGINT, end_us BIGINT")


def direct_shift(frames, windows, baseline_us, least):
    out = {}
    for w in windows:
        hist = {}
        for f in frames:
            if f["session_id"] == w["session_id"] and w["start_us"] - baseline_us <= f["ts_us"] < w["end_us"]:
                for i, v in enumerate(bytes(f["data"])):
                    hist.setdefault((f["iface"], f["arb_id"], i), ([], []))[f["ts_us"] >= w["start_us"]].append(v)
        for key, (base, action) in hist.items():
            if len(base) >= least and len(action) >= least:
                b, a = np.bincount(base, minlength=256), np.bincount(action, minlength=256)
                distance = np.abs(b / len(base) - a / len(action)).sum() / 2
                out[(w["annotation_idx"], *key)] = (len(base), len(action), round(float(np.mean(base)), 9), round(float(np.mean(action)), 9), round(float(distance), 9))
    return out


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_distribution_shift_equals_direct_counts(spark, make_frames, monkeypatch, small):
    frames, windows = capture(make_frames, 400), windows_of(spark, 30, 200_000_000)
    got = {
        (r["annotation_idx"], r["iface"], r["arb_id"], r["byte_index"]): (r["n_base"], r["n_action"], round(r["mean_base"], 9), round(r["mean_action"], 9), round(r["distance"], 9))
        for r in distribution_shift(frames, windows, 20_000_000, 3, bin_us=30_000_000).collect()
    }
    assert got == direct_shift(frames.collect(), windows.collect(), 20_000_000, 3)
    assert len(got) > 100


def test_window_totals_equal_the_join(spark, make_frames):
    frames, windows = capture(make_frames, 300), windows_of(spark, 40, 150_000_000)
    rows = lambda df: sorted(tuple(r) for r in df.select("session_id", "annotation_idx", "action", "frames", "checksum").collect())
    joined = annotation_window_join(frames, windows, 20_000_000, bin_us=30_000_000).groupBy("session_id", "annotation_idx", "action").agg(F.count("*").alias("frames"), F.bit_xor("sequence").alias("checksum"))
    assert rows(annotation_window_totals(frames, windows, 20_000_000, chunk_us=30_000_000)) == rows(joined)


def test_work_of_overlapping_windows_is_not_their_rows(spark, make_frames):
    """Ten times the windows over the same frames: the points that travel stay the same."""
    frames = capture(make_frames, 200).select("session_id", "ts_us", "arb_id")
    seen = []

    def fold(points, windows):
        return points.iloc[:1].assign(n=len(points))[["n"]]

    for n in (20, 200):
        windows = windows_of(spark, n, 100_000_000).where("session_id = 's'")
        got = cubes.per_window(frames, windows, ["session_id"], ["arb_id"], F.col("start_us"), F.col("end_us"), fold, "n bigint", chunk_us=400_000_000)
        seen.append(got.agg(F.sum("n")).first()[0])
    assert seen[0] == seen[1] <= 2 * 200


def phases_of(spark, n, span_us):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        t, names = rng.randrange(span_us), ("baseline", "event", "after")
        for p in names[: rng.choice([3, 3, 3, 2])]:
            length = rng.choice([8, 20, 60]) * 1_000_000
            rows.append(("s", i, p, t, t + length))
            t += length
    rows += [("s", 0, "event", span_us // 2, span_us // 2 + 7_000_000), ("s", 0, "other", 0, span_us)]
    return spark.createDataFrame(rows, "session_id STRING, discovery_id INT, phase STRING, lo_us BIGINT, hi_us BIGINT")


def test_bit_candidates_equal_the_verdict_over_counts(spark, make_frames):
    frames, phases = capture(make_frames, 500), phases_of(spark, 25, 200_000_000)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    counts = phase_bit_counts(frames, phases.where("phase != 'other'"), bin_us=30_000_000)
    direct = {}
    for f in frames.collect():
        for p in phases.where("phase != 'other'").collect():
            if p["lo_us"] <= f["ts_us"] < p["hi_us"]:
                for block in range(-(-len(f["data"]) // 8)):
                    part = bytes(f["data"])[block * 8 : block * 8 + 8]
                    cell = direct.setdefault((p["discovery_id"], p["phase"], f["arb_id"], len(f["data"]), block), [0] * 65)
                    cell[0] += 1
                    for i, v in enumerate(part):
                        for bit in range(8):
                            cell[1 + i * 8 + bit] += v >> bit & 1
    summed = {}
    for r in counts.collect():
        cell = summed.setdefault((r["discovery_id"], r["phase"], r["arb_id"], r["length"], r["w_block"]), [0] * 65)
        summed[(r["discovery_id"], r["phase"], r["arb_id"], r["length"], r["w_block"])] = [a + b for a, b in zip(cell, [r["n"], *r["ones"]])]
    assert summed == direct
    limits = {"min_frames": 2, "min_change": 0.3, "max_restore": 0.4}
    got = rows(bit_event_candidates(frames, phases, bin_us=30_000_000, **limits))
    assert got == rows(candidates_from_counts(counts, **limits)) and len(got) > 5


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_cubes_count_prefixes(monkeypatch, small):
    monkeypatch.setattr(cubes, "SMALL", small)
    rng = np.random.default_rng(1)
    for n in (1, 5, 127, 128, 129, 1000):
        values, bits = rng.integers(0, 30, n), rng.integers(0, 2, (n, 64)).astype(np.uint8)
        at = np.array([0, n, n // 2, n // 3, max(n - 1, 0)])
        cube = cubes.Cube(values)
        assert [list(r) for r in cube.upto(at)] == [[int((values[:a] == v).sum()) for v in cube.levels] for a in at]
        assert (cubes.BitCube(bits).upto(at) == np.array([bits[:a].sum(axis=0) for a in at])).all()


def test_no_windows_and_no_frames(spark, make_frames):
    frames, windows = capture(make_frames, 20), windows_of(spark, 3, 10_000_000)
    assert distribution_shift(frames, windows.where("false"), 10, 1).count() == 0
    assert distribution_shift(frames.where("false"), windows, 10, 1).count() == 0
    assert annotation_window_totals(frames.where("false"), windows, 10).count() == 0
