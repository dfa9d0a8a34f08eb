"""Plans whose work and memory must not grow faster than their input, against direct versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake import session
from framelake.operators import correlation, trace
from framelake.operators.correlation import _millionths, distribution_shift, piece_bit_counts
from framelake.plans import cubes
from framelake.plans.ordered import previous
from framelake.schemas import FRAMES
from framelake.streaming import ops
from tests.test_cubes import capture, phases_of, windows_of


def partitions_rows(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_groups_hold_no_more_points_than_their_windows_ask_for(spark, make_frames):
    """Windows of 2 s in chunks of 400 s: a group has the points of seconds, not of the chunk."""
    frames = capture(make_frames, 800).select("session_id", "ts_us", "arb_id")
    windows = spark.createDataFrame([("s", i, i * 4_000_000, i * 4_000_000 + 2_000_000) for i in range(90)], "session_id STRING, annotation_idx INT, start_us BIGINT, end_us BIGINT")
    fold = lambda points, _: points.iloc[:1].assign(n=len(points))[["n"]]
    sizes = [r["n"] for r in cubes.per_window(frames, windows, ["session_id"], ["arb_id"], F.col("start_us"), F.col("end_us"), fold, "n bigint", chunk_us=400_000_000, parts=1).collect()]
    assert max(sizes) <= 20 and sum(sizes) <= 2 * 800


@pytest.mark.parametrize("rounded", [False, True])
def test_strongest_bytes_leave_the_task(spark, make_frames, monkeypatch, rounded):
    monkeypatch.setattr(correlation, "GATHERED", 10)
    frames, windows = capture(make_frames, 400), windows_of(spark, 30, 200_000_000).where("end_us - start_us > 5000000")
    order = [F.desc("s"), *[(F.asc if rounded else F.desc)(c) for c in ("iface", "arb_id", "byte_index")]]

    def ranked(df):
        df = df.withColumn("s", F.round("score", 6) if rounded else F.col("score"))
        best = df.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "annotation_idx").orderBy(*order))).where("rank <= 3")
        return sorted(tuple(r) for r in best.select("annotation_idx", "rank", "iface", "arb_id", "byte_index", "s").collect())

    whole = distribution_shift(frames, windows, 20_000_000, 3, bin_us=30_000_000)
    few = distribution_shift(frames, windows, 20_000_000, 3, bin_us=30_000_000, top=3, rounded=rounded)
    assert ranked(few) == ranked(whole)
    assert few.count() <= 3 * cubes.PARTS * windows.count() < whole.count()


def test_millionths_round_as_spark(spark):
    rng = random.Random(4)
    xs = [0.0, 0.0000005, 0.0000015, 1.0000005, 100.1234565, 119.9999995] + [round(rng.random() * 120, rng.choice([6, 7, 7, 12])) for _ in range(300)]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 6)).collect()]
    assert [v / 1e6 for v in _millionths(np.array(xs))] == want


def test_pieces_are_no_more_than_frame_blocks(spark, make_frames):
    """Ten times the phases over the same frames: the counts a batch adds stay bounded by its frames."""
    frames = capture(make_frames, 300)
    blocks = frames.select(F.sum(F.ceil(F.length("data") / 8))).first()[0]
    for n in (25, 250):
        counts = piece_bit_counts(frames, phases_of(spark, n, 150_000_000), bin_us=30_000_000)
        total = counts.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
        assert total["rows"] <= total["n"] == blocks


def test_discovery_goes_on_with_other_phases(spark, make_frames, tmp_path):
    """A later start with more phases: earlier batches count for what was asked then, as each batch's counts do."""
    frames, phases = capture(make_frames, 400), phases_of(spark, 25, 150_000_000).where("phase != 'other'")
    few = phases.where("discovery_id < 12")
    limits = {"min_frames": 2, "min_change": 0.3, "max_restore": 0.4}
    columns = [c.split()[0] for c in FRAMES.split(", ")]
    middle = 100_000_000
    for part, asked in (F.col("ts_us") < middle, few), (F.col("ts_us") >= middle, phases):
        frames.where(part).select(columns).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in"))
        ops.stream_bit_discovery(stream, asked, str(tmp_path / "out"), str(tmp_path / "ck"), bin_us=30_000_000).awaitTermination(120)
    summed = correlation.phase_bit_counts(frames.where(F.col("ts_us") < middle), few).unionByName(correlation.phase_bit_counts(frames.where(F.col("ts_us") >= middle), phases))
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    got = rows(ops.discovered_bits(spark, str(tmp_path / "out"), bin_us=30_000_000, **limits))
    assert got == rows(correlation.candidates_from_counts(summed, **limits)) and got


def test_markers_take_their_nearest_events(spark):
    """Many events of one time, markers that overlap, that end before they start, without end: as all pairs would give."""
    rng = random.Random(6)
    events = [(rng.choice(["a", "b", None]), rng.randrange(400), rng.choice([None, *range(300)]), i) for i in range(500)]
    marks = []
    for i in range(60):
        start = rng.randrange(400)
        marks.append((rng.choice(["a", "b", None]), i // 2, f"m{i}", start, rng.choice([start, start + rng.randrange(90), start - rng.randrange(30), None])))
    e = spark.createDataFrame(events, "session_id STRING, ts_us BIGINT, pos BIGINT, service INT")
    m = spark.createDataFrame(marks, "session_id STRING, marker_id INT, label STRING, start_us BIGINT, end_us BIGINT")
    want = []
    for key in {(x[0], x[1]) for x in marks if x[0] is not None}:
        pairs = []
        for _, _, _, s, t in (x for x in marks if x[:2] == key and x[4] is not None):
            for _, ts, pos, _ in (v for v in events if v[0] == key[0] and s - 10 <= v[1] <= t + 10):
                pairs.append((0 if s <= ts <= t else min(abs(ts - s), abs(ts - t)), ts, -1 if pos is None else pos))
        want += [(*key, i, *p) for i, p in enumerate(sorted(pairs)[:5], 1)]
    for width in (7, 100):
        got = trace.markers_near_events(m, e, window_us=10, k=5, bin_us=width)
        seen = [(r["session_id"], r["marker_id"], r["rank"], round(r["delta_ms"] * 1000), r["ts_us"], -1 if r["pos"] is None else r["pos"]) for r in got.collect()]
        assert sorted(seen) == sorted(want)
    assert trace.markers_near_events(m, e.where("false"), window_us=10).count() == 0


def test_tasks_of_ordered_plans_follow_their_rows(spark):
    """Adaptive execution must not join what one task would then have to sort."""
    assert session.tasks_for(10) == spark.sparkContext.defaultParallelism and session.tasks_for(100 * session.TASK_ROWS) == 100
    rows = spark.range(4000).select((F.col("id") % 50).alias("k"), F.col("id").alias("t"), F.lit(0).alias("c"))
    seen = partitions_rows(previous(rows, ["k"], ["t"], ["t"], ["c"], tasks=40))
    assert len(seen) > 20 and sum(seen) == 4000


def test_isotp_reads_state_once_per_bucket(spark):
    """Keys of one bucket share a call: the state is listed once, and only messages left open are written."""
    import pandas as pd

    from framelake.streaming.state import IsoTpProcessor

    calls = []

    class State:
        held: dict = {}

        def iterator(self):
            calls.append("list")
            return iter(list(self.held.items()))

        def updateValue(self, key, value):
            calls.append("put")
            self.held[key] = value

        def removeKey(self, key):
            calls.append("drop")
            del self.held[key]

    p = IsoTpProcessor()
    p.state = State()
    batch = lambda rows: iter([pd.DataFrame(rows, columns=["key", "session_id", "iface", "arb_id", "ts_us", "sequence", "data"])])
    single = [(f"k{i}", "s", "can0", i, i, i, b"\x02\x3e\x00") for i in range(50)]
    first = [("k7", "s", "can0", 7, 100, 100, bytes.fromhex("1008010203040506"))]
    out = pd.concat(p.handleInputRows((0,), batch(single + first), None))
    assert len(out) == 50 and calls == ["list", "put"]
    out = pd.concat(p.handleInputRows((0,), batch([("k7", "s", "can0", 7, 200, 200, bytes.fromhex("210708"))]), None))
    assert [(r.arb_id, r.ts_us, r.completion_seq, r.payload) for r in out.itertuples()] == [(7, 100, 200, bytes(range(1, 9)))] and calls[2:] == ["list", "drop"]


def test_definition_lines_of_one_split_are_cut_in_many_tasks(spark, monkeypatch):
    from framelake.sources import dbc

    lines = spark.createDataFrame([(f"p{i}", 0, 1, f"BO_ {i} M{i}: 8 ECU") for i in range(60)], "path STRING, block BIGINT, line_no BIGINT, value STRING").coalesce(1)
    cuts = []

    def cut(df):
        cuts.append(df)
        return session.cut_lineage(df)

    monkeypatch.setattr(dbc, "cut_lineage", cut)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert dbc.definitions(lines)["messages"].count() == 60
        assert len(partitions_rows(cuts[0])) > 1 and "as_signal" in cuts[0].columns
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
