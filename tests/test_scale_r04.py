"""Live bit discovery: what a task holds at once must not grow with the frames and windows of a time chunk."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.operators.correlation import _packed, _unpacked, bit_event_candidates, bits_of_points, candidates_from_counts, phase_bit_counts, piece_bit_counts
from framelake.plans import cubes
from framelake.schemas import FRAMES
from framelake.streaming import ops
from tests.test_cubes import capture, phases_of

LIMITS = {"min_frames": 2, "min_change": 0.3, "max_restore": 0.4}


@pytest.fixture
def small_batches(spark):
    """Batches of 50 rows between the session and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_no_group_is_given_to_python_as_a_whole(spark, make_frames):
    """A cogroup hands over all rows of a chunk, and takes all that it finds, at once."""
    frames, phases = capture(make_frames, 50), phases_of(spark, 5, 30_000_000)
    pieces = piece_bit_counts(frames, phases)
    for df in (pieces, bits_of_points(pieces, phases), bit_event_candidates(frames, phases)):
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "CoGroup" not in plan


def test_points_of_a_chunk_come_in_batches(spark, small_batches):
    """2,000 points and 300 marks of one chunk: no call gets more points than a batch has, each has all marks of its group."""
    points = spark.range(2000).select(F.lit("s").alias("session_id"), (F.col("id") % 1000).alias("ts_us"), (F.col("id") % 3).alias("arb_id"))
    marks = spark.range(300).select(F.lit("s").alias("session_id"), F.col("id").alias("ts_us")).unionByName(spark.createDataFrame([("other", 5)], "session_id STRING, ts_us BIGINT"))
    fold = lambda held, part: [{"marks": [held], "points": [len(part)]}]
    got = cubes.chunks_in_turn(points, marks, ["session_id"], ["arb_id"], lambda held: held.num_rows, fold, "marks int, points int").collect()
    assert {r["marks"] for r in got} == {300} and max(r["points"] for r in got) <= 50 and sum(r["points"] for r in got) == 2000


def test_windows_meet_one_series_at_a_time(spark, small_batches, monkeypatch):
    """Each series of a group is one call, over several batches; a chunk of too many windows is dealt to several groups."""
    points = spark.range(900).select(F.when(F.col("id") % 2 == 0, "s").alias("session_id"), F.col("id").alias("ts_us"), (F.col("id") % 6).alias("arb_id"))
    points = points.withColumn("arb_id", F.when(F.col("arb_id") < 4, F.col("arb_id")))
    windows = spark.range(120).select(F.lit("s").alias("session_id"), F.col("id").alias("w"), F.lit(0).alias("lo"), F.lit(1000).alias("hi"))
    fold = lambda held, part: [{"windows": [held], "id": part.column("arb_id").slice(0, 1).combine_chunks(), "ids": [len(set(part.column("arb_id").to_pylist()))], "n": [len(part)]}]
    for most, groups in (1000, 1), (30, 4):
        monkeypatch.setattr(cubes, "WINDOWS", most)
        got = cubes.windows_in_turn(points, windows, ["session_id"], ["arb_id"], F.col("lo"), F.col("hi"), lambda held: held.num_rows, fold, "windows int, id bigint, ids int, n int", chunk_us=1000).collect()
        assert {r["ids"] for r in got} == {1} and {r["n"] for r in got} == {150} and {r["id"] for r in got} == {0, 2, None}
        for i in (0, 2, None):
            held = [r["windows"] for r in got if r["id"] == i]
            assert sum(held) == 120 and len(held) == groups and max(held) < 120 or groups == 1 and held == [120]


@pytest.mark.parametrize("most", [1, 9, 300, 70_000])
def test_packed_counts_come_back(most):
    rng = np.random.default_rng(most)
    ones = rng.integers(0, 2, (40, 64)) * rng.integers(1, most + 1, (40, 1))
    packed = _packed(ones)
    assert (_unpacked(packed) == ones).all() and (_unpacked(packed.slice(7, 20).cast(pa.binary())) == ones[7:27]).all()
    assert len(_packed(ones[:0])) == 0 and _unpacked(packed.slice(0, 0)).shape == (0, 64)


@pytest.mark.parametrize("deal", [5, 1 << 18])
def test_pieces_and_frames_give_the_candidates_of_all_counts(spark, make_frames, small_batches, monkeypatch, deal):
    """Crowded times, several captures, null ids, discoveries with the same phases, of several intervals, or borders in one place."""
    monkeypatch.setattr(cubes, "WINDOWS", deal)
    rng = random.Random(9)
    columns = [c.split()[0] for c in FRAMES.split(", ")]
    crowd = [(rng.choice([3, 7, 30, 31, 55]), None, 0x7F, rng.choice(["00FF01", "00FF03"])) for _ in range(700)]
    frames = capture(make_frames, 300).select(columns).unionByName(make_frames(crowd, "s").select(columns)).unionByName(capture(make_frames, 90, seed=4).withColumn("session_id", F.lit("t")).select(columns))
    frames = frames.unionByName(capture(make_frames, 20).withColumn("session_id", F.lit(None).cast("string")).select(columns))
    some = phases_of(spark, 25, 140_000_000)
    same = some.where("discovery_id < 6").withColumn("discovery_id", F.col("discovery_id") + 100)
    empty = some.where("discovery_id < 3").withColumn("hi_us", F.col("lo_us"))
    phases = some.unionByName(same).unionByName(empty).unionByName(same.withColumn("session_id", F.lit("t"))).unionByName(same.withColumn("session_id", F.lit(None).cast("string")))
    asked = phases.where("phase != 'other'")
    want = rows(candidates_from_counts(phase_bit_counts(frames, asked, bin_us=30_000_000), **LIMITS))
    pieces = piece_bit_counts(frames, asked, bin_us=30_000_000)
    assert rows(bits_of_points(pieces, phases, bin_us=30_000_000, **LIMITS)) == rows(bit_event_candidates(frames, phases, bin_us=30_000_000, **LIMITS)) == want
    assert len({r[1] for r in want}) > 8 and {r[0] for r in want} == {"s", "t"}
    whole = pieces.where("session_id = 's' AND arb_id = 127").agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    assert whole["n"] == 700 and whole["most"] > 1


def test_batches_of_the_first_layout_go_on(spark, make_frames, tmp_path):
    """Counts as arrays beside packed ones: each is read as what it holds."""
    frames, phases = capture(make_frames, 200).select([c.split()[0] for c in FRAMES.split(", ")]), phases_of(spark, 10, 90_000_000)
    frames.where("ts_us < 50000000").write.parquet(str(tmp_path / "in"))
    start = lambda: ops.stream_bit_discovery(spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in")), phases, str(tmp_path / "out"), str(tmp_path / "ck"), bin_us=30_000_000).awaitTermination(120)
    start()
    folder = str(tmp_path / "out/counts/generation=0/batch=0")
    held = spark.read.parquet(folder).toPandas()
    held["ones"] = [[int(v) for v in _unpacked(pa.array([x], pa.binary()))[0]] for x in held.pop("packed")]
    spark.createDataFrame(held, "session_id string, iface string, arb_id bigint, is_extended boolean, length int, w_block int, ts_us bigint, n bigint, ones array<int>").write.mode("overwrite").parquet(folder)
    old = ops._pieces(spark, str(tmp_path / "out/counts"))
    assert sorted(list(_unpacked(pa.array([bytes(r["ones"])], pa.binary()))[0]) for r in old.collect()) == sorted(held["ones"])
    frames.where("ts_us >= 50000000").write.mode("append").parquet(str(tmp_path / "in"))
    start()
    got = rows(ops.discovered_bits(spark, str(tmp_path / "out"), bin_us=30_000_000, **LIMITS))
    assert got == rows(bit_event_candidates(frames, phases, bin_us=30_000_000, **LIMITS)) and got


def test_large_counts_of_the_first_layout(spark, tmp_path):
    ones = [0, 1, 255, 256, 65_536, 16_777_216, 2_147_483_647, 3] * 8
    spark.createDataFrame([(ones,)], "ones array<int>").write.parquet(str(tmp_path / "t"))
    got = ops._pieces(spark, str(tmp_path / "t")).first()["ones"]
    assert np.frombuffer(bytes(got), "<u4").tolist() == ones


def test_bits_that_never_change_count_where_no_change_is_asked_for(spark, make_frames):
    frames, phases = capture(make_frames, 200), phases_of(spark, 10, 90_000_000)
    limits = {"min_frames": 2, "min_change": 0.0, "max_restore": 1.0}
    counts = phase_bit_counts(frames, phases.where("phase != 'other'"), bin_us=30_000_000)
    got = rows(bit_event_candidates(frames, phases, bin_us=30_000_000, **limits))
    assert got == rows(candidates_from_counts(counts, **limits)) and any(r[-4:-1] == (0.0, 0.0, 0.0) for r in got)
