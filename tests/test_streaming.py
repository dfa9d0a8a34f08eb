from __future__ import annotations

import random

from pyspark.sql import functions as F

from framelake.operators.correlation import bit_event_candidates
from framelake.operators.isotp import reassemble_isotp
from framelake.operators.pairing import pair_messages
from framelake.schemas import FRAMES
from tests.battery import battery_capture
from framelake.streaming import ops
from tests.test_diagnostics import wire


def replay(spark, frames, folder, parts=3):
    """Write frames as several files in time order, and stream them one file per batch."""
    rows = sorted(frames.collect(), key=lambda r: r["sequence"])
    size = -(-len(rows) // parts)
    import time

    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], FRAMES).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return ops.stream_frames(spark, folder, files_per_batch=1)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_stream_isotp_equals_batch(spark, make_frames, tmp_path):
    f = make_frames(wire(5, 400))
    got = sorted((r["arb_id"], r["ts_us"], bytes(r["payload"])) for r in drain(ops.stream_isotp(replay(spark, f, str(tmp_path / "in"))), "isotp"))
    assert got == sorted((r["arb_id"], r["ts_us"], bytes(r["payload"])) for r in reassemble_isotp(f, True).collect())


def test_stream_pairs_and_live_pairs(spark, tmp_path):
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        ask = rnd.random() < 0.5
        did = rnd.randrange(3)
        hx = f"0322F1{did:02X}" if ask else rnd.choice([f"0462F1{did:02X}01", "037F2278", "037F2231"])
        rows.append(("s", i, i * 1000, "can0", 0x7E0 if ask else 0x7E8, False, False, len(hx) // 2, bytes.fromhex(hx)))
    f = spark.createDataFrame(rows, FRAMES)
    endpoints = spark.createDataFrame([(0x7E0, 0x7E8)], "request_id BIGINT, response_id BIGINT")
    batch = pair_messages(ops.endpoint_messages(reassemble_isotp(f), endpoints), chunk=25)
    pick = lambda rows: sorted((r["ts_us"], r["role"], r["latency_ms"]) for r in rows)
    want = pick(batch.where("latency_ms IS NOT NULL").collect())
    messages = reassemble_isotp(f).select("session_id", "iface", "arb_id", "ts_us", "completion_seq", "payload")
    ordered = messages.orderBy("ts_us").collect()
    import time

    for i in range(3):
        spark.createDataFrame(ordered[i * 40 : (i + 1) * 40], messages.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
        time.sleep(0.02)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    got = drain(ops.stream_diag_pairs(ops.endpoint_messages(stream, endpoints)), "pairs")
    assert len(want) > 20 and pick([r for r in got if r["latency_ms"] is not None]) == want


def test_stream_cells_and_rate(spark, tmp_path):
    cap = battery_capture(spark, 2)["internal"].withColumn("data", F.substring("data", 1, 6)).withColumn("dlc", F.lit(6)).select(*[c.split()[0] for c in FRAMES.split(", ")])
    stream = replay(spark, cap, str(tmp_path / "c"), parts=2)
    snaps = drain(ops.stream_cells(stream), "cells", "update")
    assert len(snaps) == 2 and all(len(s["cells_volts"]) == 96 for s in snaps)
    rate = drain(ops.frame_rate_1s(ops.stream_frames(spark, str(tmp_path / "c")), watermark="0 seconds"), "rate", "complete")
    assert sorted((r["second_us"], r["frames"]) for r in rate) == [(0, 32), (1_000_000, 32)]
    assert len(drain(ops.stream_distinct_ids(ops.stream_frames(spark, str(tmp_path / "c"))), "ids")) == 32


def test_stream_discovery_validation_and_sink(spark, make_frames, tmp_path):
    f = make_frames([(i * 0.1, "can4", 0x17D, "000020" if 10 <= i < 20 else "000000") for i in range(30)])
    phases = spark.createDataFrame([("s", 1, "baseline", 0, 1_000_000), ("s", 1, "event", 1_000_000, 2_000_000), ("s", 1, "after", 2_000_000, 3_000_000)], "session_id STRING, discovery_id INT, phase STRING, lo_us BIGINT, hi_us BIGINT")
    assert ops.check_phase_order(phases).count() == 0
    assert ops.check_phase_order(phases.where("phase != 'after'")).count() == 1
    stream = replay(spark, f, str(tmp_path / "in"), parts=4)
    ops.stream_bit_discovery(stream, phases, str(tmp_path / "counts"), str(tmp_path / "ck1")).awaitTermination(120)
    assert ops.discovered_bits(spark, str(tmp_path / "counts")).collect() == bit_event_candidates(f, phases).collect()
    samples = stream.select("session_id", "ts_us", "sequence", F.length("data").alias("raw_value"))
    steps = spark.createDataFrame([("s", 500_000, 1, 10.0), ("s", 2_000_000, 2, None)], "session_id STRING, ts_us BIGINT, sequence BIGINT, target_mph DOUBLE")
    ops.stream_candidate_validation(samples, steps, str(tmp_path / "val"), str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "val")).where("target_mph = 10").count() == 15
    ops.stream_capture_sink(stream, str(tmp_path / "store"), str(tmp_path / "ck3"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 30


def test_stream_text_source(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.log").write_text("(1.5) can0 100#01\n# note\n(1.6) can0 100##102\n")
    rows = drain(ops.stream_frames(spark, str(tmp_path / "t"), fmt="text"), "text")
    assert sorted((r["ts_us"], bytes(r["data"]).hex()) for r in rows) == [(1500000, "01"), (1600000, "02")]


def test_pending_request_rules():
    from framelake.streaming.state import PendingRequests

    p = PendingRequests()
    assert p.push("request", 1000, 0x22, 0xF190, None) is None
    assert p.push("request", 3000, 0x22, 0xF18C, None) is None
    # a refusal names no identifier: it answers the most recent request of the service, and pending keeps it open
    assert p.push("response", 4000, 0x22, None, 0x78) == 1.0
    assert p.push("response", 5000, 0x22, 0xF18C, None) == 2.0
    assert p.push("response", 6000, 0x22, 0xF18C, None) is None
    assert p.push("response", 7000, 0x22, None, 0x31) == 6.0
    assert p.push("response", 8000, 0x22, None, 0x31) is None
    assert p.push("response", 9000, 0x27, None, None) is None
