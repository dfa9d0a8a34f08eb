"""The versioned session store, restarts of streams, and requests that expire in event time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framelake.schemas import FRAMES
from framelake.sinks import versions
from framelake.streaming import ops
from framelake.streaming.replay import replay, streamed


def test_failed_and_replaced_versions(spark, make_frames, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda: sorted((r["session_id"], r["sequence"], bytes(r["data"]).hex()) for r in versions.read_sessions(spark, store, FRAMES).collect())
    totals = lambda *t: spark.createDataFrame(list(t), "session_id STRING, total_frames BIGINT")
    assert rows() == []
    a, b = make_frames([(1.0, "can0", 1, "01"), (2.0, "can0", 1, "02")], "a"), make_frames([(1.0, "can0", 1, "0B")], "b/ü=1")
    versions.commit_sessions(a.unionByName(b), totals(("a", 2), ("b/ü=1", 1)), store)
    before = rows()
    assert len(before) == 3
    with pytest.raises(ValueError, match="already present"):
        versions.commit_sessions(a, totals(("a", 2)), store)
    new = make_frames([(5.0, "can0", 1, "07")], "a")
    with pytest.raises(ValueError, match="Frame count"):
        versions.commit_sessions(new, totals(("a", 2)), store, replace=True)
    assert rows() == before  # written, counted, and never pointed to

    def broken(c):
        return F.when(F.col("sequence") > 0, F.raise_error(F.lit("disk full"))).otherwise(c)

    with pytest.raises(Exception, match="disk full"):
        versions.commit_sessions(new.withColumn("data", broken(F.col("data")).cast("binary")), totals(("a", 1)), store, replace=True)
    assert rows() == before
    versions.commit_sessions(new, totals(("a", 1)), store, replace=True)
    assert rows() == [("a", 1, "07"), ("b/ü=1", 1, "0b")]
    versions.commit_sessions(make_frames([], "a"), totals(("a", 0)), store, replace=True)
    versions.remove_sessions(totals(("b/ü=1", None)), store)
    assert rows() == []
    assert versions.unused_versions(spark, store).count() >= 2


def test_replay_restarts_from_its_state(spark, make_frames):
    f = make_frames([(0.0, "can0", 0x7E8, "1008010203040506"), (5.0, "can0", 0x7E8, "2107080000000000"), (9.0, "can0", 0x7E8, "0101")])
    got = [(r["ts_us"], bytes(r["payload"]).hex()) for r in streamed(f, ops.stream_isotp).collect()]
    assert sorted(got) == [(0, "0102030405060708"), (9_000_000, "01")]  # the message is begun in one slice and ended in the next


def test_requests_expire_in_event_time(spark):
    schema = "session_id STRING, iface STRING, arb_id BIGINT, ts_us BIGINT, completion_seq BIGINT, payload BINARY"
    ask, answer = bytes.fromhex("22F190"), bytes.fromhex("62F19001")
    rows = [("s", "can0", 0x7E0, 0, 1, ask), ("s", "can0", 0x7E0, 60_000_000, 2, bytes.fromhex("3E00")), ("s", "can0", 0x7E8, 120_000_000, 3, answer), ("s", "can0", 0x7E0, 199_000_000, 4, ask), ("s", "can0", 0x7E8, 200_000_000, 5, answer)]
    endpoints = spark.createDataFrame([(0x7E0, 0x7E8)], "request_id BIGINT, response_id BIGINT")
    messages = spark.createDataFrame([(*r[:3], r[3] + 10**15, *r[4:]) for r in rows], schema)

    def latencies(ttl, slices):
        out = streamed(messages, lambda m: ops.stream_diag_pairs(ops.endpoint_messages(m, endpoints), ttl, "1 second"), slices)
        return {r["sequence"]: r["latency_ms"] for r in out.collect()}

    assert latencies(None, 1) == {1: None, 2: None, 3: 120_000.0, 4: None, 5: 1000.0}
    assert latencies(10_000_000, 4) == {1: None, 2: None, 3: None, 4: None, 5: 1000.0}


def test_replay_of_nothing(spark, make_frames):
    f = make_frames([])
    assert spark.read.schema(f.schema).parquet(replay(f, lambda s, out, ck: ops.stream_capture_sink(s, out, ck, once=True))).count() == 0
