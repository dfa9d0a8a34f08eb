from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import decode, mapping, states
from framelake.operators.activity import byte_activity, id_activity, select_dominant_dlc
from framelake.operators.correlation import bit_event_candidates, signal_speed_correlation, voice_correlation, window_correlation
from tests.battery import battery_capture, internal_registry, slot_of


def samples(spark, seqs):
    rows = [(name, i * 200_000, i, s) for name, seq in seqs.items() for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "channel STRING, ts_us BIGINT, seq BIGINT, raw_state INT")


def test_sequences_and_cadence(spark, make_frames):
    s = samples(spark, {
        "up": [0x68, 0x68, 0x6A, 0x6F, 0x6B, 0x6B], "down": [0x6B, 0x6A, 0x68], "off": [0x68, 0x6A, 0x68], "on": [0x6B] * 3, "odd": [0x68, 0x6A], "long": [0x68, 0x6A, 0x6F, 0x6B, 0x68, 0x6B],
    })
    for width in (300_000, 10**12):
        got = {r["channel"]: r["classification"] for r in states.classify_sequence(s, ["channel"], chunk_us=width).collect()}
        assert got == {"up": "successfulStartup", "down": "normalShutdown", "off": "stableHvOff", "on": "stableHvEstablished", "odd": "unknownOrIncomplete", "long": "unknownOrIncomplete"}
    cad = {r["channel"]: (r["median_ms"], r["mean_ms"]) for r in states.cadence_stats(s, ["channel"]).collect()}
    assert cad["up"] == (200.0, 200.0)
    f = make_frames([(i * 0.2, "can0", 0x5EC, p) for i, p in enumerate(("FE68", "FE6A", "FE6F", "FE6B", "FD68", "FE"))])
    c = decode.decode_contactor(f)
    assert [r["phase"] for r in c.orderBy("seq").collect()] == ["hvOff", "firstMainContactorEngaged", "prechargeActive", "hvBusEstablished"]
    assert states.classify_sequence(c, ["channel"]).first()["classification"] == "successfulStartup"


PRECHARGE = [
    ([0x68, 0x6A, 0x6F, 0x6B], [(2, 380, 100), (3, 380, 375)], "successfulStartup", "converged"),
    ([0x68, 0x6A, 0x6F, 0x6B], [], "successfulStartup", "insufficientData"),
    ([0x68], [], "noMainContactorEngagement", "notEvaluated"),
    ([0x68, 0x6A], [], "stalledAfterFirstMainContactor", "notEvaluated"),
    ([0x68, 0x6A, 0x6F], [], "stalledInPrecharge", "insufficientData"),
    ([0x68, 0x6A, 0x6F], [(2, 380, 5), (3, 380, 10)], "prechargeVoltageFailedToRise", "failedToRise"),
    ([0x68, 0x6A, 0x6F], [(2, 380, 5), (3, 380, 200)], "prechargeVoltageDidNotConverge", "roseButDidNotConverge"),
    ([0x6A, 0x68], [], "unexpectedOrIncompleteSequence", "notEvaluated"),
    ([0x68, 0x6A, 0x6F, 0x6B], [(2, 0, 5), (3, 0, 100)], "prechargeVoltageDidNotConverge", "roseButDidNotConverge"),
    ([0x68, 0x6A, 0x6F, 0x6B], [(1, 380, 5), (2, 380, 100), (4, 380, 379)], "successfulStartup", "insufficientData"),
]


def test_precharge_outcomes(spark):
    s, v = {}, []
    for i, (seq, volts, _, _) in enumerate(PRECHARGE):
        s[f"c{i}"] = seq
        v += [(f"c{i}", at * 200_000, at, float(p), float(d)) for at, p, d in volts]
    volt = spark.createDataFrame(v, "channel STRING, ts_us BIGINT, sequence BIGINT, pack_v DOUBLE, dc_v DOUBLE")
    got = {r["channel"]: (r["result"], r["voltage_result"]) for r in states.classify_precharge(samples(spark, s), volt, ["channel"]).collect()}
    assert got == {f"c{i}": (a, b) for i, (_, _, a, b) in enumerate(PRECHARGE)}


def test_startup_timeline_golden(make_frames):
    f = make_frames([
        (100.0, "can1", 0x1F1, "00"), (116.1, "can1", 0x0F1, "0005"), (116.3, "can1", 0x0F1, "0210"), (118.0, "can1", 0x1F1, "03"), (118.2, "can2", 0x100, "00"),
        (118.5, "can1", 0x2C7, "03BFCABD8000"), (118.95, "can1", 0x1F1, "02"),
    ])
    t = states.startup_timeline(f)
    got = [(r["event"], r["seconds"]) for r in t["timeline"].orderBy("seconds").collect()]
    assert got == [("brakePedalMovementBegins", 16.1), ("brakePedalPressed", 16.3), ("startRequest", 18.0), ("hvCurrentTransient", 18.5), ("systemRun", 18.95)]
    i = t["intervals"].first()
    assert (round(i["movement_to_start_ms"], 3), round(i["start_to_run_ms"], 3), i["direct_hv_present_at_start"]) == (1900.0, 950.0, True)


def test_permutation_recovered(spark):
    cap = battery_capture(spark, 10)
    cells = decode.decode_registry(cap["internal"], internal_registry(spark)).select("session_id", F.col("signal").alias("cell"), "ts_us", "sequence", "value")
    slots = decode.decode_hv_frames(cap["hv"]).where("signal = 'cellVoltage'").select("session_id", F.format_string("HVslot_%02d", "slot").alias("slot"), "ts_us", "sequence", "value")
    scores = mapping.series_pair_score(cells, slots)
    assert scores.count() == 96 * 96
    got = {r["cell"]: (r["slot"], r["confidence"]) for r in mapping.greedy_assign(scores).collect()}
    assert got == {f"Cell_{c:02d}": (f"HVslot_{slot_of(c):02d}", "strongCandidate") for c in range(1, 97)}


def test_greedy_equals_sorted_scan(spark):
    rnd = random.Random(8)
    rows = [(f"c{a:02d}", f"s{b:02d}", round(rnd.choice([0.1, 0.3, 0.5, rnd.random()]), 6), 0.0, 0.001, 9) for a in range(15) for b in range(12)]
    df = spark.createDataFrame(rows, "cell STRING, slot STRING, score DOUBLE, delta_correlation DOUBLE, rmse_v DOUBLE, overlap BIGINT")
    used_c, used_s, want = set(), set(), set()
    for c, s, *_ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if c not in used_c and s not in used_s:
            used_c.add(c)
            used_s.add(s)
            want.add((c, s))
    assert {(r["cell"], r["slot"]) for r in mapping.greedy_assign(df, by=[]).collect()} == want


def test_cross_session(spark):
    rows = [(i, "A", "S1", 0.95, 0.001, "strongCandidate") for i in (1, 2, 3)] + [(i, "B", f"S{i}", 0.95, 0.001, "strongCandidate") for i in (1, 2, 3)] + [(1, "C", "S9", 0.95, 0.001, "strongCandidate")]
    out = mapping.cross_session_mapping(spark.createDataFrame(rows, "session INT, cell STRING, slot STRING, score DOUBLE, rmse_v DOUBLE, confidence STRING"))
    assert {r["cell"]: (r["slot"], r["status"]) for r in out.collect()} == {
        "A": ("S1", "repeatableCrossSessionCandidate"), "B": (None, "inconsistentAcrossSessions"), "C": ("S9", "needsMoreEvidence"),
    }


def test_activity_golden(make_frames):
    f = make_frames([(1.0, "can0", 0x100, "0102"), (2.0, "can0", 0x100, "0103"), (3.0, "can0", 0x100, "01"), (4.0, "can0", 0x100, "0104")])
    for width in (10**6, 10**9):
        r = id_activity(f, width).first()
        assert (r["frame_count"], r["transition_count"], r["changing_byte_count"], r["mean_period_ms"], r["activity_score"]) == (4, 3, 1, 1000.0, 107.0)
        b = {x["byte_index"]: (x["observation_count"], x["distinct_values"], x["change_count"]) for x in byte_activity(f, width).collect()}
        assert b == {0: (4, 1, 0), 1: (3, 3, 2)}
    tie = make_frames([(2.0, "can0", 1, "AA"), (1.0, "can0", 1, "BBBB")])
    assert [bytes(r["data"]).hex() for r in select_dominant_dlc(tie).collect()] == ["bbbb"]


def test_bit_discovery_golden(spark, make_frames):
    rows = [(i * 0.1, "can4", 0x17D, "000020" if 10 <= i < 20 else "000000") for i in range(30)]
    phases = spark.createDataFrame([("s", 1, "baseline", 0, 1_000_000), ("s", 1, "event", 1_000_000, 2_000_000), ("s", 1, "after", 2_000_000, 3_000_000)], "session_id STRING, discovery_id INT, phase STRING, lo_us BIGINT, hi_us BIGINT")
    got = bit_event_candidates(make_frames(rows), phases).collect()
    assert [(r["byte_index"], r["bit_index"], r["score"]) for r in got] == [(2, 5, 1.0)]


def test_window_and_voice_correlation(spark, make_frames):
    rows = [(1000 + i * 0.1, "can0", 0x100, "01" if i < 50 else "FF") for i in range(80)] + [(1000 + i * 0.1 + 0.05, "can0", 0x200, "07") for i in range(80)]
    a = spark.createDataFrame([("s", 1, 1_005_000_000, 1_006_500_000)], "session_id STRING, annotation_idx INT, start_us BIGINT, end_us BIGINT")
    for fn in (window_correlation, voice_correlation):
        top = fn(make_frames(rows), a).where("rank = 1").first()
        assert (top["arb_id"], top["byte_index"], top["distance"]) == (0x100, 0, 1.0) and top["score"] > 100


def test_speed_ramp_and_constant(spark, make_frames):
    f = make_frames([(i, "1", 0x210, f"{i * 2:02X}55") for i in range(40)], session="x")
    speeds = spark.createDataFrame([("x", i, i * 1_000_000, float(i)) for i in range(40)], "session_id STRING, sequence BIGINT, ts_us BIGINT, speed DOUBLE")
    out = {(r["kind"], r["offset"]): (r["r"], r["confidence"]) for r in signal_speed_correlation(f, speeds).collect()}
    assert out["u8", 0] == (1.0, "strongCandidate") and out["u8", 1] == (0.0, "background")
    short = speeds.where("sequence < 10")
    assert signal_speed_correlation(f, short, tol=0).count() == 0
    with pytest.raises(Exception):
        signal_speed_correlation(f, short.drop("speed"))


def test_captures_at_one_time_do_not_meet(spark, make_frames):
    def drive(byte, session):
        return make_frames([(1000 + i * 0.1, "can0", 0x100, byte if 50 <= i < 65 else "00") for i in range(80)], session)

    frames = drive("FF", "a").unionByName(drive("00", "b"))
    notes = spark.createDataFrame([(s, 1, 1_005_000_000, 1_006_500_000) for s in "ab"], "session_id STRING, annotation_idx INT, start_us BIGINT, end_us BIGINT")
    assert {(r["session_id"], r["distance"]) for r in window_correlation(frames, notes).collect()} == {("a", 1.0), ("b", 0.0)}


def test_bytes_beyond_the_eighth_count(spark, make_frames):
    from framelake.functions.bits import explode_bytes, extract_words
    from framelake.operators.activity import byte_activity, id_activity

    frames = make_frames([(i * 0.1, "can0", 0x100, "00" * 10 + ("20" if 10 <= i < 20 else "00") + "00" * 9) for i in range(30)])
    assert id_activity(frames).first()["transition_count"] == 2 and id_activity(frames).first()["changing_byte_count"] == 1
    assert [r["byte_index"] for r in byte_activity(frames).where("change_count > 0").collect()] == [10] and byte_activity(frames).count() == 20
    assert explode_bytes(frames).where("value = 32").select("byte_index").distinct().first()[0] == 10
    words = extract_words(frames.where("sequence = 15"))
    assert words.count() == 20 + 2 * 19
    assert {(r["kind"], r["offset"], r["x"]) for r in words.where("x > 0").collect()} == {("u8", 10, 32), ("u16le", 10, 32), ("u16be", 10, 8192), ("u16le", 9, 8192), ("u16be", 9, 32)}
    phases = spark.createDataFrame([("s", 1, "baseline", 0, 1_000_000), ("s", 1, "event", 1_000_000, 2_000_000), ("s", 1, "after", 2_000_000, 3_000_000)], "session_id STRING, discovery_id INT, phase STRING, lo_us BIGINT, hi_us BIGINT")
    assert [(r["byte_index"], r["bit_index"], r["length"]) for r in bit_event_candidates(frames, phases).collect()] == [(10, 5, 20)]
