from __future__ import annotations

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from framelake import jobs
from framelake.sources import c5
from tests.battery import battery_capture, internal_registry, slot_of
from tests.test_diagnostics import refs
from tests.test_sources import DBC
from tests.test_trace import S, call, write


def test_ingest_discover_correlate(spark, tmp_path):
    cap = tmp_path / "cap"
    cap.mkdir()
    rows = [f"({1000 + i * 0.1:.6f}) can0 100#{'01' if i < 50 else 'FF'}" for i in range(80)]
    (cap / "d.log").write_text("\n".join(rows) + "\n")
    (cap / "note.flac").write_bytes(b"x")
    entry = lambda n, role: {"name": n, "role": role, "size_bytes": (cap / n).stat().st_size, "sha256": sha256((cap / n).read_bytes()).hexdigest()}
    manifest = {
        "schema": "capture.v1", "session_id": "s", "capture_type": "x", "time": {"metadata_started_utc": "1970-01-01T00:16:40Z"},
        "capture_status": {"total_frames": 80}, "buses": [{"logged_interface": "can0", "bus": "a"}], "files": [entry("d.log", "candump_log"), entry("note.flac", "audio")],
    }
    path, store = tmp_path / "m.json", str(tmp_path / "store")
    path.write_text(json.dumps(manifest))
    assert jobs.ingest(spark, str(path), str(cap), store, "capture.v1").count() == 80
    assert jobs.discover(spark, store, "s").first()["transition_count"] == 1
    tsv = tmp_path / "t.tsv"
    tsv.write_text("audio_start_seconds\taudio_end_seconds\ttext\n5.0\t6.5\tpress\n")
    assert jobs.correlate(spark, store, "s", str(tsv)).first()["distance"] == 1.0
    (cap / "d.log").write_text("changed\n")
    with pytest.raises(ValueError, match="differ from the manifest"):
        jobs.ingest(spark, str(path), str(cap), store, "capture.v1", replace=True)


def test_dbc_jobs(spark, tmp_path):
    p = tmp_path / "a.dbc"
    p.write_text(DBC)
    assert jobs.dbc_export(jobs.dbc_import(spark, str(p))).count() == 1
    p.write_text("BO_ broken\n")
    with pytest.raises(ValueError):
        jobs.dbc_import(spark, str(p))


def test_map_and_speed_jobs(spark):
    cap = battery_capture(spark, 5)
    got = jobs.bms_map(cap["internal"].where("arb_id < 1123"), cap["hv"], internal_registry(spark)).collect()
    assert {r["cell"]: r["slot"] for r in got} == {f"Cell_{c:02d}": f"HVslot_{slot_of(c):02d}" for c in range(1, 10)}
    import struct

    body = b"".join(
        bytes([5, 16]) + struct.pack("<BHBI", 1, 0x210, 2, i * 1000) + bytes([i * 2, 7]) + bytes(6)
        + bytes([0x24, 4 + len(s)]) + struct.pack("<I", i * 1000) + s
        for i in range(40) for s in [f"$GPVTG,0,T,0,M,1,N,{i}.0,K".encode()]
    )
    blobs = spark.createDataFrame([("x/A.BIN", body)], "path STRING, content BINARY")
    top = jobs.speed_rank(c5.decode_blobs(blobs)).first()
    assert (top["can_id"], top["kind"], top["offset"], top["confidence"], top["mapping_status"]) == (0x210, "u8", 0, "strongCandidate", "candidateOnly")


def test_evidence_bundle(spark, make_frames, tmp_path):
    from framelake.sources.dims import read_trace_jsonl

    f = make_frames([
        (1.0, "can0", 0x7E0, "0322F190"), (1.1, "can0", 0x7E8, "0462F19041"), (2.0, "can0", 0x7E0, "022701"), (2.1, "can0", 0x7E8, "0467010203"),
        (3.0, "can0", 0x7E4, "0322435600000000"), (3.01, "can0", 0x7EC, "05624356FFFA0000"),
    ])
    rows = [{"recordType": "session"}, call("callBegin", "a", utc="1970-01-01T00:00:01Z", messages=[{"service": "0x22", "payloadHex": "22F190"}]), call("callEnd", "a")]
    records = read_trace_jsonl(spark, write(tmp_path / "t.jsonl", rows)).withColumn("session_id", F.lit("s"))
    markers = spark.createDataFrame([("s", 1, "go", 900_000, 1_200_000)], "session_id STRING, marker_id INT, label STRING, start_us BIGINT, end_us BIGINT")
    b = jobs.evidence_bundle(f, refs(spark), markers, records, S)
    counts = {r["layer"]: r["rows"] for r in b["bundle_summary"].collect()}
    assert counts == {"markers": 1, "diagnostic_events": 6, "transactions": 2, "did_reads": 1, "dynamic_packets": 0, "trace_messages": 1, "trace_to_bus": 1}
    assert b["trace_to_bus"].first()["status"] == "exactPayloadAndTimeMatch"
    assert b["events"].where("service = 'SecurityAccess' AND payload != '<redacted>'").count() == 0
    assert b["markers_to_events"].where(F.col("rank") == 1).first()["delta_ms"] == 0.0
