from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framelake.operators import trace
from framelake.operators.diagnostics import classify_diag, redact
from framelake.operators.isotp import reassemble_isotp
from framelake.sources.dims import read_trace_jsonl

S = "trace.v1"


def write(path, rows):
    path.write_text("".join(json.dumps({"schema": S, "sequence": i, **r}) + "\n" for i, r in enumerate(rows)))
    return str(path)


def call(kind, cid, api="PassThruWriteMsgs", utc="1970-01-01T00:00:01Z", messages=None, **more):
    return {"recordType": kind, "callId": cid, "api": api, "utc": utc, "monotonicNs": 5, "messages": messages or [], **more}


def test_valid_trace_and_matches(spark, make_frames, tmp_path):
    rows = [
        {"recordType": "session"},
        call("callBegin", "a", messages=[{"service": 34, "payloadHex": "000007E022F190", "payloadRedacted": False}]),
        call("callEnd", "a"),
        call("callBegin", "b", "PassThruReadMsgs"),
        call("callEnd", "b", "PassThruReadMsgs", "1970-01-01T00:00:01.2Z", [{"service": "0x22", "payloadHex": "000007E862F19041", "payloadRedacted": False}]),
        call("callBegin", "a", messages=[{"service": "0x27", "payloadRedacted": True}], utc="1970-01-01T00:00:02Z"),
        call("callEnd", "a", "PassThruWriteMsgs"),
        call("callBegin", "c", utc="1970-01-01T01:00:00Z", messages=[{"service": "0x10", "payloadHex": "1003"}]),
    ]
    t = read_trace_jsonl(spark, write(tmp_path / "t.jsonl", rows))
    for chunk in (1, 2, 1000):
        assert trace.validate_trace(t, S, chunk=chunk).count() == 0
    pairs = {(r["call_id"], r["occurrence"]): r["end_sequence"] for r in trace.pair_calls(t).collect()}
    assert pairs == {("a", 1): 2, ("b", 1): 4, ("a", 2): 6, ("c", 1): None}
    s = {(r["section"], r["name"]): r["value"] for r in trace.trace_summary(t).collect()}
    assert s["totals", "messages"] == 4 and s["totals", "redacted_messages"] == 1 and s["api", "PassThruWriteMsgs"] == 3
    f = make_frames([(1.01, "can0", 0x7E0, "0322F190"), (1.21, "can0", 0x7E8, "0462F19041"), (2.3, "can0", 0x7E0, "022701"), (2.1, "can0", 0x7E0, "023E00")])
    bus = redact(classify_diag(reassemble_isotp(f)))
    out = {(r["call_id"], r["sequence"]): r for r in trace.match_trace_to_bus(trace.explode_trace_messages(t).withColumn("session_id", F.lit("s")), bus).collect()}
    assert out["a", 1]["status"] == out["b", 4]["status"] == "exactPayloadAndTimeMatch"
    assert out["a", 5]["status"] == "serviceAndTimeCandidate" and out["a", 5]["payload_compared"] is False and round(out["a", 5]["delta_ms"]) == 300
    assert out["c", 7]["status"] == "noBusCandidateInWindow"


@pytest.mark.parametrize("rows,rule", [
    ([call("callBegin", "a")], "firstRecordNotSession"),
    ([{"recordType": "session"}, call("callEnd", "a")], "orphanCallEnd"),
    ([{"recordType": "session"}, call("callBegin", "a"), call("callBegin", "a")], "duplicateCallBegin"),
    ([{"recordType": "session"}, call("callBegin", "a"), call("callEnd", "a", "Other")], "apiMismatch"),
    ([{"recordType": "session"}, {"recordType": "note"}], "unknownRecordType"),
    ([{"recordType": "session"}, {"recordType": "session", "sequence": 7}], "nonContiguousSequence"),
    ([{"recordType": "session", "schema": "x"}], "unexpectedSchema"),
])
def test_violations(spark, tmp_path, rows, rule):
    t = read_trace_jsonl(spark, write(tmp_path / "t.jsonl", rows))
    assert [r["rule"] for r in trace.validate_trace(t, S).collect()] == [rule]


def test_markers_near_events(spark, make_frames):
    f = make_frames([(t, "can0", 0x7E0, "023E00") for t in (0.5, 4.0, 10.0, 12.0, 30.0)])
    e = classify_diag(reassemble_isotp(f))
    m = spark.createDataFrame([("s", 1, "m", 9_000_000, 11_000_000), ("other", 2, "m", 9_000_000, 11_000_000)], "session_id STRING, marker_id INT, label STRING, start_us BIGINT, end_us BIGINT")
    got = [(r["rank"], r["ts_us"], r["delta_ms"]) for r in trace.markers_near_events(m, e, k=2).orderBy("rank").collect()]
    assert got == [(1, 10_000_000, 0.0), (2, 12_000_000, 1000.0)]
