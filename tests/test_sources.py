from __future__ import annotations

import json
import struct
import zipfile
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from framelake.operators import quality, reports
from framelake.sinks import definitions as sink
from framelake.sinks.tables import append_marker, candump_lines, write_candump, write_json_report, write_mapping, write_session, write_c5_tables
from framelake.sources import adapters, c5, candump, dbc, dims, transcripts
from framelake.sources.lines import read_lines


def test_candump_modes_and_line_numbers(spark, tmp_path):
    log = tmp_path / "drive.log"
    log.write_text("(1000.000001) can0 100#01\n\n# MARK (1000.5) 2026-01-01T00:00:00Z source=op label=Drive start\n(1000.000002) vcan0 10204040#010203\n(1.5) can0 0100#R\njunk\n(2.0) can0 100#1\n(3.0) can0 100##1AABB\n")
    lenient = candump.read_candump(spark, str(log), mode="lenient").orderBy("sequence").collect()
    assert [(r["sequence"], r["ts_us"], r["arb_id"], r["is_extended"], r["session_id"]) for r in lenient] == [
        (1, 1000000001, 0x100, False, f"file:{log}"), (4, 1000000002, 0x10204040, True, f"file:{log}"),
    ]
    extended = candump.read_candump(spark, str(log), mode="extended").orderBy("sequence").collect()
    assert [(r["sequence"], r["remote"], bytes(r["data"]).hex(), r["is_extended"]) for r in extended] == [
        (1, False, "01", False), (4, False, "010203", True), (5, True, "", True), (8, False, "aabb", False),
    ]
    bad = candump.bad_lines(spark, str(log)).orderBy("line_no").collect()
    assert [(r["line_no"], r["reason"]) for r in bad if r["text"]] == [(3, "malformed"), (5, "malformed"), (6, "malformed"), (7, "oddLengthData"), (8, "malformed")]
    with pytest.raises(Exception, match="Malformed capture line"):
        candump.read_candump(spark, str(log)).select("sequence", "data").collect()
    marks = candump.read_markers(spark, str(log), "MARK").collect()
    assert [(m["sequence"], m["ts_us"], m["source"], m["label"]) for m in marks] == [(3, 1000500000, "op", "Drive start")]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.txt").write_text("".join(f"line {i}\n" for i in range(1, 4001 + n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > 20
        assert lines.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert lines.count() == 12003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_adapter_dialects(spark, tmp_path):
    log = tmp_path / "a.txt"
    log.write_text("1.0 t1232AABB\n1.1 T1234567801\n".replace("T1234567801", "T12345678111") + "1.2 r1230\n1.3 t1239AA\n1.4 OK\n")
    rows = adapters.read_adapter_log(spark, str(log), "slcan").orderBy("sequence").collect()
    assert [(r["arb_id"], bytes(r["data"]).hex(), r["is_extended"], r["remote"]) for r in rows] == [
        (0x123, "aabb", False, False), (0x12345678, "11", True, False), (0x123, "", False, True),
    ]
    log.write_text("1.0 123AABB\n1.1 12345678AA\n1.2 00 00 01 23 02 AA BB\n1.3 123 2 AA BB\n1.4 SEARCHING...\n1.5 STN 1\n1.6 FFFFFFFFAA\n1.7 123 2 AA\n")
    stm = adapters.read_adapter_log(spark, str(log), "stm").orderBy("sequence").collect()
    assert [(r["arb_id"], bytes(r["data"]).hex(), r["is_extended"]) for r in stm] == [
        (0x123, "aabb", False), (0x12345678, "aa", True), (0x123, "aabb", True), (0x123, "aabb", False),
    ]
    assert adapters.read_adapter_log(spark, str(log), "vlinker").count() == 3


def c5_file():
    def tlv(kind, body):
        return bytes([kind, len(body)]) + body

    can = lambda bus, cid, dlc, ms: tlv(5, struct.pack("<BHBI", bus, cid, dlc, ms) + bytes(range(8)))
    return (
        tlv(1, struct.pack("<BHh", 2, 0x1F1, -3)) + can(1, 0x100, 2, 1000) + can(6, 0x100, 2, 1001) + can(2, 0x800, 2, 1002) + can(3, 0x200, 8, 1003)
        + tlv(0x24, struct.pack("<I", 1500) + b"$GPVTG,0,T,0,M,1.0,N,36.5,K\r\n\x00") + tlv(0x24, struct.pack("<I", 1) + b"\r\n") + tlv(0x77, b"skip") + b"\x05\x10\x01"
    )


def test_c5_folder_and_zip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "A.BIN").write_bytes(c5_file())
    with zipfile.ZipFile(tmp_path / "in" / "trips.zip", "w") as z:
        z.writestr("deep/B.BIN", c5_file()[:-3])
    r = c5.read_c5(spark, str(tmp_path / "in"))
    can = c5.can_records(r).orderBy("source", "offset").collect()
    assert [(x["source"], x["bus"], x["can_id"], bytes(x["data"]).hex()) for x in can][:2] == [("A.BIN", 1, 0x100, "0001"), ("A.BIN", 3, 0x200, "0001020304050607")]
    assert len(can) == 4
    assert c5.configured_ids(r).where("source = 'A.BIN'").first()["config_value"] == -3
    assert c5.gps_records(r).count() == 2
    status = {x["source"]: x["malformed_tail"] for x in c5.source_status(r).collect()}
    assert status == {"A.BIN": True, "B.BIN": False}
    write_c5_tables(r, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "can"), header=True).count() == 4


DBC = '''VERSION "1.0"
NS_ :
 CM_
 BA_
BS_:
BU_: ECU_A ECU_B
BO_ 291 Engine: 8 ECU_A
 SG_ Speed m1 : 7|16@0- (0.125,-40) [0|250] "km\\"h" ECU_B,ECU_C
 SG_ Mode M : 16|4@1+ (1,0) [0|15] "" Vector__XXX
BO_ 2566844416 Body: 8 ECU_B
 SG_ Door : 0|1@1+ (1,0) [0|1] "" ECU_A
CM_ BO_ 291 "Engine data";
CM_ SG_ 291 Speed "The \\"speed\\"";
VAL_ 291 Mode 0 "off" 1 "on" -1 "bad" ;
BA_DEF_ "x" INT 0 1;
'''


def test_dbc_load_and_round_trip(spark, tmp_path):
    (tmp_path / "a.dbc").write_text("﻿" + DBC, encoding="utf-8")
    t = dbc.read_dbc(spark, str(tmp_path / "a.dbc"))
    assert t["violations"].count() == 0
    counts = {k: v.count() for k, v in t.items()}
    assert (counts["messages"], counts["signals"], counts["values"], counts["nodes"], counts["passthrough"]) == (2, 3, 3, 2, 1)
    speed = t["signals"].where("name = 'Speed'").first()
    assert (speed["arbitration_id"], speed["is_signed"], speed["factor"], speed["unit"], speed["receivers"], speed["comment"], speed["multiplex"]) == (
        291, True, 0.125, 'km"h', ["ECU_B", "ECU_C"], 'The "speed"', "m1",
    )
    body = t["messages"].where("name = 'Body'").first()
    assert body["is_extended"] and body["arbitration_id"] == 2566844416 & 0x1FFFFFFF
    again = dbc.definitions(sink.rendered_as_lines(t))
    assert sink.semantic_diff(sink.default_receivers(t), sink.default_receivers(again)).count() == 0
    text = sink.render_dbc(t).first()["text"]
    assert 'CM_ SG_ 291 Speed "The \\"speed\\"";' in text and text.endswith("INT 0 1;\n")


def test_dbc_violations(spark, tmp_path):
    (tmp_path / "b.dbc").write_text('SG_ Lost : 0|1@1+ (1,0) [0|1] "" X\nBO_ 1 A: 65 E\nBO_ 1 B: 1 E\n SG_ Far : 9|1@1+ (1,0) [0|1] "" X\n SG_ Long : 0|65@1+ (1,0) [0|1] "" X\nBO_ broken\nVAL_ 1 None 0 "a" ;\nCM_ BO_ 9 "x";\n')
    rules = {r["rule"] for r in dbc.read_dbc(spark, str(tmp_path / "b.dbc"))["violations"].collect()}
    assert rules == {
        "signalWithoutMessage", "dlcOutOfRange", "duplicateMessage", "signalOutsideMessage", "signalLengthOutOfRange", "malformedStatement",
        "valuesWithoutSignal", "noteWithoutMessage",
    }


def test_manifest_ingest_and_sinks(spark, tmp_path):
    log = tmp_path / "cap" / "drive.log"
    log.parent.mkdir()
    log.write_text("(1000.000001) can0 100#01\n(1000.000002) vcan0 10204040#010203\n")
    manifest = {
        "schema": "capture.v1", "session_id": "s1", "capture_type": "passive", "vehicle": {"model": "M", "generation": 1},
        "time": {"metadata_started_utc": "1970-01-01T00:16:40+00:00", "can_duration_seconds": 0.1}, "capture_status": {"total_frames": 2},
        "buses": [{"logged_interface": "can0", "bus": "a", "frames": 1, "unique_arbitration_ids": 1, "captured": True}, {"logged_interface": "vcan0", "bus": "b"}],
        "files": [
            {"name": "drive.log", "role": "candump_log", "size_bytes": log.stat().st_size, "sha256": sha256(log.read_bytes()).hexdigest().upper()},
            {"name": "gone.flac", "role": "audio"},
        ],
    }
    path = tmp_path / "m.json"
    path.write_text(json.dumps(manifest))
    m = dims.read_manifest(spark, str(path), "capture.v1")
    assert {r["name"]: r["status"] for r in quality.verify_files(m["capture_files"], spark, str(log.parent)).collect()} == {"drive.log": "verified", "gone.flac": "missing"}
    assert quality.sessions_without_log(m["capture_files"]).count() == 0
    assert [r["state"] for r in reports.session_summary(m["sessions"], m["buses"]).collect()] == ["captured", "no frames"]
    frames = candump.read_candump(spark, str(log), session_id="s1")
    store = str(tmp_path / "frames")
    assert write_session(frames, m["sessions"], store).count() == 2
    with pytest.raises(ValueError, match="already present"):
        write_session(frames, m["sessions"], store)
    other = frames.withColumn("session_id", F.lit("s2"))
    write_session(other, m["sessions"].withColumn("session_id", F.lit("s2")), store)
    derived = str(tmp_path / "derived")
    frames.unionByName(other).write.partitionBy("session_id").parquet(derived)
    write_session(frames, m["sessions"], store, replace=True, derived=(derived,))
    assert spark.read.parquet(store).count() == 4
    assert [r["session_id"] for r in spark.read.parquet(derived).select("session_id").distinct().collect()] == ["s2"]
    with pytest.raises(ValueError, match="Frame count"):
        write_session(frames.where("sequence = 1"), m["sessions"], store, replace=True)
    write_candump(frames, str(tmp_path / "text"))
    back = candump.read_candump(spark, str(tmp_path / "text" / "session_id=s1"), session_id="s1")
    assert sorted(back.select("ts_us", "data").collect()) == sorted(frames.select("ts_us", "data").collect())
    assert [r["value"] for r in candump_lines(frames).orderBy("sequence").collect()] == ["(1000.000001) can0 100#01", "(1000.000002) vcan0 10204040#010203"]
    manifest["schema"] = "other"
    path.write_text(json.dumps(manifest))
    with pytest.raises(Exception, match="Invalid capture manifest"):
        dims.read_manifest(spark, str(path), "capture.v1")["sessions"].collect()


def test_transcripts_catalogs_and_reports(spark, tmp_path):
    tsv = tmp_path / "t.tsv"
    tsv.write_text("audio_start_seconds\taudio_end_seconds\ttext\n0.0\t1.0\tpress\n1.5\t2.0\t \n2.5\t3.0\trelease\n")
    assert [(r["idx"], r["text"]) for r in dims.read_transcript(spark, str(tsv), drop_empty=True).collect()] == [(1, "press"), (3, "release")]
    tsv.write_text("audio_start_seconds\taudio_end_seconds\ttext\n0.0\t1.0\ta\n0.5\t2.0\tb\n")
    with pytest.raises(Exception, match="overlapping"):
        dims.read_transcript(spark, str(tsv)).collect()
    catalog = tmp_path / "c.json"
    catalog.write_text(json.dumps({"schemaVersion": 1, "catalogId": "c", "signals": [
        {"name": "x", "status": "confirmed", "channel": 4, "canId": "0x17D", "extended": False, "decode": {"type": "bit", "byte": 2, "bit": 5, "true": "on", "false": "off"}},
        {"name": "y", "status": "rumour", "channel": 4, "canId": "0x17D", "extended": False, "decode": {"type": "bit"}}]}))
    c = dims.read_signal_catalog(spark, str(catalog))
    assert [r["name"] for r in dims.validate_catalog(c).collect()] == ["y"]
    refs = tmp_path / "r.json"
    refs.write_text(json.dumps({"schemaVersion": 1, "catalogId": "h", "confidence": "candidate", "module": "HPCM2", "transport": {"requestCanId": "0x7E4", "responseCanId": "0x7EC", "dynamicResponseCanId": "0x5EC"}}))
    assert sorted((r["role"], r["can_id"]) for r in dims.read_address_reference(spark, str(refs)).collect()) == [("dataStream", 0x5EC), ("normalResponse", 0x7EC), ("request", 0x7E4)]
    registry = tmp_path / "reg.csv"
    registry.write_text("source,network,bitrate_kbps,can_id_hex,message_name,signal_name,start_bit,length,endian,signed,scale,offset,unit,confidence,notes\na,internal_becm_bicm,125,0x460,M,Cell_01,3,12,motorola,false,0.00125,0,V,c,\na,other,500,0x1,M,S,0,8,intel,false,1,0,,c,\na,internal_becm_bicm,125,0x461,M,,3,12,motorola,false,1,0,V,c,\n")
    assert [(r["signal"], r["can_id"]) for r in dims.read_registry_csv(spark, str(registry)).collect()] == [("Cell_01", 0x460)]
    voice = tmp_path / "v.json"
    voice.write_text(json.dumps({"schema": "voice.v1", "events": [{"annotation_index": 1, "text": "go", "can_window_start_epoch_seconds": 1.5, "can_window_end_epoch_seconds": 2.0}]}))
    v = dims.voice_markers(spark, str(voice), "voice.v1").first()
    assert (v["start_us"], v["end_us"], v["label"], v["input_latency_calibrated"]) == (1500000, 2000000, "go", False)
    speed = tmp_path / "sp.json"
    speed.write_text(json.dumps({"schema": "speed.v1", "topSpeedCandidates": [{"bus": 1, "canIdHex": "210", "kind": "u8", "offset": 0}, {"canIdHex": "zz"}]}))
    assert [r["can_id"] for r in dims.speed_candidates(spark, str(speed), "speed.v1").collect()] == [0x210]
    for i, slot in enumerate(("S1", "S1", "S2"), start=1):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "report.json").write_text(json.dumps({"mapping": [{"cell": "C1", "slot": slot, "score": 0.95, "rmseV": 0.001, "confidence": "strongCandidate"}]}))
    m = dims.mapping_reports(spark, [str(tmp_path / f"run{i}" / "report.json") for i in (1, 2, 3)])
    assert sorted((r["session"], r["slot"]) for r in m.collect()) == [(1, "S1"), (2, "S1"), (3, "S2")]
    know = spark.createDataFrame([("k", "can0", "n", 500, 1), ("k", "can0", "n", 500, 1)], "catalog_id STRING, logged_bus STRING, network STRING, bitrate_kbps INT, arbitration_id BIGINT")
    assert {r["rule"] for r in dims.validate_knowledge(know, {"can0": 3}).collect()} == {"busCount", "duplicateIdentity"}
    with pytest.raises(ValueError):
        dims.load_can_knowledge(know, know)
    assert dims.load_can_knowledge(know, know, replace=True).count() == 2
    append_marker(spark, str(tmp_path / "marks"), " lift\nfoot ", "voice op", 5)
    assert spark.read.json(str(tmp_path / "marks")).first().asDict() == {"label": "lift foot", "source": "voice_op", "ts_us": 5}
    with pytest.raises(ValueError):
        append_marker(spark, str(tmp_path / "marks"), "  ", "x", 1)
    write_json_report(m, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 3
    write_mapping(
        m.select("cell", "slot", "score", "rmse_v", F.lit(0.9).alias("delta_correlation"), F.lit(9).alias("overlap"), "confidence", F.lit("candidateOnly").alias("mapping_status")),
        str(tmp_path / "mapcsv"),
    )
    assert len(spark.read.csv(str(tmp_path / "mapcsv"), header=True).columns) == 8


def test_sim_transcript_golden(spark, tmp_path):
    p = tmp_path / "sim.txt"
    p.write_text("1 0x100 0x22\n; Some BCM section\n;Original - 3 more\n1 0x244 0x22 0x01 0x02\n2 10 0x644 0x62 0x01\n3 0x544 0x01,\nx y z\n4 0x7DF 0x3E 0x01\n5 nope 0x1\n")
    rows = transcripts.read_sim_transcript(spark, str(p))
    got = rows.orderBy("line_no").collect()
    assert [(r["line_no"], r["module"], r["delay_ms"], r["can_id"], r["data"]) for r in got] == [
        (1, None, None, 0x100, [0x22]), (4, "BCM", None, 0x244, [0x22, 1, 2]), (5, "BCM", 10, 0x644, [0x62, 1]), (6, "BCM", None, 0x544, [1]), (8, "BCM", None, 0x7DF, [0x3E, 1]),
    ]
    m = transcripts.sim_reference_map(rows).first()
    assert (m["request_can_ids"], m["normal_response_can_ids"], m["data_can_ids"], m["functional_request_can_ids"], m["services"], m["sections"]) == (
        [0x244], [0x644], [0x544], [0x7DF], ["0x22", "0x3E"], ["Some BCM section"],
    )
    assert transcripts.uncategorized_count(rows).first()["uncategorized"] == 1


def test_bench_and_trace_jsonl(spark, tmp_path):
    b = tmp_path / "b.jsonl"
    b.write_text('\n'.join(json.dumps(r) for r in [
        {"timestamp": "2026-01-01T00:00:00Z", "direction": "rx", "canId": "0x259", "data": "021003"}, {"timestamp": "2026-01-01T00:00:02Z", "direction": "marker", "label": "m"},
        {"timestamp": "2026-01-01T00:00:01Z", "direction": "rx", "canId": "0x7E4", "data": "013E"}]) + "\n")
    rows = reports.bench_rows(dims.read_bench_jsonl(spark, str(b)))
    registry = spark.createDataFrame([("hpcm2", 0x7E4, "implemented")], "key STRING, request_id BIGINT, simulation_status STRING")
    r = reports.unknown_module_report(rows, registry).collect()
    assert [(x["can_id"], x["services"], x["candidate_response_can_id"], x["nearby_markers"]) for x in r] == [(0x259, {"0x10": 1}, 0x659, 1)]
    assert reports.unknown_request_sequence(rows, registry).first()["request"] == "1003"
    b.write_text('{"direction": "rx"}\n')
    with pytest.raises(Exception, match="timestamped"):
        dims.read_bench_jsonl(spark, str(b)).collect()


def test_equal_base_names_are_two_sessions(spark, tmp_path):
    for folder, byte in (("a", "01"), ("b", "02")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "drive.log").write_text(f"(1.0) can0 100#{byte}\n(2.0) can0 100#{byte}\n")
    got = candump.read_candump(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("session_id", "sequence").collect()
    assert [(r["session_id"].split("/")[-2], r["sequence"], bytes(r["data"]).hex()) for r in got] == [("a", 1, "01"), ("a", 2, "01"), ("b", 1, "02"), ("b", 2, "02")]
    entries = spark.createDataFrame(
        [("s", "a/drive.log", "candump_log", 36, sha256((tmp_path / "a" / "drive.log").read_bytes()).hexdigest()), ("s", "b/drive.log", "candump_log", 36, "0" * 64), ("s", "drive.log", "audio", 1, None)],
        "session_id STRING, name STRING, role STRING, size_bytes BIGINT, sha256 STRING",
    )
    assert {r["name"]: r["status"] for r in quality.verify_files(entries, spark, str(tmp_path)).collect()} == {"a/drive.log": "verified", "b/drive.log": "hashMismatch", "drive.log": "missing"}


def test_derived_tables_lose_stale_rows_and_a_failed_write_changes_nothing(spark, make_frames, tmp_path):
    from framelake.sinks.tables import overwrite_sessions

    table = str(tmp_path / "derived")
    rows = spark.createDataFrame([("s/1", 1), ("t", 2)], "session_id STRING, x INT")
    overwrite_sessions(rows, table)
    overwrite_sessions(rows.where("x = 9"), table, spark.createDataFrame([("s/1",)], "session_id STRING"))
    assert [tuple(r) for r in spark.read.parquet(table).select("session_id", "x").collect()] == [("t", 2)]
    store, one = str(tmp_path / "frames"), spark.createDataFrame([("s", 2)], "session_id STRING, total_frames BIGINT")
    write_session(make_frames([(1.0, "can0", 1, "01"), (2.0, "can0", 1, "02")]), one, store)
    with pytest.raises(ValueError, match="differs"):
        write_session(make_frames([(1.0, "can0", 1, "07")]), one, store, replace=True)
    assert sorted(bytes(r["data"]) for r in spark.read.parquet(store).collect()) == [b"\x01", b"\x02"]
    write_session(make_frames([]), spark.createDataFrame([("s", 0)], "session_id STRING, total_frames BIGINT"), store, replace=True)
    assert spark.read.schema("session_id STRING, data BINARY").parquet(store).count() == 0
