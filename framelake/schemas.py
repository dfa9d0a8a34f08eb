"""Table schemas. Every reader declares its schema; nothing is inferred."""

from __future__ import annotations

FRAMES = (
    "session_id STRING, sequence BIGINT, ts_us BIGINT, iface STRING, arb_id BIGINT, "
    "is_extended BOOLEAN, remote BOOLEAN, dlc INT, data BINARY"
)

SIGNAL_DEFS = (
    "source STRING, network STRING, bitrate_kbps INT, can_id BIGINT, message STRING, signal STRING, "
    "start_bit INT, length INT, endian STRING, signed BOOLEAN, scale DOUBLE, offset DOUBLE, "
    "unit STRING, confidence STRING, notes STRING"
)

CATALOG = (
    "schemaVersion INT, catalogId STRING, signals ARRAY<STRUCT<name: STRING, status: STRING, channel: INT, "
    "canId: STRING, extended: BOOLEAN, decode: STRUCT<type: STRING, byte: INT, bit: INT, startBit: INT, length: INT, "
    "endianness: STRING, signed: BOOLEAN, scale: DOUBLE, offset: DOUBLE, unit: STRING, mask: STRING, shift: INT, "
    "`true`: STRING, `false`: STRING, values: MAP<STRING,STRING>>, provenance: MAP<STRING,STRING>>>"
)

ADDRESS_REFS = "catalog_id STRING, confidence STRING, module STRING, role STRING, can_id BIGINT"

_MANIFEST = (
    "schema STRING, session_id STRING, capture_type STRING, host STRING, "
    "vehicle STRUCT<platform: STRING, model: STRING, generation: STRING>, "
    "time STRUCT<metadata_started_utc: STRING, first_can_frame_utc: STRING, last_can_frame_utc: STRING, "
    "can_duration_seconds: DOUBLE, audio_duration_seconds: DOUBLE>, "
    "capture_status STRUCT<total_frames: BIGINT, termination_reason: STRING>, "
    "buses ARRAY<STRUCT<logged_interface: STRING, {bus}: STRING, adapter: STRING, adapter_channel: STRING, "
    "bitrate: BIGINT, mode: STRING, frames: BIGINT, unique_arbitration_ids: BIGINT, captured: BOOLEAN>>, "
    "files ARRAY<STRUCT<name: STRING, role: STRING, format: STRING, size_bytes: BIGINT, sha256: STRING>>"
)



def manifest(bus_field: str) -> str:
    """Manifest schema; the field of a bus entry that holds its name is the caller's."""
    return _MANIFEST.format(bus=f"`{bus_field}`")


ADDRESS_REFERENCE = (
    "schemaVersion INT, catalogId STRING, confidence STRING, module STRING, "
    "transport STRUCT<requestCanId: STRING, responseCanId: STRING, dynamicResponseCanId: STRING>, "
    "modules ARRAY<STRUCT<module: STRING, requestCanIds: ARRAY<STRING>, normalResponseCanIds: ARRAY<STRING>, "
    "dataCanIds: ARRAY<STRING>, functionalRequestCanIds: ARRAY<STRING>>>"
)

MODULE_REGISTRY = (
    "schemaVersion INT, catalogId STRING, modules ARRAY<STRUCT<key: STRING, module: STRING, requestCanId: STRING, "
    "normalResponseCanId: STRING, uudtResponseCanId: STRING, bitrate: BIGINT, confidence: STRING, simulationStatus: STRING>>"
)

VOICE_REPORT = (
    "schema STRING, input_latency_calibrated BOOLEAN, events ARRAY<STRUCT<annotation_index: INT, text: STRING, "
    "can_window_start_epoch_seconds: DOUBLE, can_window_end_epoch_seconds: DOUBLE>>"
)

MAPPING_REPORT = (
    "mapping ARRAY<STRUCT<cell: STRING, slot: STRING, score: DOUBLE, rmseV: DOUBLE, deltaCorrelation: DOUBLE, "
    "overlap: BIGINT, confidence: STRING>>"
)

SPEED_REPORT = (
    "schema STRING, topSpeedCandidates ARRAY<STRUCT<bus: INT, canIdHex: STRING, kind: STRING, offset: INT, "
    "speedCorrelation: DOUBLE, overlap: BIGINT, confidence: STRING>>"
)

TRACE_MESSAGE = (
    "STRUCT<service: STRING, dataLength: INT, payloadRedacted: BOOLEAN, payloadHex: STRING, "
    "payloadSha256: STRING, sensitiveService: BOOLEAN>"
)

TRACE = (
    "schema STRING, recordType STRING, sequence BIGINT, utc STRING, monotonicNs BIGINT, callId STRING, "
    "api STRING, threadId BIGINT, deviceId BIGINT, channelId BIGINT, returnCode BIGINT, durationNs BIGINT, "
    "arguments MAP<STRING,STRING>, outputs MAP<STRING,STRING>, "
    f"messages ARRAY<{TRACE_MESSAGE}>, "
    "sourceApplication STRING, sourceApplicationVersion STRING, observerMode BOOLEAN, "
    "proxyMayTransmitIndependently BOOLEAN, provider MAP<STRING,STRING>, "
    "providerFingerprintSha256 STRING, sensitivePayloadPolicy STRING"
)

BENCH = "timestamp STRING, direction STRING, canId STRING, data STRING, label STRING, source STRING"

C5_RECORDS = (
    "source STRING, path STRING, kind STRING, offset BIGINT, timestamp_ms BIGINT, bus INT, can_id INT, "
    "dlc INT, data BINARY, sentence STRING, config_value INT, malformed_tail BOOLEAN, bytes_consumed BIGINT"
)
