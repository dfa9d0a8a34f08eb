"""The user-level jobs: chains of operators from files to result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import epoch_us, vtg_speed
from framelake.operators import activity, correlation, decode, diagnostics, mapping, quality, reports, trace
from framelake.operators.did_reads import pair_did_reads
from framelake.operators.isotp import reassemble_isotp
from framelake.session import cut_lineage
from framelake.sinks import definitions as dsink
from framelake.sinks.tables import overwrite_sessions, write_session
from framelake.sources import c5, candump, dbc, dims
from framelake.sources.lines import read_lines


def ingest(spark: SparkSession, manifest: str, folder: str, store: str, schema_id: str, replace: bool = False, verify: bool = True, bus_field: str = "bus") -> DataFrame:
    """Manifests and their capture logs into the session store; files are checked before anything is written.

    Only the logs that the manifests name are read. With ``verify`` every file must have the hash that its manifest gives.
    """
    m = dims.read_manifest(spark, manifest, schema_id, bus_field)
    checked = quality.verify_files(m["capture_files"], spark, folder, check_hash=verify)
    accepted = ["verified"] if verify else ["verified", "unhashed"]
    if not checked.where(~F.col("status").isin(accepted)).isEmpty() or not quality.sessions_without_log(m["capture_files"]).isEmpty():
        raise ValueError("Capture files are missing or differ from the manifest")
    logs = m["capture_files"].where("role = 'candump_log'").select("session_id", "name")
    paths = [f"{folder.rstrip('/')}/{r['name']}" for r in logs.toLocalIterator()]
    lines = read_lines(spark, paths).withColumn("name", quality.relative_path(F.col("path"), folder)).join(logs, "name")
    frames = candump.frames_from_lines(lines, "strict")
    back = write_session(frames, m["sessions"], f"{store}/frames", replace, (f"{store}/id_metrics", f"{store}/byte_metrics", f"{store}/correlations"))
    ids = m["sessions"].select("session_id")
    overwrite_sessions(m["sessions"], f"{store}/sessions", ids)
    overwrite_sessions(m["buses"], f"{store}/buses", ids)
    return back


def _chosen(spark: SparkSession, store: str, sessions: Sequence[str] | str | None) -> DataFrame:
    """The asked sessions of the store, or all of them."""
    known = spark.read.parquet(f"{store}/sessions").select("session_id", "metadata_started_utc")
    if sessions is None:
        return known
    return known.where(F.col("session_id").isin([sessions] if isinstance(sessions, str) else list(sessions)))


def discover(spark: SparkSession, store: str, sessions: Sequence[str] | str | None = None, n: int = 25) -> DataFrame:
    """Id and byte metrics of sessions (all of them by default) in one plan, stored; returns the most active ids."""
    ids = _chosen(spark, store, sessions).select("session_id")
    frames = spark.read.parquet(f"{store}/frames").join(ids, "session_id", "left_semi")
    overwrite_sessions(activity.id_activity(frames), f"{store}/id_metrics", ids)
    overwrite_sessions(activity.byte_activity(frames), f"{store}/byte_metrics", ids)
    return activity.top_ids(spark.read.parquet(f"{store}/id_metrics").join(ids, "session_id", "left_semi"), n)


def correlate(
    spark: SparkSession, store: str, session_id: str, transcript: str, baseline_us: int = 5_000_000, min_obs: int = 3, k: int = 8
) -> DataFrame:
    """Ranked bytes per annotation of the session that a transcript belongs to, stored and returned."""
    chosen = _chosen(spark, store, session_id)
    start = chosen.select(epoch_us(F.col("metadata_started_utc")).alias("us")).first()
    if start is None or start["us"] is None:
        raise ValueError("Session has no metadata start time for audio alignment")
    notes = correlation.align_annotations(dims.read_transcript(spark, transcript), start["us"]).withColumn("session_id", F.lit(session_id))
    frames = reports.filter_session(spark.read.parquet(f"{store}/frames"), session_id)
    overwrite_sessions(correlation.window_correlation(frames, notes, baseline_us, min_obs, k), f"{store}/correlations", chosen.select("session_id"))
    return reports.filter_session(spark.read.parquet(f"{store}/correlations"), session_id)


def dbc_import(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, DataFrame]:
    """Definition tables; any violation stops the import."""
    tables = dbc.read_dbc(spark, paths)
    if not tables["violations"].isEmpty():
        raise ValueError("Definition files break the format rules; see read_dbc(...)['violations']")
    return tables


def dbc_export(tables: dict[str, DataFrame]) -> DataFrame:
    """Canonical text per source, checked by parsing it back."""
    again = dbc.definitions(cut_lineage(dsink.rendered_as_lines(tables)))
    if not dsink.semantic_diff(dsink.default_receivers(tables), dsink.default_receivers(again)).isEmpty():
        raise ValueError("Rendered definitions differ from the source")
    return dsink.render_dbc(tables)


def session_extract(frames: DataFrame, refs: DataFrame) -> dict[str, DataFrame]:
    return diagnostics.session_extract(frames, refs)


def did_extract(frames: DataFrame, tx: int = 0x7E4, rx: int = 0x7EC, dynamic_rx: int = 0x5EC, window_us: int = 2_000_000) -> dict[str, DataFrame]:
    """Identifier reads and dynamic packets; messages are reassembled without sequence check and written once."""
    messages = cut_lineage(reassemble_isotp(frames, check_seq=False))
    return {"reads": pair_did_reads(messages, tx, rx, window_us), "packets": diagnostics.asof_definition(frames, messages, tx, dynamic_rx)}


def bms_map(internal: DataFrame, hv: DataFrame, registry: DataFrame, tol_us: int = 250_000, min_pairs: int = 4) -> DataFrame:
    """Cell-to-slot assignment between the internal and the high-voltage battery network, for each session."""
    cells = decode.decode_registry(internal, registry).where("signal LIKE 'Cell\\\\_%'").select("session_id", F.col("signal").alias("cell"), "ts_us", "sequence", "value")
    slots = decode.decode_hv_frames(hv).where("signal = 'cellVoltage'").select(
        "session_id", F.format_string("HVslot_%02d", "slot").alias("slot"), "ts_us", "sequence", "value"
    )
    return mapping.greedy_assign(mapping.series_pair_score(cells, slots, tol_us), min_pairs)


def speed_rank(records: DataFrame, tol_us: int = 6_000_000, min_overlap: int = 20, k: int = 50) -> DataFrame:
    """Speed candidates of logger records; GPS speed is external evidence, so nothing is confirmed here."""
    speeds = c5.gps_records(records).select(
        F.col("path").alias("session_id"), F.col("offset").alias("sequence"), (F.col("timestamp_ms") * 1000).alias("ts_us"),
        vtg_speed(F.col("sentence")).alias("speed"),
    ).where("speed IS NOT NULL")
    return correlation.signal_speed_correlation(c5.logger_frames(c5.can_records(records)), speeds, tol_us, min_overlap, k)


def evidence_bundle(
    frames: DataFrame, refs: DataFrame, markers: DataFrame, records: DataFrame | None = None, schema_id: str = "", max_delta_us: int = 1_000_000, window_us: int = 5_000_000
) -> dict[str, DataFrame]:
    """All evidence layers of a capture. Redaction comes before every correlation, so sensitive payloads never match.

    ``markers`` has (session_id, marker_id, label, start_us, end_us); ``records`` are trace records of schema ``schema_id``,
    with the session_id of the capture that each trace was recorded with.
    """
    session = session_extract(frames, refs)
    events = cut_lineage(diagnostics.redact(session["events"]))
    dids = did_extract(frames)
    layers = {"markers": markers, "diagnostic_events": events, "transactions": session["transactions"], "did_reads": dids["reads"], "dynamic_packets": dids["packets"]}
    out = {**session, **dids, "events": events, "markers_to_events": trace.markers_near_events(markers, events, window_us)}
    if records is not None:
        if not trace.validate_trace(records, schema_id).isEmpty():
            raise ValueError("Trace breaks the record rules; see validate_trace")
        owners = records.select("trace_id", "session_id").distinct()
        messages = trace.explode_trace_messages(records).join(owners, "trace_id")
        out["trace_summary"] = trace.trace_summary(records)
        out["trace_to_bus"] = trace.match_trace_to_bus(messages, events, max_delta_us)
        layers["trace_messages"] = messages
        layers["trace_to_bus"] = out["trace_to_bus"]
    out["bundle_summary"] = reports.bundle_summary(layers)
    return out
