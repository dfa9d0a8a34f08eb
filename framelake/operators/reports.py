"""Session, discovery, corroboration and bundle reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.bits import byte_at, byte_hex
from framelake.functions.services import candidate_response_id, single_frame_payload
from framelake.functions.text import epoch_us
from framelake.plans.ordered import counts_until


def session_summary(sessions: DataFrame, buses: DataFrame) -> DataFrame:
    """Sessions with their buses, by start time and interface."""
    return sessions.join(buses, "session_id").select(
        "session_id", "metadata_started_utc", "vehicle_model", "vehicle_generation", "total_frames", "logged_interface",
        "bus_name", "frames", "unique_arbitration_ids", F.when(F.col("captured"), "captured").otherwise("no frames").alias("state"),
    ).orderBy("metadata_started_utc", "session_id", "logged_interface")


def capture_buses(frames: DataFrame) -> DataFrame:
    """Observed buses of each session: frames and distinct ids per interface."""
    per_id = frames.groupBy("session_id", "iface", "arb_id").agg(F.count("*").alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    return per_id.groupBy("session_id", F.col("iface").alias("logged_interface")).agg(
        F.sum("n").alias("frames"), F.count("*").alias("unique_arbitration_ids"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us")
    )


def bench_rows(bench: DataFrame) -> DataFrame:
    """Bench observations with numeric id, payload and microsecond time."""
    digits = F.col("canId")
    number = F.when(F.lower(digits).startswith("0x"), F.conv(F.substr(digits, F.lit(3)), 16, 10)).otherwise(digits).cast("bigint")
    return bench.select(
        epoch_us(F.col("timestamp")).alias("ts_us"), "timestamp", "direction", number.alias("can_id"),
        F.unhex(F.regexp_replace(F.coalesce("data", F.lit("")), r"\s+", "")).alias("data"), F.coalesce("label", F.lit("")).alias("label"),
    )


def unknown_modules(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Received frames whose id is no implemented registry module."""
    known = registry.where("simulation_status = 'implemented'").select(F.col("request_id").alias("can_id"))
    return rows.where("direction = 'rx' AND can_id IS NOT NULL").join(known, "can_id", "left_anti")


def unknown_module_report(rows: DataFrame, registry: DataFrame, slack_us: int = 5_000_000) -> DataFrame:
    """One row per unknown request id: counts, times, services, candidate response id, nearby markers.

    ``rows`` are :func:`bench_rows`. The full request sequence is :func:`unknown_request_sequence`, one row per
    frame, instead of one unbounded list per id.
    """
    unknown = unknown_modules(rows, registry)
    payload = single_frame_payload(F.col("data"))
    service = F.coalesce(byte_hex(byte_at(payload, 0)), F.lit("unsupportedTransport"))
    per_service = unknown.groupBy("can_id", service.alias("service")).agg(
        F.count("*").alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")
    )
    per_id = per_service.groupBy("can_id").agg(
        F.sum("n").alias("observation_count"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("service", "n")))).alias("services"),
    )
    markers = rows.where("direction = 'marker'").select("ts_us", "label")
    # markers in [first - slack, last + slack], as a difference of two ordered counts
    edge = lambda c, shift: per_id.select("can_id", (F.col(c) + shift).alias("ts_us"))
    low = counts_until(markers, edge("first_us", -slack_us), [], ["can_id"]).select("can_id", "before")
    high = counts_until(markers, edge("last_us", slack_us), [], ["can_id"]).select("can_id", "upto")
    near = low.join(high, "can_id").select("can_id", (F.col("upto") - F.col("before")).alias("nearby_markers"))
    response = candidate_response_id(F.col("can_id"))
    status = registry.select(F.col("request_id").alias("can_id"), F.col("key").alias("registry_key"), "simulation_status")
    return per_id.join(near, "can_id", "left").join(status, "can_id", "left").select(
        "can_id", "registry_key", F.coalesce("simulation_status", F.lit("unregistered")).alias("registry_status"),
        "observation_count", (F.col("first_us") / 1e6).alias("first_ts"), (F.col("last_us") / 1e6).alias("last_ts"),
        ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration_s"), "services",
        F.coalesce("nearby_markers", F.lit(0)).alias("nearby_markers"), response.alias("candidate_response_can_id"),
        F.when(response.isNotNull(), "hypothesisOnly").alias("candidate_confidence"), F.lit(False).alias("transmit_authorized"),
    )


def unknown_request_sequence(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests to unknown ids in time order."""
    return unknown_modules(rows, registry).select(
        "can_id", "ts_us", F.hex(single_frame_payload(F.col("data"))).alias("request")
    ).orderBy("can_id", "ts_us")


def corroboration_gate(claims: DataFrame, keys: list[str], fields: list[str], families: int = 3) -> DataFrame:
    """Status of each definition: enough distinct source families that agree on every material field.

    A conflict keeps the definition a candidate however many sources there are; nothing becomes confirmed here.
    """
    out = claims.groupBy(*keys).agg(
        F.count_distinct("family").alias("source_families"), F.count_distinct(F.struct(*fields)).alias("variants")
    )
    return out.select(
        *keys, "source_families", "variants",
        F.when((F.col("source_families") >= families) & (F.col("variants") == 1), "communityCorroborated").otherwise("candidate").alias("status"),
    )


def bundle_summary(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows per evidence layer."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows") for name, df in layers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recent(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest ``n`` rows, newest first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def recent_frames(frames: DataFrame, n: int = 500) -> DataFrame:
    return recent(frames, n, ["ts_us", "sequence"])


def recent_events(events: DataFrame, n: int = 30) -> DataFrame:
    return recent(events, n, ["ts_us", "pos"])


def filter_session(df: DataFrame, session_id: str) -> DataFrame:
    return df.where(F.col("session_id") == session_id)


def filter_time_range(df: DataFrame, lo_us: int | Column, hi_us: int | Column) -> DataFrame:
    """Rows with lo <= time < hi."""
    return df.where((F.col("ts_us") >= lo_us) & (F.col("ts_us") < hi_us))
