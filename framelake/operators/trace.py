"""Pass-through call traces: validation, summaries, messages, and their match with bus events and markers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framelake.functions.services import normalise_service
from framelake.functions.text import epoch_us
from framelake.operators.isotp import SEQUENCE_CHUNK
from framelake.plans.cubes import SLICE, per_window
from framelake.plans.ordered import CHUNK_US, Carry, running
from framelake.plans.timejoin import nearest_within
from framelake.session import cut_lineage, tasks_for


def validate_trace(records: DataFrame, schema_id: str, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Violations as rows (trace_id, sequence, rule, detail); a valid trace gives none.

    ``records`` has (trace_id, line, ...trace columns). Lines are cut into chunks; the previous record of the
    trace and of the call are carried across chunk borders.
    """
    chunked = records.withColumn("_chunk", F.expr(f"line div {chunk}"))
    kind = F.col("recordType")
    placed = running(chunked, ["trace_id"], ["line"], {"_before": Carry("last", F.col("sequence"), inclusive=False)}, ["_chunk"])
    calls = chunked.where(kind.isin("callBegin", "callEnd")).withColumn("callId", F.coalesce("callId", F.lit("")))
    opened = F.struct((kind == "callBegin").alias("open"), F.col("api").alias("api"))
    lagged = running(calls, ["trace_id", "callId"], ["line"], {"_prev": Carry("last", opened, inclusive=False)}, ["_chunk"])
    is_open = F.coalesce(F.col("_prev.open"), F.lit(False))
    begin, end = kind == "callBegin", kind == "callEnd"

    def broken(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
        found = F.array(
            *[
                F.when(F.coalesce(condition, F.lit(True)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
                for name, condition, detail in rules
            ]
        )
        return df.select("trace_id", "line", F.inline(F.filter(found, lambda v: v.isNotNull())))

    by_record = broken(placed, [
        ("unexpectedSchema", F.col("schema") != schema_id, F.col("schema")),
        ("nonContiguousSequence", F.col("sequence") != F.coalesce(F.col("_before") + 1, F.lit(0)), F.col("sequence")),
        ("firstRecordNotSession", F.col("_before").isNull() & ~kind.eqNullSafe("session"), kind),
        ("unknownRecordType", ~F.coalesce(kind, F.lit("")).isin("session", "callBegin", "callEnd"), kind),
    ])
    by_call = broken(lagged, [
        ("duplicateCallBegin", begin & (is_open | (F.col("callId") == "")), F.col("callId")),
        ("orphanCallEnd", end & ~is_open, F.col("callId")),
        ("apiMismatch", end & is_open & ~F.col("api").eqNullSafe(F.col("_prev.api")), F.col("api")),
    ])
    return by_record.unionByName(by_call)


def trace_summary(records: DataFrame) -> DataFrame:
    """Counts per trace, with calls started per API as rows (section, name, value)."""
    kind = F.col("recordType")
    messages = F.coalesce(F.size("messages"), F.lit(0))
    redacted = F.coalesce(F.size(F.filter("messages", lambda m: m["payloadRedacted"])), F.lit(0))
    totals = records.groupBy("trace_id").agg(
        F.count("*").alias("records"),
        F.sum(F.when(kind == "callBegin", 1).otherwise(0)).alias("calls_started"),
        F.sum(F.when(kind == "callEnd", 1).otherwise(0)).alias("calls_completed"),
        F.sum(F.greatest(messages, F.lit(0))).alias("messages"),
        F.sum(F.greatest(redacted, F.lit(0))).alias("redacted_messages"),
    )
    names = ["records", "calls_started", "calls_completed", "messages", "redacted_messages"]
    long = totals.select(
        "trace_id", F.inline(F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(n).alias("name"), F.col(n).cast("bigint").alias("value")) for n in names]))
    )
    apis = records.where(kind == "callBegin").groupBy("trace_id", F.col("api").alias("name")).agg(F.count("*").alias("value"))
    return long.unionByName(apis.select("trace_id", F.lit("api").alias("section"), "name", "value"))


def message_direction() -> Column:
    api, kind = F.col("api"), F.col("recordType")
    return (
        F.when((api == "PassThruWriteMsgs") & (kind == "callBegin"), "applicationToProvider")
        .when((api == "PassThruReadMsgs") & (kind == "callEnd"), "providerToApplication")
        .when((api == "PassThruStartPeriodicMsg") & (kind == "callBegin"), "applicationToProviderPeriodic")
        .otherwise("other")
    )


def explode_trace_messages(records: DataFrame) -> DataFrame:
    """One row per message of a call, with its direction and time."""
    kept = records.select(
        "trace_id", "sequence", "utc", "monotonicNs", "callId", "api", "recordType",
        message_direction().alias("direction"), F.posexplode("messages").alias("message_index", "message"),
    )
    return kept.select(
        "trace_id",
        "sequence",
        epoch_us(F.col("utc")).alias("ts_us"),
        F.col("monotonicNs").alias("monotonic_ns"),
        F.col("callId").alias("call_id"),
        "api",
        F.col("recordType").alias("record_type"),
        "direction",
        "message_index",
        normalise_service(F.col("message.service")).alias("service_id"),
        F.col("message.payloadHex").alias("payload_hex"),
        F.coalesce("message.payloadRedacted", F.lit(False)).alias("payload_redacted"),
    )


def payload_candidates(payload_hex: Column, redacted: Column) -> Column:
    """Payload texts to compare: the whole, and the whole without a leading four-byte id."""
    compact = F.upper(F.regexp_replace(payload_hex, r"\s+", ""))
    usable = ~redacted & (F.length(compact) % 2 == 0) & (F.length(compact) > 0)
    both = F.when(F.length(compact) > 8, F.array(compact, F.substr(compact, F.lit(9)))).otherwise(F.array(compact))
    return F.when(F.coalesce(usable, F.lit(False)), both).otherwise(F.array().cast("array<string>"))


def pair_calls(records: DataFrame, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Begin and end of each call; a call id may be used again after it ended."""
    calls = records.where(F.col("recordType").isin("callBegin", "callEnd")).withColumn("_chunk", F.expr(f"line div {chunk}"))
    begin = (F.col("recordType") == "callBegin").cast("bigint")
    turns = running(calls, ["trace_id", "callId"], ["line"], {"occurrence": Carry("sum", begin)}, ["_chunk"])
    side = lambda kind: turns.where(F.col("recordType") == kind)
    b = side("callBegin").select("trace_id", "callId", "occurrence", "api", F.col("sequence").alias("begin_sequence"), F.col("monotonicNs").alias("begin_ns"))
    e = side("callEnd").select("trace_id", "callId", "occurrence", F.col("sequence").alias("end_sequence"), F.col("monotonicNs").alias("end_ns"), "returnCode", "durationNs")
    return b.join(e, ["trace_id", "callId", "occurrence"], "left").select(
        "trace_id", F.col("callId").alias("call_id"), "occurrence", "api", "begin_sequence", "end_sequence",
        F.col("returnCode").alias("return_code"), F.coalesce("durationNs", F.col("end_ns") - F.col("begin_ns")).alias("duration_ns"),
    )


def _bus_side(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.select(
        *by,
        F.when(F.col("direction") == "request", "request").otherwise("response").alias("side"),
        "ts_us",
        F.col("pos").alias("sequence"),
        F.upper("payload").alias("bus_payload"),
        F.col("service_id").alias("bus_service_id"),
        F.struct(
            (F.col("ts_us") / 1e6).alias("timestamp"), "channel", "can_id", "direction", "service", "service_id",
            F.coalesce(F.col("payload_redacted"), F.lit(False)).alias("redacted"),
        ).alias("bus_event"),
    )


def _tail_key(tail: Column) -> Column:
    """Length and digest, so that a long message does not grow quadratically."""
    return F.concat(F.length(tail).cast("string"), F.lit(":"), F.md5(tail))


def match_trace_to_bus(
    messages: DataFrame, events: DataFrame, max_delta_us: int = 1_000_000, chunk_us: int | None = None, by: Sequence[str] = ("session_id",)
) -> DataFrame:
    """The best bus event of its capture for each trace message: equal payload, then equal service, then nearest in time.

    Both sides carry the capture key ``by`` (a trace is recorded with one capture). The chunk of the joins follows the
    tolerance unless given.

    Instead of comparing all pairs in the band, each rank is a nearest-in-time join on its own equality key: the
    payload tails of the message, its service, or its direction alone. Ties go to the earlier event. ``events``
    must already be redacted, so sensitive payloads can only match by service or time.
    """
    if "payload_redacted" not in events.columns:
        events = events.withColumn("payload_redacted", F.lit(False))
    asks = F.col("direction").isin("applicationToProvider", "applicationToProviderPeriodic")
    # both sides are read by four joins, so they are written once
    left = cut_lineage(messages.where("direction != 'other'").select(
        *by, "trace_id", "sequence", "ts_us", "call_id", "api", "message_index", "direction", "service_id", "payload_hex", "payload_redacted",
        F.when(asks, "request").otherwise("response").alias("side"),
    ))
    bus = cut_lineage(_bus_side(events, by))
    chunk_us = chunk_us or max(60_000_000, 4 * max_delta_us)
    tasks = tasks_for(left.count() + bus.count())
    ident = [*by, "trace_id", "sequence", "message_index"]

    def best(l: DataFrame, r: DataFrame, by: list[str], rank: int) -> DataFrame:
        hit = nearest_within(l, r, by, max_delta_us, ["bus_event", "sequence_of"], right_dup="earliest", chunk_us=chunk_us, tasks=tasks)
        return hit.select(*ident, F.struct(F.lit(rank).alias("rank"), "delta", F.col("bus_event.timestamp").alias("at"), "sequence_of", "bus_event").alias("hit"))

    bus = bus.withColumn("sequence_of", F.col("sequence"))
    short = left.select(*ident, "ts_us", "side", F.col("service_id").alias("bus_service_id"))
    payloads = bus.where("bus_payload != '' AND bus_payload != '<REDACTED>'").withColumn("tail", _tail_key(F.col("bus_payload")))
    # a candidate "ends with" the bus payload exactly when the bus payload is one of its byte-aligned tails; only
    # tails of lengths that occur on the bus are made (a message has at most 4,095 bytes, so this list is bounded)
    lengths = payloads.select(F.collect_set(F.length("bus_payload"))).scalar()
    sized = left.withColumn("_lengths", lengths)
    tails = F.array_distinct(
        F.flatten(
            F.transform(
                payload_candidates(F.col("payload_hex"), F.col("payload_redacted")),
                lambda c: F.transform(
                    F.filter("_lengths", lambda n: n <= F.length(c)), lambda n: _tail_key(F.substr(c, F.length(c) - n + 1, n))
                ),
            )
        )
    )
    with_tail = sized.select(*ident, "ts_us", "side", F.col("service_id").alias("bus_service_id"), F.explode(tails).alias("tail"))
    served = "bus_service_id IS NOT NULL"
    ranks = [
        best(with_tail.where(served), payloads.where(served), [*by, "side", "tail", "bus_service_id"], 0),
        best(with_tail.drop("bus_service_id"), payloads, [*by, "side", "tail"], 1),
        best(short.where(served), bus.where(served), [*by, "side", "bus_service_id"], 2),
        best(short.drop("bus_service_id"), bus, [*by, "side"], 3),
    ]
    found = ranks[0]
    for part in ranks[1:]:
        found = found.unionByName(part)
    winner = found.repartition(tasks, *ident).groupBy(*ident).agg(F.min("hit").alias("hit"))
    hit = F.col("hit")
    status = (
        F.when(hit.isNull(), "noBusCandidateInWindow")
        .when(hit["rank"] <= 1, "exactPayloadAndTimeMatch")
        .when(hit["rank"] == 2, "serviceAndTimeCandidate")
        .otherwise("timeOnlyCandidate")
    )
    return left.repartition(tasks, *ident).join(winner, ident, "left").select(
        *by, "trace_id", "sequence", "call_id", "api", "message_index", "direction",
        (F.col("ts_us") / 1e6).alias("trace_ts"), "service_id", status.alias("status"),
        (hit["delta"] / 1000.0).alias("delta_ms"),
        F.when(hit.isNotNull(), ~F.col("payload_redacted") & ~hit["bus_event"]["redacted"]).alias("payload_compared"),
        hit["bus_event"].alias("bus_event"),
    )


def markers_near_events(
    markers: DataFrame, events: DataFrame, window_us: int = 5_000_000, k: int = 12, bin_us: int = CHUNK_US, by: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Up to ``k`` nearest events of its capture per marker; distance is zero inside [start_us, end_us].

    ``markers`` has (marker_id, label, start_us, end_us), ``events`` (ts_us, pos, ...), both with the capture key ``by``. Of the
    events in order of time, the ``k`` before and the ``k`` from a marker's start on are looked up by their places, so
    a marker costs ``k`` rows however many events lie in its window.
    """
    carried = [c for c in events.columns if c not in by]
    told = [c for c in markers.columns if c not in by]
    shape = StructType([*[events.schema[c] for c in by], *[events.schema[c] for c in carried], *[markers.schema[c] for c in told], StructField("delta_us", LongType())])

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        # events without a position come first among those of one time
        place = left["pos"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        ts = left["ts_us"].cast(pa.int64()).to_numpy()
        onwards, back = np.lexsort((place, ts)), np.lexsort((~place, ts))
        times = ts[onwards]
        lo, hi, start, end = (right[c].cast(pa.int64()).to_numpy() for c in ("_lo", "_hi", "start_us", "end_us"))
        found = []

        def look(rows: np.ndarray, zones: list[tuple[np.ndarray, int]]) -> None:
            """The ``k`` nearest of the zones of each marker; zones are apart, in order of time, each with its nearest first."""
            near, wide = [], []
            for at, step in zones:
                first = np.searchsorted(times, at[rows], "left")[:, None]
                spot = first + np.arange(k) if step > 0 else first - 1 - np.arange(k)
                inside = (spot >= 0) & (spot < len(times))
                event = (onwards if step > 0 else back)[np.where(inside, spot, 0)]
                t = ts[event]
                s, e = start[rows][:, None], end[rows][:, None]
                delta = np.where((t >= s) & (t <= e), 0, np.minimum(np.abs(t - s), np.abs(t - e)))
                inside &= (t >= lo[rows][:, None]) & (t < hi[rows][:, None])
                if len(zones) == 4:  # between the ends of a reversed marker an event belongs to the nearer one
                    before_middle = t - e <= s - t
                    inside &= {0: np.True_, 1: before_middle, 2: ~before_middle, 3: np.True_}[len(near)]
                near.append(event)
                wide.append(np.where(inside, delta, np.iinfo(np.int64).max))
            event, delta = np.concatenate(near, axis=1), np.concatenate(wide, axis=1)
            order = np.argsort(delta, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(delta, order, axis=1)
            row, col = np.nonzero(best < np.iinfo(np.int64).max)
            found.append((rows[row], np.take_along_axis(event, order, axis=1)[row, col], best[row, col]))

        if len(left) and len(right):
            forward = start <= end
            for rows, zones in (np.nonzero(forward)[0], [(start, -1), (start, 1)]), (np.nonzero(~forward)[0], [(end, -1), (end, 1), (start, -1), (start, 1)]):
                for i in range(0, len(rows), SLICE):
                    look(rows[i : i + SLICE], zones)
        marker, event, delta = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found) if found else ((), (), ())))
        of = {c: (left[c] if len(left) else right[c]).take(event) for c in by} | {c: left[c].take(event) for c in carried} | {c: right[c].take(marker) for c in told}
        return pa.table([*of.values(), pa.array(delta, pa.int64())], names=shape.names)

    known = markers.where(F.col("start_us").isNotNull() & F.col("end_us").isNotNull())
    near = per_window(events, known, by, [], F.col("start_us") - window_us, F.col("end_us") + window_us + 1, fold, shape, chunk_us=bin_us, parts=1, arrow=True)
    order = Window.partitionBy(*by, "marker_id").orderBy("delta_us", "ts_us", "pos")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("delta_ms", F.col("delta_us") / 1000.0).drop("delta_us")


def union_markers(*parts: DataFrame) -> DataFrame:
    """Operator and voice markers in one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


__all__ = [
    "explode_trace_messages", "markers_near_events", "match_trace_to_bus", "pair_calls", "payload_candidates",
    "trace_summary", "union_markers", "validate_trace",
]
