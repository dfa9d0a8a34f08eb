"""Diagnostic events: classification, addressing, merging, traffic, transactions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import byte_at, byte_hex
from framelake.functions.services import (
    PROGRAMMING_SERVICES,
    SENSITIVE_SERVICES,
    SERVICES,
    nrc_name,
    positive_map,
    request_of_positive,
    service_name,
)
from framelake.operators.isotp import SEQUENCE_CHUNK, reassemble_isotp
from framelake.plans.ordered import CHUNK_US, Carry, chunk_of, running
from framelake.plans.timejoin import asof_backward
from framelake.session import cut_lineage

LAYER_STEP = 1 << 61


def classify_diag(messages: DataFrame, transport: str = "isoTp", layer: int = 0) -> DataFrame:
    """Messages (session_id, iface, arb_id, ts_us, completion_seq, payload) to diagnostic events.

    ``pos`` orders events of equal time: layer first, then arrival. Unknown services give no row.
    """
    p = F.col("payload")
    sid, b1, b2 = byte_at(p, 0), byte_at(p, 1), byte_at(p, 2)
    negative = (sid == 0x7F) & (F.length(p) >= 3)
    is_request = sid.isin(list(SERVICES))
    from_positive = request_of_positive(sid)
    service_code = F.when(negative, b1).when(is_request, sid).otherwise(from_positive)
    base = messages.where(F.length(p) > 0).select(
        "session_id",
        "ts_us",
        (F.lit(layer * LAYER_STEP).cast("bigint") + F.col("completion_seq")).alias("pos"),
        F.col("iface").alias("channel"),
        F.col("arb_id").alias("can_id"),
        F.when(negative, "negativeResponse").when(is_request, "request").when(from_positive.isNotNull(), "positiveResponse").alias("direction"),
        service_code.alias("service_code"),
        F.when(~negative, sid).alias("wire_code"),
        F.when(negative, b2).alias("nrc"),
        p.alias("raw"),
        F.lit(transport).alias("transport"),
    )
    known = base.where("direction IS NOT NULL")
    name = F.coalesce(service_name(F.col("service_code")), F.concat(F.lit("Service"), byte_hex(F.col("service_code"))))
    return diag_fields(
        known.select(
            "session_id",
            "ts_us",
            "pos",
            "channel",
            "can_id",
            F.hex("raw").alias("payload"),
            "direction",
            name.alias("service"),
            byte_hex(F.col("service_code")).alias("service_id"),
            byte_hex(F.col("wire_code")).alias("wire_service_id"),
            byte_hex(F.col("nrc")).alias("nrc_code"),
            F.when(F.col("nrc").isNotNull(), nrc_name(F.col("nrc"))).alias("nrc_name"),
            "transport",
        )
    )


def diag_fields(events: DataFrame) -> DataFrame:
    """Service-specific fields as nullable columns; negative responses carry none."""
    text = F.substr("payload", F.lit(3))
    n = F.length(text) / F.lit(2)
    sid = F.when(F.col("direction") != "negativeResponse", F.col("service_id"))

    def byte(i: int) -> Column:
        return F.concat(F.lit("0x"), F.substr(text, F.lit(2 * i + 1), F.lit(2)))

    def word(i: int) -> Column:
        return F.concat(F.lit("0x"), F.substr(text, F.lit(2 * i + 1), F.lit(4)))

    def rest(i: int) -> Column:
        return F.substr(text, F.lit(2 * i + 1))

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    access = F.conv(F.substr(text, F.lit(1), F.lit(2)), 16, 10).cast("int")
    positive = F.col("direction") == "positiveResponse"
    download = sid.isin("0x34", "0x35")
    return events.select(
        "*",
        only(sid.isin("0x10", "0x11", "0x3E", "0x85") & (n >= 1), byte(0)).alias("sub_function"),
        only(sid.isin("0x22", "0x2E") & (n >= 2), word(0)).alias("did"),
        F.when((sid == "0x22") & (n >= 2) & positive, rest(2)).when((sid == "0x2E") & (n > 2), rest(2)).alias("did_data"),
        only((sid == "0x22") & (n > 2) & ~positive, rest(2)).alias("additional_request_bytes"),
        only((sid == "0x27") & (n >= 1), byte(0)).alias("security_access_type"),
        only((sid == "0x27") & (n >= 1), F.when(access % 2 == 1, "requestSeed").otherwise("sendKey")).alias("security_operation"),
        only((sid == "0x27") & (n > 1), rest(1)).alias("security_data"),
        only((sid == "0x2C") & (n >= 1), byte(0)).alias("dynamic_id"),
        only((sid == "0x2C") & (n > 1), rest(1)).alias("definition"),
        only((sid == "0x31") & (n >= 1), byte(0)).alias("routine_type"),
        only((sid == "0x31") & (n >= 3), word(1)).alias("routine_id"),
        only((sid == "0x31") & (n > 3), rest(3)).alias("routine_data"),
        only(download & (n >= 1), byte(0)).alias("format_or_length"),
        only(download & (n > 1), rest(1)).alias("transfer_parameters"),
        only((sid == "0x36") & (n >= 1), access).alias("block_counter"),
        only((sid == "0x36") & (n > 1), (n - 1).cast("int")).alias("transfer_bytes"),
        only((sid == "0x36") & (n > 1), rest(1)).alias("transfer_data"),
        only((sid == "0x37") & (n >= 1), rest(0)).alias("transfer_exit_data"),
        only((sid == "0xAA") & (n >= 1), byte(0)).alias("control_byte"),
        only((sid == "0xAA") & (n > 1), rest(1)).alias("packet_arguments"),
        only(sid.isin("0x04", "0x09", "0x12", "0x18", "0x28", "0xA9") & (n >= 1), rest(0)).alias("parameters"),
    )


def distinct_roles(refs: DataFrame) -> DataFrame:
    """Address candidates without repeats: (catalog_id, confidence, module, role, can_id)."""
    return refs.select("catalog_id", "confidence", "module", "role", "can_id").dropDuplicates()


def _addresses(refs: DataFrame) -> DataFrame:
    """All candidates of each id as one array; the array is bounded by the catalog's modules."""
    return distinct_roles(refs).groupBy("can_id").agg(
        F.array_sort(F.collect_list(F.struct("module", "role", "confidence", "catalog_id"))).alias("address_matches")
    )


def annotate_addresses(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Attach address candidates; a single candidate also names the likely module, role and its evidence."""
    one = F.when(F.size("address_matches") == 1, F.col("address_matches")[0])
    return events.join(_addresses(refs), "can_id", "left").select(
        *events.columns,
        "address_matches",
        one["module"].alias("likely_module"),
        one["role"].alias("address_role"),
        one["confidence"].alias("address_evidence"),
    )


def legacy_events(frames: DataFrame, refs: DataFrame, iso_events: DataFrame) -> DataFrame:
    """Unframed diagnostic records on known endpoint ids that are not already ISO-TP events."""
    roles = distinct_roles(refs).groupBy("can_id").agg(F.collect_set("role").alias("roles"))
    sid = byte_at(F.col("data"), 0)
    known = [*SERVICES, *positive_map(), 0x7F]
    candidates = frames.where((F.length("data") > 0) & sid.isin(known)).join(
        roles, F.col("arb_id") == F.col("can_id")
    )
    origins = iso_events.select(
        "session_id", "ts_us", F.col("channel").alias("iface"), F.col("can_id").alias("arb_id")
    )
    fresh = candidates.drop("can_id").join(origins, ["session_id", "ts_us", "iface", "arb_id"], "left_anti")
    messages = fresh.select("session_id", "iface", "arb_id", "ts_us", F.col("sequence").alias("completion_seq"), F.col("data").alias("payload"))
    events = classify_diag(messages, "legacyUnframedReference", layer=1)
    asks = F.arrays_overlap("roles", F.array(F.lit("request"), F.lit("functionalRequest")))
    answers = F.array_contains("roles", "normalResponse")
    fits = F.when(F.col("direction") == "request", asks).otherwise(answers)
    return events.join(roles, "can_id").where(fits).select(*events.columns)


def merge_events(*parts: DataFrame) -> DataFrame:
    """Union of event tables; of equal (time, channel, id, payload, direction) the first in ``pos`` order stays."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    same = Window.partitionBy("session_id", "ts_us", "channel", "can_id", "payload", "direction").orderBy("pos")
    return merged.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def event_timeline(events: DataFrame) -> DataFrame:
    """Events in their total order: time, layer, arrival."""
    return events.orderBy("session_id", "ts_us", "pos")


def endpoint_traffic(frames: DataFrame, refs: DataFrame) -> DataFrame:
    """Frames per channel, id and address candidate; first and last time in file order.

    Frames are reduced to one row per (session, channel, id) before the address catalog is joined.
    """
    per_id = frames.groupBy("session_id", F.col("iface").alias("channel"), F.col("arb_id").alias("can_id")).agg(
        F.count("*").alias("n"),
        F.min_by("ts_us", "sequence").alias("first"),
        F.max_by("ts_us", "sequence").alias("last"),
        F.min("sequence").alias("lo"),
        F.max("sequence").alias("hi"),
    )
    hits = per_id.join(refs.select("can_id", "module", "role", "confidence", "catalog_id").dropDuplicates(), "can_id")
    # two catalogs may give the same (module, role, confidence): both count, as each is a match
    return hits.groupBy("session_id", "channel", "can_id", "module", "role", "confidence").agg(
        F.sum("n").alias("frame_count"),
        (F.min_by("first", "lo") / 1e6).alias("first_ts"),
        (F.max_by("last", "hi") / 1e6).alias("last_ts"),
    )


def pair_transactions(events: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Requests with their responses, through responsePending up to a terminal response.

    ``events`` are annotated. Only a request with exactly one ``request`` module starts a transaction; any request
    of the same (channel, module, service) ends the previous one. Unanswered requests stay.
    """
    asked = F.array_distinct(F.transform(F.filter("address_matches", lambda m: m["role"] == "request"), lambda m: m["module"]))
    answered = F.array_distinct(F.transform(F.filter("address_matches", lambda m: m["role"] == "normalResponse"), lambda m: m["module"]))
    is_request = F.col("direction") == "request"
    rows = (
        events.where("address_matches IS NOT NULL")
        .select(
            "session_id", "ts_us", "pos", "channel", "can_id", "direction", "service", "service_id", "transport", "nrc_code", "nrc_name",
            "address_matches",
            F.when(is_request, asked).otherwise(answered).alias("modules"),
            is_request.alias("is_request"),
        )
        .withColumn("starts", F.col("is_request") & (F.size("modules") == 1))
        .select("*", F.explode("modules").alias("module"))
        .withColumn(
            "evidence",
            F.get(F.filter("address_matches", lambda m: (m["role"] == "request") & (m["module"] == F.col("module"))), F.lit(0))["confidence"],
        )
        .drop("modules", "address_matches")
        .withColumn("chunk", chunk_of("ts_us", chunk_us))
    )
    key = ["session_id", "channel", "module", "service"]
    asks = F.col("is_request")
    terminal = ~asks & ~F.coalesce(F.col("nrc_name") == "responsePending", F.lit(False))
    head = F.struct("ts_us", "pos", "starts", "service_id", "transport", "evidence", "can_id")
    # one pass: every row learns the request it follows and whether that request is still open
    turns = running(
        rows, key, ["ts_us", "pos"],
        {
            "head": Carry("last", F.when(asks, head)),
            "open": Carry("last", F.when(asks, True).when(terminal, False), inclusive=False),
        },
        ["chunk"],
    ).where("head.starts AND (is_request OR open)")
    reply = F.struct("ts_us", "pos", "can_id", "direction", "nrc_code", "nrc_name")
    grouped = turns.groupBy(*key, "head").agg(F.array_sort(F.collect_list(F.when(~asks, reply))).alias("list"))
    latency = lambda r: (r["ts_us"] - F.col("head.ts_us")) / 1000.0
    responses = F.transform(
        "list",
        lambda r: F.struct(
            (r["ts_us"] / 1e6).alias("timestamp"), r["can_id"].alias("can_id"), r["direction"].alias("direction"),
            latency(r).alias("latency_ms"), r["nrc_code"].alias("nrc_code"), r["nrc_name"].alias("nrc_name"),
        ),
    )
    first, last = F.try_element_at("list", F.lit(1)), F.try_element_at("list", F.lit(-1))
    return grouped.select(
        *key,
        "head.service_id",
        "head.transport",
        F.col("head.evidence").alias("address_evidence"),
        (F.col("head.ts_us") / 1e6).alias("request_ts"),
        F.col("head.can_id").alias("request_can_id"),
        F.size("list").alias("response_count"),
        responses.alias("responses"),
        latency(first).alias("initial_latency_ms"),
        latency(last).alias("final_latency_ms"),
        last["direction"].alias("final_direction"),
        (F.size("list") == 0).alias("unanswered"),
    )


def diag_summary(events: DataFrame, traffic: DataFrame | None = None, transactions: DataFrame | None = None) -> DataFrame:
    """Counts as rows (section, name, value)."""

    def counts(df: DataFrame, section: str, name: Column) -> DataFrame:
        return df.groupBy(name.cast("string").alias("name")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "name", "value")

    def total(df: DataFrame, section: str) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), F.lit("all").alias("name"), "value")

    out = [
        total(events, "events"),
        counts(events, "services", F.col("service")),
        counts(events.where("direction = 'request'"), "requests", F.col("service")),
        counts(events.where("direction = 'negativeResponse'"), "negative_responses", F.coalesce("nrc_name", F.lit("unknown"))),
        counts(events.where(F.col("service").isin(PROGRAMMING_SERVICES)), "programming_services", F.col("service")),
    ]
    if traffic is not None:
        out.append(counts(traffic, "modules_observed", F.col("module")))
        out.append(counts(traffic, "traffic_by_role", F.col("role")))
    if transactions is not None:
        out.append(total(transactions, "transactions"))
        out.append(total(transactions.where("NOT unanswered"), "answered_transactions"))
        out.append(total(transactions.where("unanswered"), "unanswered_transactions"))
    merged = out[0]
    for part in out[1:]:
        merged = merged.unionByName(part)
    return merged


def redact(events: DataFrame, services: list[str] | None = None) -> DataFrame:
    """Replace payloads of sensitive services by their SHA-256 and length; the frames stay untouched."""
    hit = F.col("service").isin(services or SENSITIVE_SERVICES) & (F.length("payload") > 0)
    raw = F.unhex("payload")
    mark = F.lit("<redacted>")
    out = events.select(
        *[c for c in events.columns if c not in ("payload", "security_data", "transfer_data")],
        F.when(hit, mark).otherwise(F.col("payload")).alias("payload"),
        F.when(hit, F.sha2(raw, 256)).alias("payload_sha256"),
        F.when(hit, F.length(raw)).alias("payload_length"),
        hit.alias("payload_redacted"),
        *[
            F.when(hit & F.col(c).isNotNull(), mark).otherwise(F.col(c)).alias(c)
            for c in ("security_data", "transfer_data")
            if c in events.columns
        ],
    )
    return out


def dynamic_definitions(messages: DataFrame, tx: int = 0x7E4) -> DataFrame:
    """Packet definitions: service 0x2C, packet id, then identifiers of two bytes each."""
    p = F.col("payload")
    n = F.length(p)
    return messages.where((F.col("arb_id") == tx) & (n >= 4) & (n % 2 == 0) & (byte_at(p, 0) == 0x2C)).select(
        "session_id",
        "ts_us",
        F.col("completion_seq").alias("sequence"),
        F.col("iface").alias("channel"),
        byte_at(p, 1).alias("packet_id"),
        F.transform(
            F.sequence(F.lit(1), (n / 2 - 1).cast("int")), lambda i: F.concat(F.lit("0x"), F.hex(F.substr(p, i * 2 + 1, F.lit(2))))
        ).alias("dids"),
        F.hex(p).alias("request_payload"),
    )


def asof_definition(
    frames: DataFrame, messages: DataFrame, tx: int = 0x7E4, dynamic_rx: int = 0x5EC, chunk_us: int = CHUNK_US
) -> DataFrame:
    """Definitions, packet controls and samples in one table; a sample carries the latest definition before it."""
    defs = dynamic_definitions(messages, tx)
    d = F.col("data")
    raw = frames.where((F.col("arb_id") == dynamic_rx) & (F.length("data") > 0)).select(
        "session_id", "ts_us", "sequence", F.col("iface").alias("channel"), byte_at(d, 0).alias("packet_id"),
        F.hex(F.substr(d, F.lit(2))).alias("data"),
    )
    samples = asof_backward(raw, defs, ["session_id", "channel", "packet_id"], ["dids"], chunk_us=chunk_us)
    p = F.col("payload")
    controls = messages.where((F.col("arb_id") == tx) & (F.length(p) >= 3) & (byte_at(p, 0) == 0xAA)).select(
        "session_id", "ts_us", F.col("completion_seq").alias("sequence"), F.col("iface").alias("channel"),
        byte_at(p, 2).alias("packet_id"), byte_at(p, 1).alias("rate"),
        F.when(byte_at(p, 1) == 0, "stop").when(byte_at(p, 1) == 1, "single").otherwise("periodic").alias("state"),
        F.hex(p).alias("request_payload"),
    )
    parts = [
        defs.withColumn("kind", F.lit("dynamicDefinition")).withColumn("layer", F.lit(0)),
        controls.withColumn("kind", F.lit("dynamicPacketControl")).withColumn("layer", F.lit(1)),
        samples.select(
            "*",
            F.when(F.size("dids") == 1, F.col("dids")[0]).alias("single_did"),
            F.when(F.size("dids") == 1, F.col("data")).alias("single_did_data"),
            F.lit("dynamicPacketSample").alias("kind"),
            F.lit(2).alias("layer"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def session_events(frames: DataFrame, refs: DataFrame, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Frames to merged, annotated diagnostic events."""
    iso = classify_diag(reassemble_isotp(frames, check_seq=True, chunk=chunk))
    return annotate_addresses(merge_events(iso, legacy_events(frames, refs, iso)), refs)


def session_extract(frames: DataFrame, refs: DataFrame) -> dict[str, DataFrame]:
    """Events, traffic, transactions and summary of captures; the events are written once and read by all of them."""
    events = cut_lineage(session_events(frames, refs))
    traffic = endpoint_traffic(frames, refs)
    transactions = pair_transactions(events)
    return {
        "events": events, "traffic": traffic, "transactions": transactions,
        "summary": diag_summary(events, traffic, transactions),
    }


__all__ = [
    "annotate_addresses", "asof_definition", "classify_diag", "diag_fields", "diag_summary",
    "distinct_roles", "dynamic_definitions", "endpoint_traffic", "event_timeline", "legacy_events", "merge_events",
    "pair_transactions", "redact", "session_events",
]
