"""Annotated simulation transcripts and the reference map drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.bits import byte_hex
from framelake.functions.services import code_map
from framelake.plans.ordered import Carry, running
from framelake.sources.lines import read_lines

# Headings that name a module (first match wins), and the transcript's request services.
MODULE_HEADINGS = [
    "Inflatable Restraint Sensing and Diagnostic Module",
    "Electronic Power Steering Control Module",
    "Electronic Brake Control Module",
    "Immobilizer Control Module",
    "Keyless Entry Control Module",
    "Instrument Cluster",
    "Fuel Pump Module",
    "Radio",
    "ECM",
    "TCM",
    "BCM",
]
REQUEST_SERVICES = {
    0x04: "ClearDiagnosticInformationLegacy",
    0x09: "RequestVehicleInformation",
    0x10: "DiagnosticSessionControl",
    0x11: "ECUReset",
    0x12: "GMFailureRecord",
    0x18: "ReadDTCInformationLegacy",
    0x22: "ReadDataByIdentifier",
    0x27: "SecurityAccess",
    0x2C: "DynamicallyDefineDataIdentifier",
    0x2E: "WriteDataByIdentifier",
    0x31: "RoutineControl",
    0x32: "GMService32",
    0x33: "GMService33",
    0x34: "RequestDownload",
    0x35: "RequestUpload",
    0x36: "TransferData",
    0x37: "RequestTransferExit",
    0x3E: "TesterPresent",
    0xA0: "GMLegacyServiceA0",
    0xA1: "GMLegacyServiceA1",
    0xA9: "GMReadDTCInformation",
    0xAA: "GMDynamicDataPacketControl",
}
FUNCTIONAL_ID = 0x7DF
NUMBER = r"^(?i)(0x[0-9a-f]{1,15}|[+-]?[0-9]{1,18}),*$"


def _number(token: Column) -> Column:
    clean = F.regexp_replace(token, ",+$", "")
    is_hex = F.lower(clean).startswith("0x")
    value = F.when(is_hex, F.conv(F.substr(clean, F.lit(3)), 16, 10)).otherwise(clean)
    return F.when(token.rlike(NUMBER), value.cast("bigint"))


def _module(heading: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(MODULE_HEADINGS):
        out = F.when(heading.rlike(rf"(?i)\b{name}\b"), F.lit(name)).otherwise(out)
    return F.when(~F.lower(heading).startswith("original"), out)


def transcript_rows(lines: DataFrame) -> DataFrame:
    """Data rows of (path, block, line_no, value) lines with the last heading and module above them."""
    text = F.trim("value")
    heading = F.trim(F.substr(text, F.lit(2)))
    is_heading = (
        text.startswith(";") & (heading != "") & ~heading.rlike(r"(?i)^(?:original\s*-\s*)?\d+\s")
    )
    marked = lines.select(
        "path", "block", "line_no", text.alias("text"),
        F.when(is_heading, heading).alias("h"), F.when(is_heading, _module(heading)).alias("m"),
    )
    carried = running(
        marked, ["path"], ["line_no"],
        {"section": Carry("last", F.col("h")), "module": Carry("last", F.col("m"))}, ["block"],
    )
    rows = carried.where("text != '' AND NOT startswith(text, ';')").withColumn("tokens", F.split("text", r"\s+"))
    # a row is: ordinal [delay] id bytes...; the second token tells by its 0x whether a delay is present
    direct = F.lower(F.element_at("tokens", 2)).startswith("0x")
    first = F.when(direct, 2).otherwise(3)
    shaped = rows.where(F.size("tokens") >= 3).select(
        "path", "line_no", "section", "module",
        _number(F.element_at("tokens", 1)).alias("ordinal"),
        F.when(~direct, _number(F.element_at("tokens", 2))).alias("delay_ms"),
        direct.alias("direct"),
        _number(F.try_element_at("tokens", first)).alias("can_id"),
        F.transform(F.slice("tokens", first + 1, F.greatest(F.size("tokens") - first, F.lit(0))), _number).alias("cells"),
    )
    ok = (
        F.col("ordinal").isNotNull() & F.col("can_id").isNotNull() & (F.col("direct") | F.col("delay_ms").isNotNull())
        & F.forall("cells", lambda c: c.isNotNull())
    )
    return shaped.where(ok).select(
        "path", "line_no", "section", "module", "ordinal", "delay_ms", "can_id",
        F.transform("cells", lambda c: c.bitwiseAND(255).cast("int")).alias("data"),
    )


def read_sim_transcript(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return transcript_rows(read_lines(spark, path))


def _classified(rows: DataFrame) -> DataFrame:
    sid = F.try_element_at("data", F.lit(1))
    second = F.try_element_at("data", F.lit(2))
    positive = {(s + 0x40) & 0xFF: s for s in REQUEST_SERVICES}
    is_request = sid.isin(list(REQUEST_SERVICES))
    is_negative = ~is_request & (sid == 0x7F)
    is_positive = ~is_request & ~is_negative & sid.isin(list(positive))
    service = F.when(is_request, sid).when(is_negative, second).when(is_positive, F.try_element_at(code_map(positive), sid))
    direction = (
        F.when(F.size("data") == 0, "empty").when(is_request, "request").when(is_negative, "negativeResponse")
        .when(is_positive, "positiveResponse").otherwise("data")
    )
    return rows.select(
        "*", direction.alias("direction"), service.alias("service"),
        F.coalesce(F.try_element_at(code_map(REQUEST_SERVICES), service), F.lit("unknown")).alias("service_name"),
    )


def sim_reference_map(rows: DataFrame) -> DataFrame:
    """Per module: request, response, data and functional ids, services and sections.

    Every set is bounded by the id space, the service space or the number of distinct headings.
    """
    c = _classified(rows).where("module IS NOT NULL")
    d, cid = F.col("direction"), F.col("can_id")
    answered = d.isin("positiveResponse", "negativeResponse")
    plain = ~answered & (d != "request")
    sets = lambda cond: F.array_sort(F.collect_set(F.when(cond, cid)))
    # equal rows collapse map-side before the sets are built
    small = c.select("module", "direction", "can_id", "service", "section").distinct()
    return small.groupBy("module").agg(
        sets((d == "request") & (cid != FUNCTIONAL_ID)).alias("request_can_ids"),
        sets(answered | (plain & cid.between(0x600, 0x7FF))).alias("normal_response_can_ids"),
        sets(plain & cid.between(0x500, 0x5FF)).alias("data_can_ids"),
        sets((d == "request") & (cid == FUNCTIONAL_ID)).alias("functional_request_can_ids"),
        F.array_sort(F.collect_set(byte_hex(F.col("service")))).alias("services"),
        F.array_sort(F.collect_set("section")).alias("sections"),
        F.lit("legacyReference").alias("confidence"),
    )


def sim_service_histogram(rows: DataFrame) -> DataFrame:
    """Rows per service over all rows, with module or without."""
    c = _classified(rows).where("service IS NOT NULL")
    return c.groupBy(F.concat(byte_hex(F.col("service")), F.lit(" "), F.col("service_name")).alias("service")).agg(F.count("*").alias("rows"))


def uncategorized_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("module").isNull(), 1).otherwise(0)).alias("uncategorized"))
