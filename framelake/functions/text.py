"""Text expressions: times, speeds, escapes, numbers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(iso: Column) -> Column:
    """ISO-8601 time (``Z`` or offset) to microseconds since 1970."""
    return F.unix_micros(F.to_timestamp(iso))


def epoch_text_us(seconds: Column) -> Column:
    """Decimal seconds as text to microseconds, without passing through a double."""
    return F.round(seconds.cast("decimal(28,9)") * 1_000_000).cast("bigint")


def iso_utc(ts_us: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` by arithmetic, so that the session time zone plays no part."""
    day_us = 86_400_000_000
    days = F.floor(ts_us / F.lit(day_us)).cast("int")
    rest = ts_us - days.cast("bigint") * day_us
    unit = lambda us, modulo: F.lpad((F.floor(rest / F.lit(us)).cast("bigint") % modulo).cast("string"), 2, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.concat(
        date, F.lit("T"), unit(3_600_000_000, 24), F.lit(":"), unit(60_000_000, 60), F.lit(":"), unit(1_000_000, 60), F.lit("."),
        F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )


def vtg_speed(sentence: Column) -> Column:
    """km/h of an NMEA VTG sentence: the field before the first ``K``; null for other or broken sentences."""
    fields = F.split(F.regexp_replace(sentence, r"^\$+", ""), ",")
    at = F.array_position(fields, "K")
    value = F.try_element_at(fields, (at - 1).cast("int"))
    number = F.when(F.trim(value).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(value))
    return F.when(F.element_at(fields, 1).endswith("VTG") & (at > 1), number.cast("double"))


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def unescape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def number_text(value: Column) -> Column:
    """Integers without a point, other values with up to 15 significant digits."""
    # 15 significant digits: scientific text, re-read as a decimal, without trailing zeros
    digits = F.format_string("%.14e", value)
    plain = F.regexp_replace(F.regexp_replace(digits.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_extract(digits, r"^(-?[0-9]\.[0-9]*?)0*e", 1), r"\.$", "")
    exponent = F.regexp_extract(digits, r"e([+-][0-9]+)$", 1)
    magnitude = F.abs(value)
    return (
        F.when((value == F.floor(value)) & (magnitude < 1e18), value.cast("bigint").cast("string"))
        .when((magnitude >= 1e-4) & (magnitude < 1e15), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), exponent))
    )


def dbc_id(raw: Column) -> Column:
    """Raw definition id to (arbitration_id, is_extended); null when the id is out of range.

    Bit 31 marks an extended id; an unflagged id above 0x7FF is extended as well.
    """
    flagged = raw >= 0x80000000
    arb = F.when(flagged, raw.bitwiseAND(0x1FFFFFFF)).otherwise(raw)
    valid = (raw >= 0) & (raw <= 0xFFFFFFFF) & (flagged | (raw <= 0x1FFFFFFF))
    return F.when(valid, F.struct(arb.alias("arbitration_id"), (flagged | (raw > 0x7FF)).alias("is_extended")))


def raw_dbc_id(arb: Column, extended: Column) -> Column:
    """(arbitration_id, is_extended) to the raw id; null when out of range."""
    limit = F.when(extended, 0x1FFFFFFF).otherwise(0x7FF)
    flag = F.when(extended, F.lit(0x80000000)).otherwise(F.lit(0)).cast("bigint")
    return F.when((arb >= 0) & (arb <= limit), arb.cast("bigint").bitwiseOR(flag))


def payload_hex(text: Column) -> Column:
    """Hex payload text with blanks or a 0x prefix, upper-case and compact."""
    compact = F.regexp_replace(text, r"\s+", "")
    return F.upper(F.regexp_replace(compact, "^0[xX]", ""))


def provider_fingerprint(provider: Column) -> Column:
    """SHA-256 of the provider identity as compact JSON with sorted keys; missing fields are null."""
    names = ["functionLibrary", "name", "registryPath", "registrySubkey", "vendor"]

    def quoted(name: str) -> Column:
        value = F.try_element_at(provider, F.lit(name))
        safe = F.to_json(F.array(value))
        body = F.substr(safe, F.lit(2), F.length(safe) - 2)
        return F.concat(F.lit(f'"{name}":'), F.when(value.isNull(), "null").otherwise(body))

    parts = [quoted(n) for n in names]
    joined = F.concat_ws(",", *parts)
    return F.sha2(F.concat(F.lit("{"), joined, F.lit("}")), 256)


def marker_source(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")


def marker_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
