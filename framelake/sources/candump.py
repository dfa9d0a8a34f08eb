"""Capture logs: frames, operator markers and malformed lines.

A line is read by position: blanks part it into time, interface and frame, the first ``#`` parts the frame into id and
body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import epoch_text_us
from framelake.sources.lines import read_lines

HEX = "0123456789abcdefABCDEF"


def only(text: Column, letters: str) -> Column:
    """Whether ``text`` has no letter besides ``letters``."""
    return F.translate(text, letters, "") == ""


def bracketed_time(token: Column) -> Column:
    """Microseconds of ``(seconds.fraction)``; null for anything else."""
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    parts = F.split(inner, "[.]", -1)
    digits = F.forall(parts, lambda p: (p != "") & only(p, "0123456789"))
    ok = token.startswith("(") & token.endswith(")") & digits & (F.size(parts) <= 2)
    return F.when(F.coalesce(ok, F.lit(False)), epoch_text_us(inner))


def frame_columns(text: Column, extended: bool = False) -> dict[str, Column]:
    """Frame fields of one line; every field is null when the line is not a frame.

    With ``extended`` remote frames (body ``R...``) and FD frames (body ``#``, a flag digit, then the data) count too.
    """
    tokens = F.split(text, r"\s+", -1)
    token = lambda i: F.get(tokens, F.lit(i))
    ts, frame = bracketed_time(token(0)), token(2)
    cut = F.locate("#", frame)
    ident, body = F.substr(frame, F.lit(1), cut - 1), F.substr(frame, cut + 1)
    remote = F.lit(False) if not extended else body.startswith("R")
    fd = F.lit(False) if not extended else body.startswith("#")
    rest = F.substr(body, F.lit(2))
    ok = ts.isNotNull() & (F.size(tokens) == 3) & (token(1) != "") & (cut > 1) & F.length(ident).between(1, 8) & only(ident, HEX)
    ok = ok & F.when(remote, only(rest, HEX)).when(fd, (rest != "") & only(rest, HEX)).otherwise(only(body, HEX))
    ok = F.coalesce(ok, F.lit(False))
    payload = F.when(remote, "").when(fd, F.substr(rest, F.lit(2))).otherwise(body)
    fields = {
        "ts_us": ts,
        "iface": token(1),
        "arb_id": F.conv(ident, 16, 10).cast("bigint"),
        "is_extended": F.length(ident) > 3,
        "remote": remote,
        "data": F.when(F.length(payload) % 2 == 0, F.unhex(payload)),
    }
    return {name: F.when(ok, c) for name, c in fields.items()}


def frames_from_lines(lines: DataFrame, mode: str = "strict", session: Column | None = None) -> DataFrame:
    """Frames of (line_no, value) lines.

    strict: a line that is no frame, has odd hex or more than 8 bytes stops the load. lenient: such lines are left
    out. voice: blank and ``#`` lines are left out, anything else must be a frame. extended: lenient, plus remote
    frames and FD frames (flag nibble dropped).
    """
    text = F.trim("value")
    parsed = lines.select(
        (session if session is not None else F.col("session_id")).alias("session_id"),
        F.col("line_no").alias("sequence"),
        text.alias("_text"),
        *[c.alias(n) for n, c in frame_columns(text, mode == "extended").items()],
    )
    good = F.col("ts_us").isNotNull() & F.col("data").isNotNull()
    if mode in ("strict", "voice"):
        if mode == "voice":
            parsed = parsed.where("_text != '' AND NOT startswith(_text, '#')")
        else:
            good = good & (F.length("data") <= 8)
        fail = F.raise_error(F.concat(F.lit("Malformed capture line "), F.col("sequence").cast("string"), F.lit(": "), F.substr("_text", F.lit(1), F.lit(160))))
        # the check sits on the payload, so the scan cannot prune it away
        parsed = parsed.withColumn("data", F.when(good, F.col("data")).otherwise(fail.cast("binary")))
    else:
        parsed = parsed.where(good)
    return parsed.select(
        "session_id", "sequence", "ts_us", "iface", "arb_id", "is_extended", "remote", F.length("data").alias("dlc"), "data"
    )


def read_candump(spark: SparkSession, path: str | list[str], session_id: str | None = None, mode: str = "strict") -> DataFrame:
    """Capture logs to frames; without ``session_id`` each file is its own session, named by its whole path."""
    session = F.lit(session_id) if session_id else F.col("path")
    return frames_from_lines(read_lines(spark, path), mode, session)


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines a strict load would refuse, with the reason."""
    text = F.trim("value")
    cols = frame_columns(text)
    reason = (
        F.when(cols["ts_us"].isNull(), "malformed")
        .when(cols["data"].isNull(), "oddLengthData")
        .when(F.length(cols["data"]) > 8, "payloadTooLong")
    )
    return read_lines(spark, path).select("path", "line_no", reason.alias("reason"), text.alias("text")).where("reason IS NOT NULL")


def markers_from_lines(lines: DataFrame, keyword: str) -> DataFrame:
    """Markers: comment lines ``# keyword (time) utc source=name label=text``; path and session come along where there are any."""
    text = F.trim("value")
    start = f"# {keyword} "
    tokens = F.split(F.substr(text, F.lit(len(start) + 1)), r"\s+", 4)
    part = lambda i: F.get(tokens, F.lit(i))
    ts = bracketed_time(part(0))
    source = F.substr(part(2), F.lit(len("source=") + 1))
    ok = text.startswith(start) & ts.isNotNull() & part(2).startswith("source=") & (source != "") & part(3).startswith("label=")
    kept = [c for c in ("path", "session_id") if c in lines.columns]
    return lines.where(F.coalesce(ok, F.lit(False))).select(
        *kept, F.col("line_no").alias("sequence"), ts.alias("ts_us"), part(1).alias("utc"),
        source.alias("source"), F.substr(part(3), F.lit(len("label=") + 1)).alias("label"), F.lit("operatorMarker").alias("evidence_class"),
    )


def read_markers(spark: SparkSession, path: str | list[str], keyword: str) -> DataFrame:
    """Operator markers written between the frames of a capture, with the path of their file."""
    return markers_from_lines(read_lines(spark, path), keyword)
