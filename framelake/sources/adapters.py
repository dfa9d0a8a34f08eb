"""Recorded adapter logs: SLCAN, compact monitor lines and spaced monitor lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import epoch_text_us
from framelake.sources.lines import read_lines

# Adapter chatter.
CHATTER = ["SEARCHING", "STOPPED", "BUFFER FULL", "NO DATA"]


def _slcan(line: Column) -> dict[str, Column]:
    kind = F.substr(line, F.lit(1), F.lit(1))
    extended = kind.isin("T", "R")
    remote = kind.isin("r", "R")
    width = F.when(extended, 8).otherwise(3)
    id_text = F.substr(line, F.lit(2), width)
    dlc_text = F.substr(line, width + 2, F.lit(1))
    payload_text = F.substr(line, width + 3)
    dlc = F.when(dlc_text.rlike("^[0-8]$"), dlc_text.cast("int"))
    payload = F.when(remote, "").otherwise(F.substr(payload_text, F.lit(1), dlc * 2))
    ok = (
        kind.isin("t", "T", "r", "R")
        & id_text.rlike("^[0-9A-Fa-f]+$")
        & (F.length(id_text) == width)
        & dlc.isNotNull()
        & payload.rlike("^[0-9A-Fa-f]*$")
        & (remote | (F.length(payload) == dlc * 2))
    )
    return {"ok": ok, "id": id_text, "extended": extended, "remote": remote, "payload": payload}


def _drops(line: Column, drop_st: bool) -> Column:
    out = (line == "") | (line == "OK") | line.startswith("AT")
    if drop_st:
        out = out | line.startswith("ST")
    for word in CHATTER:
        out = out | line.contains(word)
    return out


def _monitor(line: Column, drop_st: bool, split_id: bool) -> dict[str, Column]:
    text = F.upper(F.trim(line))
    compact = text.rlike("^[0-9A-F]+$")
    odd = F.length(text) % 2 == 1
    width = F.when(odd, 3).otherwise(8)
    c_id, c_data = F.substr(text, F.lit(1), width), F.substr(text, width + 1)
    c_ok = (F.length(text) >= width) & (F.length(c_data) <= 16)
    tokens = F.split(text, r"\s+")
    head = F.element_at(tokens, 1)
    whole = F.length(head).isin(3, 8)
    quad = F.lit(False)
    if split_id:
        quad = ~whole & (F.size(tokens) >= 4) & F.forall(F.slice(tokens, 1, 4), lambda t: F.length(t) == 2)
    s_id = F.when(whole, head).when(quad, F.array_join(F.slice(tokens, 1, 4), ""))
    cursor = F.when(whole, 1).otherwise(4)
    dlc_text = F.try_element_at(tokens, cursor + 1)
    dlc = F.when(dlc_text.rlike("^0*[0-8]$"), F.conv(dlc_text, 16, 10).cast("int"))
    cells = F.when(dlc.isNotNull() & (F.size(tokens) - cursor - 1 >= dlc), F.slice(tokens, cursor + 2, dlc))
    s_ok = s_id.rlike("^[0-9A-F]+$") & F.forall(cells, lambda t: t.rlike("^[0-9A-F]{2}$"))
    ok = ~_drops(text, drop_st) & F.when(compact, c_ok).otherwise(F.coalesce(s_ok, F.lit(False)))
    id_text = F.when(compact, c_id).otherwise(s_id)
    return {
        "ok": ok,
        "id": id_text,
        "extended": F.length(id_text) == 8,
        "remote": F.lit(False),
        "payload": F.when(compact, c_data).otherwise(F.array_join(cells, "")),
    }


def dialect_columns(line: Column, dialect: str) -> dict[str, Column]:
    """slcan; stm (compact or spaced, id may be four byte tokens); vlinker (as stm, whole ids, ``ST`` lines dropped)."""
    if dialect == "slcan":
        return _slcan(line)
    return _monitor(line, drop_st=dialect == "vlinker", split_id=dialect == "stm")


def adapter_frames(lines: DataFrame, dialect: str, text: Column, ts_us: Column, session: Column, iface: Column) -> DataFrame:
    """Frames of lines with (line_no, ...); lines that are no frames are left out."""
    c = dialect_columns(text, dialect)
    parsed = lines.where(c["ok"]).select(
        session.alias("session_id"), F.col("line_no").alias("sequence"), ts_us.alias("ts_us"), iface.alias("iface"),
        F.conv(c["id"], 16, 10).cast("bigint").alias("arb_id"), c["extended"].alias("is_extended"), c["remote"].alias("remote"),
        F.unhex(c["payload"]).alias("data"),
    )
    return parsed.where(f"arb_id <= {0x1FFFFFFF}").select(
        "session_id", "sequence", "ts_us", "iface", "arb_id", "is_extended", "remote", F.length("data").alias("dlc"), "data"
    )


def read_adapter_log(spark: SparkSession, path: str, dialect: str, channel: int = 1, session_id: str = "adapter") -> DataFrame:
    """Adapter logs of ``<epoch seconds> <adapter line>`` rows; the adapters themselves send no time."""
    if not 1 <= channel <= 5:
        raise ValueError("channel must be 1..5")
    pattern = r"^(\d+(?:\.\d+)?)\s(.*)$"
    lines = read_lines(spark, path).where(F.col("value").rlike(pattern))
    return adapter_frames(
        lines, dialect, F.regexp_extract("value", pattern, 2), epoch_text_us(F.regexp_extract("value", pattern, 1)),
        F.lit(session_id), F.lit(f"can{channel - 1}"),
    )
