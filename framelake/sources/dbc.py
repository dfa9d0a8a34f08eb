"""Signal definition files (DBC text) as a corpus load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import dbc_id
from framelake.plans.ordered import Carry, running
from framelake.session import cut_lineage
from framelake.sources.lines import read_lines

# Statements of the definition language that are kept as they are, and those whose form is checked.
EXTENSIONS = ("BA_", "BA_DEF_", "BA_DEF_DEF_", "SIG_GROUP_", "SIG_VALTYPE_", "BO_TX_BU_")
CORE = ("BO_", "SG_", "VAL_", "CM_")

DIGITS = "0123456789"
WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_" + DIGITS
#: Stand for an escaped backslash and an escaped quote while a statement is cut at its quotes.
_BACKSLASH, _QUOTE = "\x01", "\x02"


# ---- statements are cut into fields: first at the quotes, then at blanks and punctuation ----


def _cut(text: Column) -> Column:
    """The parts of a statement outside (even places) and inside (odd places) of quotes."""
    masked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.split(masked, '"', -1)


def _plain(part: Column) -> Column:
    """A quoted part with its escapes resolved."""
    return F.replace(F.replace(part, F.lit(_QUOTE), F.lit('"')), F.lit(_BACKSLASH), F.lit("\\"))


def _fields(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _only(text: Column, letters: str) -> Column:
    return (text != "") & (F.translate(text, letters, "") == "")


def _name(text: Column) -> Column:
    return _only(text, WORD) & ~F.substr(text, F.lit(1), F.lit(1)).between("0", "9")


def _sure(keyword: str, ok: Column, **fields: Column) -> Column:
    """The fields of a statement as a struct, null where it has another keyword or form."""
    whole = F.when(F.coalesce(ok, F.lit(False)), F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.when(F.col("text").startswith(keyword), whole)


def cut_lines(df: DataFrame) -> DataFrame:
    """Adds what all statement forms are read from: ``parts`` (see :func:`_cut`), ``left`` and ``right`` (the fields before
    and the text behind the first colon outside of quotes), ``numbers`` (the fields of ``right`` without punctuation)."""
    halves = df.withColumn("parts", _cut(F.col("text"))).withColumn("_halves", F.split(F.get("parts", F.lit(0)), ":", 2))
    sides = halves.withColumn("left", _fields(F.get("_halves", F.lit(0)))).withColumn("right", F.get("_halves", F.lit(1))).drop("_halves")
    return sides.withColumn("numbers", _fields(F.translate("right", "|@(),[]", "       ")))


def version_fields() -> Column:
    parts = F.col("parts")
    at = lambda i: F.get(parts, F.lit(i))
    return _sure("VERSION", (F.trim(at(0)) == "VERSION") & (F.size(parts) == 3) & (F.trim(at(2)) == ""), version=_plain(at(1)))


def message_fields() -> Column:
    """``BO_ id name : bytes transmitter``, blanks around the colon as one likes."""
    left, right = F.col("left"), _fields(F.col("right"))
    raw, name, dlc = F.get(left, F.lit(1)), F.get(left, F.lit(2)), F.get(right, F.lit(0))
    ok = (F.get(left, F.lit(0)) == "BO_") & (F.size(left) == 3) & (F.size(right) == 2) & _only(raw, DIGITS) & _name(name) & _only(dlc, DIGITS)
    return _sure("BO_", ok & (F.size("parts") == 1), raw_id=_long(raw), name=name, dlc=dlc.cast("int"), transmitter=F.get(right, F.lit(1)))


def signal_fields() -> Column:
    """``SG_ name [multiplex] : start|length@order sign (factor,offset) [minimum|maximum] "unit" receivers``."""
    parts, left, right, numbers = F.col("parts"), F.col("left"), F.col("right"), F.col("numbers")
    name, mux = F.get(left, F.lit(1)), F.coalesce(F.get(left, F.lit(2)), F.lit(""))
    n = lambda i: F.get(numbers, F.lit(i))
    marks = F.translate(right, DIGITS + "+-.eE \t", "")
    form = (F.get(left, F.lit(0)) == "SG_") & (F.size(left) <= 3) & _name(name) & (marks == "|@(,)[|]") & (F.size(numbers) == 7) & (F.size(parts) == 3)
    mux_ok = mux.isin("", "M") | (F.translate(mux, DIGITS, "").isin("m", "mM") & (F.length(mux) > F.length(F.translate(mux, DIGITS, ""))))
    ok = form & mux_ok & _only(n(0), DIGITS) & _only(n(1), DIGITS) & n(2).isin("0+", "0-", "1+", "1-")
    receivers = F.filter(F.transform(F.split(F.get(parts, F.lit(2)), ","), lambda r: F.trim(r)), lambda r: r != "")
    return _sure(
        "SG_", ok, name=name, multiplex=F.nullif(mux, F.lit("")), start_bit=n(0).cast("int"), length=n(1).cast("int"),
        byte_order=F.substr(n(2), F.lit(1), F.lit(1)).cast("int"), is_signed=n(2).endswith("-"),
        factor=n(3).try_cast("double"), offset=n(4).try_cast("double"), minimum=n(5).try_cast("double"), maximum=n(6).try_cast("double"),
        unit=_plain(F.get(parts, F.lit(1))), receivers=receivers,
    )


def value_fields() -> Column:
    """``VAL_ id name number "text" ... ;`` with the pairs as an array of (value, text)."""
    parts, text = F.col("parts"), F.col("text")
    head = _fields(F.regexp_replace(F.get(parts, F.lit(0)), ";", " "))
    raw, name = F.get(head, F.lit(1)), F.get(head, F.lit(2))
    ok = (F.get(head, F.lit(0)) == "VAL_") & text.endswith(";") & _only(raw, DIGITS) & _name(name)
    places = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i % 2 == 1) & (i + 1 < F.size(parts)))
    number = lambda i: F.element_at(_fields(F.get(parts, i - 1)), -1)
    pairs = F.transform(places, lambda i: F.struct(number(i).try_cast("bigint").alias("value"), _plain(F.get(parts, i)).alias("text")))
    bare = F.size(parts) == 1
    return _sure(
        "VAL_", ok, raw_id=_long(raw), name=name, pairs=F.filter(pairs, lambda p: p["value"].isNotNull()),
        body=F.when(bare, F.array_join(F.slice(head, F.lit(4), F.greatest(F.size(head) - 3, F.lit(0))), " ")).otherwise(text),
    )


def note_fields(of_signal: bool) -> Column:
    """``CM_ BO_ id "note";`` or ``CM_ SG_ id name "note";``."""
    parts = F.col("parts")
    head = _fields(F.get(parts, F.lit(0)))
    raw, name = F.get(head, F.lit(2)), F.get(head, F.lit(3))
    ok = (F.get(head, F.lit(0)) == "CM_") & (F.get(head, F.lit(1)) == ("SG_" if of_signal else "BO_")) & (F.size(head) == (4 if of_signal else 3))
    ok = ok & _only(raw, DIGITS) & (F.size(parts) == 3) & (F.trim(F.get(parts, F.lit(2))) == ";")
    if of_signal:
        ok = ok & _name(name)
    return _sure("CM_", ok, raw_id=_long(raw), name=name, body=_plain(F.get(parts, F.lit(1))))


def _long(digits: Column) -> Column:
    return digits.try_cast("decimal(20,0)").cast("bigint")


def _starts(text: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def statements(lines: DataFrame) -> DataFrame:
    """Classified statements of (path, block, line_no, value) lines, each with the message it belongs to.

    The names block runs from NS_ to BS_ and is skipped; a signal belongs to the last message line above it.
    """
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    # each line is cut once, in as many tasks as there are cores and not as there are splits of a small input, and what it was
    # cut into is written: the state lines and the owners below read it several times
    t = F.col("text")
    dealt = lines.where("trim(value) != ''").select("path", "block", "line_no", text.alias("text")).repartition("path", "block")
    cut = cut_lineage(cut_lines(dealt).select(
        "path", "block", "line_no", "text", version_fields().alias("as_version"), message_fields().alias("as_message"), signal_fields().alias("as_signal"),
        value_fields().alias("as_values"), note_fields(False).alias("as_message_note"), note_fields(True).alias("as_signal_note"),
    ))
    # state lines of the names block; VERSION lines are read even inside it
    edge = F.when(F.col("as_version").isNotNull(), None).when(t.startswith("NS_"), 1).when(t.startswith("BS_"), 0)
    names = running(cut.withColumn("edge", edge), ["path"], ["line_no"], {"inside": Carry("last", F.col("edge"))}, ["block"])
    kept = names.where((F.coalesce("inside", F.lit(0)) == 0) | F.col("as_version").isNotNull())
    kind = F.when(F.col("as_version").isNotNull(), "version").when(t.startswith("BS_"), "skip").when(t.startswith("BU_:"), "nodes")
    for name in ("message", "signal", "values", "message_note", "signal_note"):
        kind = kind.when(F.col(f"as_{name}").isNotNull(), name)
    kind = kind.when(_starts(t, EXTENSIONS), "passthrough").when(_starts(t, CORE), "malformed").otherwise("passthrough")
    typed = kept.drop("edge", "inside").withColumn("kind", kind).where("kind != 'skip'")
    owner = F.when(F.col("kind") == "message", F.struct(F.col("line_no").alias("line_no"), F.col("as_message.raw_id").alias("raw_id"), F.col("as_message.dlc").alias("dlc")))
    return running(typed, ["path"], ["line_no"], {"owner": Carry("last", owner)}, ["block"])


def definitions(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables sources, nodes, messages, signals, values, passthrough and violations of definition lines."""
    # eleven tables and checks read the statements; they are written once instead of scanned eleven times
    st = cut_lineage(statements(lines))
    t = F.col("text")
    of = lambda kind: st.where(F.col("kind") == kind).withColumn("f", F.col(f"as_{kind}"))

    version = of("version").groupBy("path").agg(F.max_by("f.version", "line_no").alias("version"))
    sources = st.select("path").distinct().join(version, "path", "left").withColumn("version", F.coalesce("version", F.lit("")))
    nodes = st.where("kind = 'nodes'").withColumn("f", _fields(F.substr(t, F.lit(5)))).select("path", "line_no", F.posexplode("f").alias("pos", "name")).select(
        "path", (F.col("line_no") * 100_000 + F.col("pos")).alias("ordinal"), "name"
    )
    raw = of("message").select("path", "line_no", "f.*").withColumn("id", dbc_id(F.col("raw_id")))
    messages = raw.select(
        "path", F.col("line_no").alias("ordinal"), "id.arbitration_id", "id.is_extended", "name", "dlc", "transmitter"
    )
    signals = of("signal").where("owner IS NOT NULL").withColumn("id", dbc_id(F.col("owner.raw_id"))).select(
        "path", F.col("owner.line_no").alias("message_ordinal"), "id.arbitration_id", "id.is_extended", F.col("line_no").alias("ordinal"),
        "f.*", F.col("owner.dlc").alias("owner_dlc"),
    )
    noted = lambda kind: of(kind).select("path", "line_no", dbc_id(F.col("f.raw_id")).alias("id"), "f.*")
    values, m_notes, s_notes = noted("values"), noted("message_note"), noted("signal_note")
    m_key, s_key = ["path", "arbitration_id", "is_extended"], ["path", "arbitration_id", "is_extended", "name"]
    flat = lambda df, *extra: df.select("path", "line_no", "id.arbitration_id", "id.is_extended", *extra)
    latest = lambda df, key: df.groupBy(*key).agg(F.max_by("body", "line_no").alias("comment"))
    messages_out = messages.join(latest(flat(m_notes, "body"), m_key), m_key, "left")
    # a note or value list goes to the first signal of that name in the message
    first = signals.groupBy(*s_key).agg(F.min("ordinal").alias("ordinal"))
    signal_comments = latest(flat(s_notes, "name", "body"), s_key).join(first, s_key)
    signals_out = signals.join(signal_comments.select(*s_key, "ordinal", "comment"), [*s_key, "ordinal"], "left").drop("owner_dlc")
    last_list = flat(values, "name", "pairs").groupBy(*s_key).agg(F.max_by("pairs", "line_no").alias("pairs")).join(first, s_key)
    values_out = last_list.select(*s_key, F.col("ordinal").alias("signal_ordinal"), F.posexplode("pairs").alias("pos", "p")).select(*s_key, "signal_ordinal", "pos", "p.*")
    passthrough = st.where("kind = 'passthrough'").select("path", F.col("line_no").alias("ordinal"), t.alias("statement"))

    rule = lambda df, name, detail, line="line_no": df.select(
        "path", F.col(line).cast("bigint").alias("line_no"), F.lit(name).alias("rule"), detail.cast("string").alias("detail")
    )
    repeated = messages.groupBy(*m_key).agg(F.count("*").alias("n"), F.max("ordinal").alias("line_no")).where("n > 1")
    known_m, known_s = messages.select(*m_key).distinct(), signals.select(*s_key).distinct()
    violations = [
        rule(st.where("kind = 'malformed'"), "malformedStatement", F.substr(t, F.lit(1), F.lit(120))),
        rule(raw.where("id IS NULL"), "idOutOfRange", F.col("raw_id")),
        rule(raw.where("dlc < 0 OR dlc > 64"), "dlcOutOfRange", F.col("dlc")),
        rule(st.where("kind = 'signal' AND owner IS NULL"), "signalWithoutMessage", t),
        rule(signals.where("length < 1 OR length > 64"), "signalLengthOutOfRange", F.col("length"), "ordinal"),
        rule(signals.where("start_bit >= owner_dlc * 8"), "signalOutsideMessage", F.col("start_bit"), "ordinal"),
        rule(repeated, "duplicateMessage", F.col("arbitration_id")),
        rule(values.where((F.size("pairs") == 0) & (F.trim("body") != "")), "malformedValues", F.col("body")),
        rule(flat(values, "name").join(known_s, s_key, "left_anti"), "valuesWithoutSignal", F.col("name")),
        rule(flat(m_notes).join(known_m, m_key, "left_anti"), "noteWithoutMessage", F.col("arbitration_id")),
        rule(flat(s_notes, "name").join(known_s, s_key, "left_anti"), "noteWithoutSignal", F.col("name")),
    ]
    bad = violations[0]
    for v in violations[1:]:
        bad = bad.unionByName(v)
    return {
        "sources": sources, "nodes": nodes, "messages": messages_out, "signals": signals_out, "values": values_out,
        "passthrough": passthrough, "violations": bad,
    }


def read_dbc(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, DataFrame]:
    """Definition files to tables; look at ``violations`` before using the rest."""
    return definitions(read_lines(spark, paths))


def definition_registry(tables: dict[str, DataFrame], network: str, bitrate_kbps: int) -> DataFrame:
    """Definitions in the registry layout, so that ``decode_registry`` can use them."""
    m = tables["messages"].select("path", "arbitration_id", "is_extended", F.col("ordinal").alias("message_ordinal"), F.col("name").alias("message"))
    return tables["signals"].join(m, ["path", "arbitration_id", "is_extended", "message_ordinal"]).select(
        F.col("path").alias("source"), F.lit(network).alias("network"), F.lit(bitrate_kbps).alias("bitrate_kbps"),
        F.col("arbitration_id").alias("can_id"), "message", F.col("name").alias("signal"), "start_bit", "length",
        F.when(F.col("byte_order") == 0, "motorola").otherwise("intel").alias("endian"), F.col("is_signed").alias("signed"),
        F.col("factor").alias("scale"), "offset", "unit", F.lit("definition").alias("confidence"), F.coalesce("comment", F.lit("")).alias("notes"),
    )
