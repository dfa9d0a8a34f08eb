"""Definition tables back to DBC text, and the semantic comparison of two definition sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import escape_text, number_text, raw_dbc_id


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_text(text), F.lit('"'))


def rendered_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """Canonical lines (path, section, a, b, c, line) in their total order."""
    long = lambda c: (c if isinstance(c, Column) else F.col(c)).cast("bigint")
    at = lambda section, a=None, b=None, c=None: [
        F.lit(section).alias("section"), *[(long(x) if x is not None else F.lit(0).cast("bigint")).alias(n) for n, x in (("a", a), ("b", b), ("c", c))]
    ]
    src = tables["sources"]
    fixed = lambda section, text: src.select("path", *at(section), text.alias("line"))
    names = tables["nodes"].groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda n: n["name"]), " ").alias("names")
    )
    nodes = src.join(names, "path", "left").select(
        "path", *at(6), F.concat(F.lit("BU_: "), F.coalesce("names", F.lit(""))).alias("line")
    )
    raw = raw_dbc_id(F.col("arbitration_id"), F.col("is_extended")).cast("string")
    m, s = tables["messages"], tables["signals"]
    heads = m.select(
        "path", *at(8, "ordinal"),
        F.concat(F.lit("BO_ "), raw, F.lit(" "), "name", F.lit(": "), F.col("dlc").cast("string"), F.lit(" "), "transmitter").alias("line"),
    )
    receivers = F.when(F.size("receivers") > 0, F.array_join("receivers", ",")).otherwise("Vector__XXX")
    body = s.select(
        "path", *at(8, "message_ordinal", "ordinal"),
        F.concat(
            F.lit(" SG_ "), "name", F.when(F.col("multiplex").isNotNull(), F.concat(F.lit(" "), "multiplex")).otherwise(""), F.lit(" : "),
            F.col("start_bit").cast("string"), F.lit("|"), F.col("length").cast("string"), F.lit("@"), F.col("byte_order").cast("string"),
            F.when(F.col("is_signed"), "-").otherwise("+"), F.lit(" ("), number_text(F.col("factor")), F.lit(","), number_text(F.col("offset")),
            F.lit(") ["), number_text(F.col("minimum")), F.lit("|"), number_text(F.col("maximum")), F.lit("] "), _quoted(F.col("unit")), F.lit(" "), receivers,
        ).alias("line"),
    )
    gap = m.select("path", *at(8, "ordinal", F.lit(1 << 60)), F.lit("").alias("line"))
    m_note = m.where("comment IS NOT NULL").select(
        "path", *at(9, "ordinal"), F.concat(F.lit("CM_ BO_ "), raw, F.lit(" "), _quoted(F.col("comment")), F.lit(";")).alias("line")
    )
    s_note = s.where("comment IS NOT NULL").select(
        "path", *at(9, "message_ordinal", "ordinal"),
        F.concat(F.lit("CM_ SG_ "), raw, F.lit(" "), "name", F.lit(" "), _quoted(F.col("comment")), F.lit(";")).alias("line"),
    )
    lists = tables["values"].groupBy("path", "arbitration_id", "is_extended", "name", "signal_ordinal").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value", "text"))).alias("list")
    )
    order = s.select("path", F.col("ordinal").alias("signal_ordinal"), "message_ordinal")
    pairs = F.array_join(F.transform("list", lambda v: F.concat(v["value"].cast("string"), F.lit(" "), _quoted(v["text"]))), " ")
    s_values = lists.join(order, ["path", "signal_ordinal"]).select(
        "path", *at(9, "message_ordinal", "signal_ordinal", F.lit(1)),
        F.concat(F.lit("VAL_ "), raw, F.lit(" "), "name", F.lit(" "), pairs, F.lit(" ;")).alias("line"),
    )
    extra = tables["passthrough"].select("path", *at(11, "ordinal"), F.col("statement").alias("line"))
    before_extra = tables["passthrough"].select("path").distinct().select("path", *at(10), F.lit("").alias("line"))
    parts = [
        fixed(0, F.concat(F.lit("VERSION "), _quoted(F.col("version")))), fixed(1, F.lit("")), fixed(2, F.lit("NS_ :")), fixed(3, F.lit("")),
        fixed(4, F.lit("BS_:")), fixed(5, F.lit("")), nodes, fixed(7, F.lit("")), heads, body, gap, m_note, s_note, s_values, before_extra, extra,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def render_dbc(tables: dict[str, DataFrame]) -> DataFrame:
    """One canonical text per source. A definition file is a document; its lines are bounded by its own size."""
    rows = rendered_lines(tables).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("section", "a", "b", "c", "line"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return rows.select("path", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("text"))


def rendered_as_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """Rendered text as line rows, ready to be parsed again."""
    return render_dbc(tables).select("path", F.lit(0).cast("bigint").alias("block"), F.posexplode(F.split("text", "\n")).alias("pos", "value")).select(
        "path", "block", (F.col("pos") + 1).cast("bigint").alias("line_no"), "value"
    )


def semantic_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Everything that carries meaning, one row per item with its place; passthrough statements do not count."""
    as_text = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    m, s = tables["messages"], tables["signals"]
    rank = lambda part, order: F.expr(f"row_number() OVER (PARTITION BY {part} ORDER BY {order})")
    item = lambda df, kind, *c: df.select("path", F.lit(kind).alias("kind"), as_text(*c).alias("body"))
    # places are ranks inside a file or message, which are small documents
    return (
        item(tables["sources"], "source", "version")
        .unionByName(item(tables["nodes"].withColumn("n", rank("path", "ordinal")), "node", "n", "name"))
        .unionByName(item(m.withColumn("n", rank("path", "ordinal")), "message", "n", "arbitration_id", "is_extended", "name", "dlc", "transmitter", "comment"))
        .unionByName(
            item(
                s.withColumn("n", rank("path, message_ordinal", "ordinal")), "signal", "arbitration_id", "is_extended", "n", "name", "start_bit",
                "length", "byte_order", "is_signed", "factor", "offset", "minimum", "maximum", "unit", "receivers", "multiplex", "comment",
            )
        )
        .unionByName(item(tables["values"], "value", "arbitration_id", "is_extended", "name", "pos", "value", "text"))
    )


def semantic_diff(left: dict[str, DataFrame] | DataFrame, right: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """Items on one side only, counted with their repetitions, in one pass over both sides; a side may be its semantic rows."""
    rows = lambda side: side if isinstance(side, DataFrame) else semantic_rows(side)
    l = rows(left).withColumn("side", F.lit(1))
    r = rows(right).withColumn("side", F.lit(-1))
    return l.unionByName(r).groupBy("path", "kind", "body").agg(F.sum("side").alias("balance")).where("balance != 0")


def default_receivers(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A signal without receivers is written with the default receiver, so comparisons start from that."""
    s = tables["signals"].withColumn(
        "receivers", F.when(F.size("receivers") > 0, F.col("receivers")).otherwise(F.array(F.lit("Vector__XXX")))
    )
    return {**tables, "signals": s}
