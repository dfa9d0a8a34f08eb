"""Conversations as training text: a template, a parser that reads it back, and escapes chosen by the round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import stored, table

# The template's control strings. A turn is OPEN role HEAD text CLOSE.
BEGIN, CLOSE, INST, HEAD = "<s>", "</s>", "[INST]", "[/INST]"
OPEN = BEGIN + INST
#: The role whose texts are learnt.
LEARNT = "assistant"
#: Turn numbers that share a chunk of a conversation's text.
CHUNK_TURNS = 64
#: Times that conflicting content is escaped before the round trip must hold.
ROUNDS = 2
_CONTROL = r"</?s>|\[/?INST\]"


def escape(c: Column) -> Column:
    """One more backslash behind the first letter of each control string, escaped or not."""
    return F.regexp_replace(F.regexp_replace(c, r"<(\\*/?s>)", r"<\\$1"), r"\[(\\*/?INST\])", r"[\\$1")


def unescape(c: Column) -> Column:
    """The inverse of :func:`escape`: one backslash less in each escaped control string."""
    plain = F.regexp_replace(F.regexp_replace(c, r"<\\(\\*/?s>)", "<$1"), r"\[\\(\\*/?INST\])", "[$1")
    return F.when(F.contains(c, F.lit("\\")), plain).otherwise(c)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD), text, F.lit(CLOSE))


def segments(formatted: Column) -> Column:
    """What stands before each CLOSE; the last element is what follows the last one."""
    return F.split(formatted, CLOSE, -1)


def _turn(segment: Column) -> Column:
    """(role, text) of a segment, null where it isn't one of the grammar: control strings stand in their places only."""
    body = F.substr(segment, F.lit(len(OPEN) + 1))
    role = F.substring_index(body, HEAD, 1)
    text = F.substr(body, F.length(role) + len(HEAD) + 1)
    valid = F.startswith(segment, F.lit(OPEN)) & F.contains(body, F.lit(HEAD)) & ~F.rlike(role, F.lit(_CONTROL)) & ~F.rlike(text, F.lit(_CONTROL))
    return F.when(valid, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text>>: one per segment, and a null one for anything that is no turn."""
    parts = segments(formatted)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), _turn)
    return F.when(F.element_at(parts, -1) == "", turns).otherwise(F.concat(turns, F.array(F.lit(None).cast("struct<role:string,text:string>"))))


def _until_identical(rows: DataFrame) -> DataFrame:
    """``rows`` (role, text) with the content _r, _t that the parser reads back as role and text: what conflicts is escaped."""
    source = F.array(F.struct(F.col("role"), F.col("text")))
    out = rows.withColumns({"_r": F.col("role"), "_t": F.col("text")})
    for _ in range(ROUNDS):
        same = F.coalesce(parse(render(F.col("_r"), F.col("_t"))) == source, F.lit(False))
        out = out.withColumn("_same", same).withColumns({"_r": F.when(F.col("_same"), F.col("_r")).otherwise(escape(F.col("_r"))), "_t": F.when(F.col("_same"), F.col("_t")).otherwise(escape(F.col("_t")))})
    # what was still escaped in the last round did not come back in the round before
    return out.withColumn("_t", F.when(F.col("_same"), F.col("_t")).otherwise(F.raise_error(F.lit("A turn does not survive the round trip"))))


def format_chats(df: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, chunk, formatted, n_turns, mask) of ``df`` (conv_id, turn, role, text): the text of each conversation in chunks,
    whose texts, put together by chunk, are the text of the conversation.

    Turns are ordered by ``turn``, null first; turns of one number by their formatted text, repeated rows each stay. Null
    roles and texts are empty; rows without conv_id are one conversation. A chunk holds ``chunk_turns`` turn numbers, so a
    conversation of any length is dealt to many tasks (rows of the same number share a chunk). mask: the spans to learn,
    array<struct<turn, start, length>>: in code points of the turn's segment, turns of the chunk counted from 0.
    """
    rows = df.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    first = F.lit(-(1 << 63))
    made = _until_identical(rows).select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / chunk_turns), first).alias("chunk"), F.coalesce("turn", first).alias("turn"),
        render(F.col("_r"), F.col("_t")).alias("form"),
        F.when(F.col("role") == LEARNT, F.struct((F.length("_r") + len(OPEN) + len(HEAD)).alias("start"), F.length("_t").alias("length"))).alias("span"),
    )
    chunks = made.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "form", "span"))).alias("_turns"))
    spans = F.transform("_turns", lambda t, i: F.struct(i.alias("turn"), t["span"]["start"].alias("start"), t["span"]["length"].alias("length")))
    return chunks.select(
        "conv_id", "chunk", F.array_join(F.transform("_turns", lambda t: t["form"]), "").alias("formatted"), F.size("_turns").alias("n_turns"),
        F.filter(spans, lambda s: s["start"].isNotNull()).alias("mask"),
    )


def read_chats(chunks: DataFrame) -> DataFrame:
    """``chunks`` with turns (array<struct<role, text>>) and learnt (array<string>: the unescaped texts under the mask), both read
    from the formatted text. A chunk that the parser does not read as ``n_turns`` turns ends the query."""
    parts, turns = segments(F.col("formatted")), parse(F.col("formatted"))
    whole = (F.size("turns") == F.col("n_turns")) & ~F.exists("turns", lambda t: t.isNull())
    read = chunks.withColumns({"turns": turns, "_parts": parts})
    learnt = F.transform("mask", lambda m: unescape(F.substr(F.get("_parts", m["turn"]), m["start"] + 1, m["length"])))
    return read.withColumns({"turns": F.when(whole, F.col("turns")).otherwise(F.raise_error(F.lit("A formatted text does not parse"))), "learnt": learnt}).drop("_parts")


def chat_digests(df: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation, from its formatted text.

    Conversations of one chunk are hashed where they are; only the texts of longer ones meet once more, as a digest of all
    their text asks for. Which ones are longer is found on the turn numbers alone.
    """
    chunk = F.coalesce(F.floor(F.col("turn").cast("long") / chunk_turns), F.lit(-(1 << 63)))
    ends = df.groupBy(F.col("conv_id").cast("long").alias("long_id")).agg(F.min(chunk).alias("a"), F.max(chunk).alias("b"))
    longer = stored(ends.where("a < b").select("long_id", F.lit(True).alias("long")))
    chunks = read_chats(format_chats(df, chunk_turns))
    told = chunks.select(
        "conv_id", "chunk", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("learnt", "").alias("loss"),
    ).join(longer, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    parts = told.select(
        "conv_id", "n", "chars", F.length("loss").alias("loss_chars"),
        F.when(F.col("long").isNull(), F.struct(F.sha2("said", 256).alias("said"), F.sha2("loss", 256).alias("loss"))).alias("one"),
        F.when(F.col("long"), F.struct("chunk", "said", "loss")).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("loss_chars").alias("loss_chars"), F.sum("chars").alias("formatted_chars"), F.max("one").alias("one"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    joined = lambda name: F.sha2(F.array_join(F.transform("parts", lambda p: p[name]), ""), 256)
    digest = lambda name: F.when(F.col("one").isNotNull(), F.col("one")[name]).otherwise(joined(name))
    return whole.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), "loss_chars", digest("loss").alias("loss_sha256"), "formatted_chars")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


_ESCAPED = r"regexp_replace(regexp_replace({c}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"
OP12_SQL = f"""WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<s>[INST]' || {_ESCAPED.format(c='role')} || '[/INST]' || {_ESCAPED.format(c='text')} || '</s>' AS form FROM src)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, form)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, form) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(form)) AS formatted_chars
FROM f GROUP BY conv_id"""
