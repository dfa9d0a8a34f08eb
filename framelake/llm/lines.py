"""Line dedup: repeated windows of three consecutive lines lose their later occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import table

WINDOW = 3


def _windows(lines: Column, width: int) -> Column:
    """128-bit hashes of all runs of ``width`` lines, in order; null where all lines of a run are blank."""
    at = F.sequence(F.lit(0), F.size(lines) - width)
    joined = F.transform(at, lambda i: F.array_join(F.slice(lines, i + 1, width), "\n"))
    hashed = F.transform(joined, lambda w: F.when(F.trim(F.translate(w, "\n\r\t", "   ")) != "", F.unhex(F.md5(w))))
    return F.when(F.size(lines) >= width, hashed)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, digest, covered): per text with later occurrences of repeated windows, the sorted distinct line positions, from 0, that they cover.

    A window is ``width`` consecutive lines, compared exactly; windows of blank lines alone don't count. Its first
    occurrence is the one with the smallest (id, text digest, position), null ids first.
    """
    keyed = df.select(F.col(id_col).alias("_i"), F.md5(text_col).alias("_d"), F.split(text_col, "\n", -1).alias("_l"))
    spans = keyed.select("_i", "_d", F.posexplode(_windows(F.col("_l"), width)).alias("_p", "_h")).where("_h is not null")
    place = F.struct("_i", "_d", "_p")
    firsts = spans.groupBy("_h").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = spans.join(firsts, "_h").where(~place.eqNullSafe(F.col("_first")))
    starts = later.groupBy("_i", "_d").agg(F.collect_set("_p").alias("_s"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("_s", lambda p: F.sequence(p, p + (width - 1))))))
    return starts.select("_i", "_d", covered.alias("_c"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``df`` with the covered lines cut out of ``text_col`` and the columns lines_total and lines_removed added.

    Overlapping and touching windows are merged: each covered line goes once. Texts of fewer lines than a window, null
    and empty texts stay as they are (null has 0 lines). Rows with the same id and the same text count as one text and
    all get its result. A text that is covered whole becomes empty; its row stays. Columns of any name may come along.
    """
    hits = repeated_lines(df, id_col, text_col, width)
    held = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_k"), F.md5(text_col).alias("_m"))
    joined = held.join(hits, F.col("_k").eqNullSafe(F.col("_i")) & (F.col("_m") == F.col("_d")), "left")
    lines = F.split(F.col("_row")[text_col], "\n", -1)
    numbered = F.arrays_zip(lines.alias("line"), F.sequence(F.lit(0), F.size(lines) - 1).alias("at"))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.col("_c"), x["at"]))
    text = F.when(F.col("_c").isNull(), F.col("_row")[text_col]).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    names = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns if c not in ("lines_total", "lines_removed")]
    return joined.select(
        *names,
        F.when(F.col("_row")[text_col].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("lines_total"),
        F.when(F.col("_c").isNull(), 0).otherwise(F.size("_c")).cast("long").alias("lines_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_total", "lines_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP5_SQL = r"""
with texts as (select doc_id, text, md5(text) as d, string_split(text, chr(10)) as l from documents),
placed as (select doc_id, d, unnest(range(len(l) - 2)) as p, l from texts where len(l) >= 3),
spans as (
    select doc_id, d, p, array_to_string(l[p + 1 : p + 3], chr(10)) as w from placed
    where trim(translate(array_to_string(l[p + 1 : p + 3], chr(10)), chr(10) || chr(13) || chr(9), '   ')) <> ''
),
numbered as (select *, row_number() over (partition by w order by doc_id nulls first, d, p) as k from spans),
covered as (select doc_id, d, list(distinct q) as c from (select doc_id, d, unnest([p, p + 1, p + 2]) as q from numbered where k > 1) group by doc_id, d),
kept as (
    select t.doc_id, t.text, t.l, coalesce(len(c.c), 0) as removed,
        case when c.c is null then t.text
             else array_to_string([t.l[i] for i in range(1, len(t.l) + 1) if not list_contains(c.c, i - 1)], chr(10)) end as kept
    from texts t left join covered c on t.doc_id is not distinct from c.doc_id and t.d = c.d
)
select doc_id, cast(case when text is null then 0 else len(l) end as bigint) as lines_total, cast(removed as bigint) as lines_removed,
    cast(length(kept) as bigint) as kept_chars, md5(kept) as kept_md5
from kept
"""
