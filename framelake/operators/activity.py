"""Activity ranking of ids and bytes, length and cadence statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import BLOCK, with_words
from framelake.plans.changes import change_counts
from framelake.plans.ordered import CHUNK_US, chunk_of, gaps, place
from framelake.plans.stats import exact_median
from framelake.session import tasks_for

ID_KEY = ["session_id", "iface", "arb_id"]
#: Frames per task of the profile, whose rows are wide: a kilobyte and more for each block of a frame.
WIDE_ROWS = 50_000


def _byte(i: int) -> str:
    """SQL text of byte ``i`` of a ``with_words`` block."""
    word, shift = ("w_hi", 24 - 8 * i) if i < 4 else ("w_lo", 56 - 8 * i)
    return f"if(w_len > {i}, cast(shiftright({word}, {shift}) & 255 AS INT), NULL)"


def _profile(frames: DataFrame, chunk_us: int) -> DataFrame:
    """One wide row per id and block of eight payload bytes: counts, times, payload changes and per-byte statistics.

    A byte has 256 values, so its distinct set is four 64-bit masks merged with ``bit_or``: everything aggregates
    map-side in fixed-size buffers, bytes are not exploded, and the frames are shuffled once. Block 0 holds what
    concerns the frame as a whole, its payload included; other blocks have their own bytes only.
    """
    first = "w_block = 0"
    wide = with_words(frames.withColumn("chunk", chunk_of("ts_us", chunk_us))).selectExpr(
        *ID_KEY, "w_block", "ts_us", "sequence", "chunk", f"if({first}, data, NULL) AS payload", *[f"{_byte(i)} AS b{i}" for i in range(BLOCK)]
    )
    tracks: dict[str, list[str]] = {"transitions": ["payload"]}
    extras: dict[str, tuple[str, str]] = {
        "frame_count": ("sum", "1"),
        "first_us": ("min", "ts_us"),
        "last_us": ("max", "ts_us"),
    }
    for i in range(BLOCK):
        tracks[f"changes{i}"] = [f"b{i}"]
        extras[f"count{i}"] = ("sum", f"if(b{i} IS NULL, 0, 1)")
        extras[f"min{i}"] = ("min", f"b{i}")
        extras[f"max{i}"] = ("max", f"b{i}")
        for q in range(4):
            bit = f"if(shiftright(b{i}, 6) = {q}, shiftleft(1L, b{i} & 63), 0L)"
            extras[f"m{i}_{q}"] = ("bit_or", bit)
    return change_counts(wide, [*ID_KEY, "w_block"], ["chunk"], ["ts_us", "sequence"], tracks, extras, tasks_for(frames.count(), WIDE_ROWS))


def _distinct(i: int) -> str:
    return "(" + " + ".join(f"bit_count(m{i}_{q})" for q in range(4)) + ")"


def id_activity(frames: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Activity of each (session, interface, id): 100 x transition ratio + byte diversity + 5 x changing bytes."""
    changing = " + ".join(f"if({_distinct(i)} > 1, 1, 0)" for i in range(BLOCK))
    diversity = " + ".join(f"greatest(least({_distinct(i)} - 1, 32), 0)" for i in range(BLOCK))
    whole = ["frame_count", "first_us", "last_us", "transitions"]
    return (
        _profile(frames, chunk_us)
        .selectExpr("*", f"{changing} AS changing", f"{diversity} AS spread")
        .groupBy(*ID_KEY)
        .agg(F.sum("changing").alias("changing_byte_count"), F.sum("spread").alias("diversity"), *[F.max(F.when(F.col("w_block") == 0, F.col(c))).alias(c) for c in whole])
        .selectExpr(
            *ID_KEY,
            "frame_count",
            "first_us / 1e6D AS first_ts",
            "last_us / 1e6D AS last_ts",
            "if(frame_count > 1, (last_us - first_us) / 1e3D / (frame_count - 1), NULL) AS mean_period_ms",
            "transitions AS transition_count",
            "changing_byte_count",
            "1e2D * transitions / greatest(frame_count - 1, 1) + diversity + changing_byte_count * 5 AS activity_score",
        )
    )


def byte_activity(frames: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Activity of each byte of each id; a byte's previous value is that of the last frame long enough to have it."""
    cells = ", ".join(
        f"named_struct('byte_index', w_block * {BLOCK} + {i}, 'observation_count', count{i}, 'distinct_values', {_distinct(i)}, "
        f"'minimum_value', min{i}, 'maximum_value', max{i}, 'change_count', changes{i}, 'activity_score', "
        f"1e2D * changes{i} / greatest(count{i} - 1, 1) + least({_distinct(i)} - 1, 32))"
        for i in range(BLOCK)
    )
    return _profile(frames, chunk_us).selectExpr(
        *ID_KEY, f"inline(filter(array({cells}), c -> c.observation_count > 0))"
    )


def top_ids(id_metrics: DataFrame, n: int = 25) -> DataFrame:
    """The most active ids; (iface, id) breaks ties."""
    return id_metrics.orderBy(
        F.round("activity_score", 6).desc(), F.desc("frame_count"), "session_id", "iface", "arb_id"
    ).limit(n)


def dlc_histogram(frames: DataFrame) -> DataFrame:
    """Frames per (interface, id, length)."""
    return frames.groupBy("iface", "arb_id", F.length("data").alias("dlc")).agg(F.count("*").alias("frames"))


def dominant_dlc(frames: DataFrame) -> DataFrame:
    """Most common length per (interface, id); a tie goes to the length seen first in (session, time) order."""
    per_source = frames.groupBy("iface", "arb_id", F.length("data").alias("dominant_dlc"), "session_id").agg(
        F.count("*").alias("n"), F.min(place()).alias("at")
    )
    per_length = per_source.groupBy("iface", "arb_id", "dominant_dlc").agg(
        F.sum("n").alias("n"), F.min(F.struct("session_id", "at")).alias("at")
    )
    best = Window.partitionBy("iface", "arb_id").orderBy(F.desc("n"), "at")
    return (
        per_length.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select("iface", "arb_id", "dominant_dlc")
    )


def select_dominant_dlc(frames: DataFrame) -> DataFrame:
    """Frames whose length is the most common one of their (interface, id)."""
    d = dominant_dlc(frames)
    return frames.join(d, ["iface", "arb_id"]).where(F.length("data") == F.col("dominant_dlc")).drop("dominant_dlc")


def period_stats(frames: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Median period in ms per (interface, id): the median over sessions of each session's median."""
    g = gaps(select_dominant_dlc(frames), ["session_id", "iface", "arb_id"], "ts_us", chunk_us).where("gap >= 0")
    per_source = exact_median(g, ["session_id", "iface", "arb_id"], "gap", "source_median_us")
    return exact_median(per_source, ["iface", "arb_id"], "source_median_us", "median_us").select(
        "iface", "arb_id", (F.col("median_us") / 1000.0).alias("median_period_ms")
    )


def change_rate(frames: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Share of changed values per (interface, id, byte) over rows ordered (session, time), across sessions."""
    kept = select_dominant_dlc(frames).withColumn("chunk", chunk_of("ts_us", chunk_us))
    wide = with_words(kept).selectExpr(
        "iface", "arb_id", "w_block", "session_id", "ts_us", "sequence", "chunk", *[f"{_byte(i)} AS b{i}" for i in range(BLOCK)]
    )
    tracks = {f"changes{i}": [f"b{i}"] for i in range(BLOCK)}
    extras: dict[str, tuple[str, str]] = {}
    for i in range(BLOCK):
        extras[f"count{i}"] = ("sum", f"if(b{i} IS NULL, 0, 1)")
        extras[f"min{i}"] = ("min", f"b{i}")
        extras[f"max{i}"] = ("max", f"b{i}")
    cells = ", ".join(
        f"named_struct('byte_index', w_block * {BLOCK} + {i}, 'observations', count{i}, 'minimum_value', min{i}, 'maximum_value', max{i}, "
        f"'change_rate', if(count{i} > 1, changes{i} / cast(count{i} - 1 AS DOUBLE), 0D))"
        for i in range(BLOCK)
    )
    return change_counts(
        wide, ["iface", "arb_id", "w_block"], ["session_id", "chunk"], ["ts_us", "sequence"], tracks, extras
    ).selectExpr("iface", "arb_id", f"inline(filter(array({cells}), c -> c.observations > 0))")


def id_counts(frames: DataFrame) -> DataFrame:
    """Frames per (interface, id)."""
    return frames.groupBy("iface", "arb_id").agg(F.count("*").alias("frames"))
