"""A battery seen on two networks: test data in the frame layouts that the decoders read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS, PER_FRAME = 96, 3


def slot_of(cell: int) -> int:
    return (cell * 29 + 11) % CELLS + 1


def _cell_in(slot: Column) -> Column:
    """The cell that is wired to a slot; 29 * 53 = 1 (mod 96)."""
    cell = F.pmod((slot - 12) * 53, F.lit(CELLS))
    return F.when(cell == 0, CELLS).otherwise(cell)


def _raw(cell: Column) -> Column:
    """Reading of a cell in steps of 1.25 mV: no two cells move alike."""
    return F.lit(2700) + F.pmod(cell * 41 + F.col("cycle") * F.col("cycle") * 13 + cell * F.col("cycle") * 7, F.lit(397))


def _frame(df: DataFrame, session: str, iface: str, arb_id: Column, delay_us: int, words: list[Column]) -> DataFrame:
    text = F.concat(*[F.lpad(F.hex(w.cast("bigint")), 4, "0") for w in words])
    place = F.col("cycle") * 32 + F.col("k")
    return df.select(
        F.lit(session).alias("session_id"), (place + 1).alias("sequence"), (F.col("cycle") * 1_000_000 + F.col("k") * 1000 + delay_us).alias("ts_us"),
        F.lit(iface).alias("iface"), arb_id.cast("bigint").alias("arb_id"), F.lit(False).alias("is_extended"), F.lit(False).alias("remote"),
        F.lit(8).alias("dlc"), F.unhex(text).alias("data"),
    )


def battery_capture(spark: SparkSession, cycles: int, session: str = "s") -> dict[str, DataFrame]:
    """``internal``: three cells per frame of ids 0x460 to 0x47F. ``hv``: three slots per frame, eight banks on each of four ids."""
    rows = spark.range(cycles * 32).selectExpr("id div 32 AS cycle", "id % 32 AS k")
    first = F.col("k") * PER_FRAME
    internal = [_raw(first + i) for i in (1, 2, 3)] + [F.lit(0)]
    a, b, c = (_raw(_cell_in(first + i)) for i in (1, 2, 3))
    hv = [a * 2, b * 2, c * 16, F.col("k") % 8 * 8192]
    return {
        "internal": _frame(rows, session, "slow", F.col("k") + 0x460, 0, internal),
        "hv": _frame(rows, session, "fast", F.floor(F.col("k") / 8) * 2 + 0x200, 70_000, hv),
    }


def internal_registry(spark: SparkSession) -> DataFrame:
    """Signal definitions of the internal frames: 12 bits in each 16-bit word."""
    cell = F.col("id") + 1
    return spark.range(CELLS).select(
        F.lit("test").alias("source"), F.lit("internal").alias("network"), F.lit(125).alias("bitrate_kbps"),
        (F.expr("id div 3") + 0x460).alias("can_id"), F.lit("Cells").alias("message"), F.format_string("Cell_%02d", cell).alias("signal"),
        (F.col("id") % 3 * 16 + 3).cast("int").alias("start_bit"), F.lit(12).alias("length"), F.lit("motorola").alias("endian"), F.lit(False).alias("signed"),
        F.lit(0.00125).alias("scale"), F.lit(0.0).alias("offset"), F.lit("V").alias("unit"), F.lit("test").alias("confidence"), F.lit("").alias("notes"),
    )
