"""Time joins: nearest within a tolerance, backward as-of, and interval joins on time bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.plans.ordered import CHUNK_US, Carry, chunk_of, running

# tie rules: (is an equal time taken backward, order of duplicates backward, forward, which side wins a tie)
_RULES = {
    "first": (False, "asc", "desc", "forward"),
    "last": (True, "asc", "asc", "forward"),
    "earliest": (True, "desc", "desc", "backward"),
}


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    tol: int,
    values: Sequence[str],
    t: str = "ts_us",
    right_pos: str = "sequence",
    right_dup: str = "first",
    unit_us: int = 1,
    chunk_us: int = CHUNK_US,
    keep_unmatched: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Each left row with the nearest right row of the same ``by`` within ``tol`` (inclusive) units of ``t``.

    ``right_dup`` picks the tie rule. ``first``: a tie goes to the later sample; among equal times the first
    at/after the left time, the last before it. ``last``: a tie goes to the later sample and to the last of equal
    times. ``earliest``: a tie goes to the earlier sample and to the first of equal times.

    Both sides meet in (by, time chunk). Right rows near a chunk border are copied to the neighbour, so the
    tolerance never looks outside the chunk and no key is held by one task. ``tasks`` sets how many tasks order them.
    """
    equal_back, back_dup, fwd_dup, tie = _RULES[right_dup]
    width = max(chunk_us, 2 * tol * unit_us)
    lefts = left.select(
        *by,
        F.col(t).alias("_t"),
        F.lit(0 if not equal_back else 1).alias("_side"),
        F.lit(0).cast("bigint").alias("_pos"),
        F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(right.select(F.struct(F.col(t).alias("_rt"), *values)).schema[0].dataType).alias("_r"),
    ).withColumn("_chunk", chunk_of(F.col("_t") * unit_us, width))
    rights = right.select(
        *by,
        F.col(t).alias("_t"),
        F.lit(1 if not equal_back else 0).alias("_side"),
        F.col(right_pos).cast("bigint").alias("_pos"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"),
        F.struct(F.col(t).alias("_rt"), *[F.col(v) for v in values]).alias("_r"),
    ).select(
        "*",
        F.explode(
            F.sequence(chunk_of((F.col("_t") - tol) * unit_us, width), chunk_of((F.col("_t") + tol) * unit_us, width))
        ).alias("_chunk"),
    )
    both = lefts.unionByName(rights)
    if tasks:
        both = both.repartition(tasks, *by, "_chunk")

    def directed(column: str, direction: str) -> Column:
        return F.col(column).asc() if direction == "asc" else F.col(column).desc()

    part = Window.partitionBy(*by, "_chunk")
    span = (Window.unboundedPreceding, -1)
    back_w = part.orderBy(F.col("_t").asc(), F.col("_side").asc(), directed("_pos", back_dup)).rowsBetween(*span)
    fwd_w = part.orderBy(F.col("_t").desc(), F.col("_side").desc(), directed("_pos", fwd_dup)).rowsBetween(*span)
    picked = both.select(
        "_t",
        "_l",
        F.last("_r", ignorenulls=True).over(back_w).alias("_b"),
        F.last("_r", ignorenulls=True).over(fwd_w).alias("_f"),
    ).where("_l IS NOT NULL")
    db = F.when(F.col("_t") - F.col("_b._rt") <= tol, F.col("_t") - F.col("_b._rt"))
    df_ = F.when(F.col("_f._rt") - F.col("_t") <= tol, F.col("_f._rt") - F.col("_t"))
    forward_wins = (df_ <= db) if tie == "forward" else (df_ < db)
    hit = F.when(db.isNull(), F.when(df_.isNotNull(), F.col("_f"))).otherwise(
        F.when(F.coalesce(forward_wins, F.lit(False)), F.col("_f")).otherwise(F.col("_b"))
    )
    out = picked.select("_l", "_t", hit.alias("_hit"))
    if not keep_unmatched:
        out = out.where("_hit IS NOT NULL")
    return out.select(
        "_l.*", *[F.col(f"_hit.{v}").alias(v) for v in values], F.abs(F.col("_hit._rt") - F.col("_t")).alias("delta")
    )


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    t: str = "ts_us",
    left_pos: str = "sequence",
    right_pos: str = "sequence",
    chunk_us: int = CHUNK_US,
    unit_us: int = 1,
) -> DataFrame:
    """Each left row with the latest right row at or before it (null when there is none)."""
    row_type = right.select(F.struct(*values)).schema[0].dataType
    left_type = left.select(F.struct(*left.columns)).schema[0].dataType
    lefts = left.select(
        *by, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.col(left_pos).cast("bigint").alias("_pos"),
        F.struct(*left.columns).alias("_l"), F.lit(None).cast(row_type).alias("_r"),
    )
    rights = right.select(
        *by, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.col(right_pos).cast("bigint").alias("_pos"),
        F.lit(None).cast(left_type).alias("_l"), F.struct(*values).alias("_r"),
    )
    both = lefts.unionByName(rights).withColumn("_chunk", chunk_of(F.col("_t") * unit_us, chunk_us))
    done = running(both, by, ["_t", "_side", "_pos"], {"_hit": Carry("last", F.col("_r"))}, ["_chunk"])
    return done.where("_l IS NOT NULL").select("_l.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def interval_join(
    points: DataFrame,
    windows: DataFrame,
    lo: Column,
    hi: Column,
    t: str = "ts_us",
    on: Sequence[str] = (),
    closed: bool = False,
    bin_us: int = CHUNK_US,
    salts: int = 4,
) -> DataFrame:
    """Points inside windows: lo <= t < hi, or <= hi when ``closed``.

    Both sides get a time bin as equi key, so this is a hash or sort-merge join, never a nested loop. Points of
    one bin are spread over ``salts`` and the (smaller) window side is repeated for each salt.
    """
    low, high = F.col("_lo"), F.col("_hi")
    bins = F.sequence(chunk_of(low, bin_us), chunk_of(high, bin_us))
    spread = (
        windows.select("*", lo.alias("_lo"), hi.alias("_hi"))
        .where(low <= high)
        .select("*", F.explode(bins).alias("_bin"))
        .select("*", F.explode(F.array(*[F.lit(s) for s in range(salts)])).alias("_salt"))
    )
    keyed = points.select(
        "*",
        chunk_of(t, bin_us).alias("_bin"),
        F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(salts)).cast("int").alias("_salt"),
    )
    inside = (F.col(t) >= low) & ((F.col(t) <= high) if closed else (F.col(t) < high))
    return keyed.join(spread, [*on, "_bin", "_salt"]).where(inside).drop("_bin", "_salt", "_lo", "_hi")
