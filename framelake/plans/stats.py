"""Statistics that stay exact and distributed for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import cut_lineage


def pearson(x: Column, y: Column) -> Column:
    """Pearson r of an aggregate; 0.0 when either side is constant (``corr`` would raise under ANSI)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def _bucket(v: Column) -> Column:
    """Monotone log-linear bucket of a value >= 0: 256 steps per power of two, about 16,000 in all for 64 bits."""
    e = F.floor(F.log2(v))
    step = F.floor((v / F.pow(F.lit(2.0), e) - 1) * 256)
    return F.when(v > 0, e * 256 + step).otherwise(F.lit(-1_000_000)).cast("bigint")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of non-negative values per key, the mean of the middle pair for even counts.

    ``median`` keeps all distinct values of a key in one buffer. Here equal values are counted first (map-side),
    a histogram with a bounded number of buckets finds the buckets of the middle ranks, and only those buckets
    are ordered by value. The counts are read twice, so they are written to the checkpoint folder first.
    """
    keys = list(keys)
    counts = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_b", _bucket(F.col("_v")))
    )
    hist = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.select(
        *keys, "_b", (F.sum("_bn").over(upto) - F.col("_bn")).alias("_before"), "_bn", F.sum("_bn").over(whole).alias("_all")
    )
    low_rank = F.floor((F.col("_all") - 1) / F.lit(2)).cast("bigint")
    high_rank = F.floor(F.col("_all") / F.lit(2)).cast("bigint")

    def holds(rank: Column, start: Column, n: Column) -> Column:
        return (start <= rank) & (rank < start + n)

    middle = ranked.where(
        holds(low_rank, F.col("_before"), F.col("_bn")) | holds(high_rank, F.col("_before"), F.col("_bn"))
    ).drop("_bn")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(middle, [*keys, "_b"]).select(
        *keys, "_v", "_n", "_all", (F.col("_before") + F.sum("_n").over(inside) - F.col("_n")).alias("_start")
    )
    weight = holds(low_rank, F.col("_start"), F.col("_n")).cast("int") + holds(
        high_rank, F.col("_start"), F.col("_n")
    ).cast("int")
    return placed.groupBy(*keys).agg((F.sum(F.col("_v") * weight) / 2).alias(out))
