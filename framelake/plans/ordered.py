"""Order-dependent computation that never needs one task per key.

A window over a whole key puts that key into one task, and one CAN id can hold a third of a corpus. Here a key
is cut into time chunks: the window runs inside (key, chunk), each chunk leaves a one-row summary, and a second,
tiny window over the summaries carries state from chunk to chunk. A bus has a bounded frame rate, so a chunk has
a bounded size, and the summaries of a key are bounded by its time span divided by the chunk width.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
CHUNK_US = HOUR_US


def chunk_of(ts_us: Column | str, width_us: int = CHUNK_US) -> Column:
    """Chunk number of a microsecond time; floor division, so also monotone before 1970."""
    ts = F.col(ts_us) if isinstance(ts_us, str) else ts_us
    return F.floor(ts / F.lit(width_us)).cast("bigint")


def place(ts: str = "ts_us", pos: str = "sequence") -> Column:
    """(time, position) as one ordered DECIMAL, so that min/max and min_by/max_by keep fixed-size hash buffers."""
    scale = F.lit("10000000000000000000").cast("decimal(20,0)")
    return (F.col(ts).cast("decimal(18,0)") * scale + F.col(pos).cast("decimal(19,0)")).cast("decimal(38,0)")


_FOLDS = {"sum": F.sum, "xor": F.bit_xor}


@dataclass(frozen=True)
class Carry:
    """One running value: ``kind`` is ``sum``, ``xor`` or ``last`` (last non-null)."""

    kind: str
    expr: Column
    inclusive: bool = True


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, Carry],
    chunks: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Append running values per key in ``order``.

    ``chunks`` names columns, coarse to fine, that never decrease along ``order``; state crosses chunk borders
    through per-chunk summaries, one level per chunk column. Keys and chunks must not be null. ``tasks`` sets how many
    tasks order the rows.
    """
    chunks = list(chunks)
    part = [*keys, *chunks]
    if tasks:
        df = df.repartition(tasks, *part)
    base = Window.partitionBy(*part).orderBy(*order)
    frames = {
        True: base.rowsBetween(Window.unboundedPreceding, 0),
        False: base.rowsBetween(Window.unboundedPreceding, -1),
    }

    def local(spec: Carry) -> Column:
        if spec.kind in _FOLDS:
            return F.coalesce(_FOLDS[spec.kind](spec.expr).over(frames[spec.inclusive]), F.lit(0).cast("bigint"))
        return F.last(spec.expr, ignorenulls=True).over(frames[spec.inclusive])

    inside = df.select("*", *[local(spec).alias(name) for name, spec in specs.items()])
    if not chunks:
        return inside

    place = F.struct(*[F.col(c) for c in order])
    # "last" summaries read the chunk's final row only; sums combine map-side.
    per_chunk = df.groupBy(*part).agg(
        *[
            (
                F.coalesce(_FOLDS[spec.kind](spec.expr), F.lit(0).cast("bigint"))
                if spec.kind in _FOLDS
                else F.max_by(spec.expr, F.when(spec.expr.isNotNull(), place))
            ).alias(f"_s_{name}")
            for name, spec in specs.items()
        ]
    )
    carried = running(
        per_chunk,
        keys,
        [chunks[-1]],
        {f"_c_{name}": Carry(spec.kind, F.col(f"_s_{name}"), inclusive=False) for name, spec in specs.items()},
        chunks[:-1],
    ).drop(*[f"_s_{name}" for name in specs])
    joined = inside.join(carried, part, "left")

    def merged(name: str, spec: Carry) -> Column:
        if spec.kind in _FOLDS:
            before = F.coalesce(F.col(f"_c_{name}"), F.lit(0).cast("bigint"))
            return (F.col(name) + before if spec.kind == "sum" else F.col(name).bitwiseXOR(before)).alias(name)
        return F.coalesce(F.col(name), F.col(f"_c_{name}")).alias(name)

    return joined.select(*df.columns, *[merged(name, spec) for name, spec in specs.items()])


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunks: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """Append ``prev`` = struct of ``values`` of the previous row of the key (null on the first row)."""
    row = F.struct(*[F.col(v) for v in values])
    return running(df, keys, order, {"prev": Carry("last", row, inclusive=False)}, chunks, tasks)


def gaps(df: DataFrame, keys: Sequence[str], t: str, width_us: int, unit_us: int = 1) -> DataFrame:
    """Successive time differences per key in ``t`` order, as rows (keys, gap).

    The gaps inside chunks and the gaps between neighbouring chunks together are all gaps of the key, so nothing
    is joined back. ``unit_us`` is the length of one unit of ``t`` in microseconds.
    """
    base = df.select(*keys, F.col(t).alias("_t")).withColumn("_chunk", chunk_of(F.col("_t") * unit_us, width_us))
    part = [*keys, "_chunk"]
    in_chunk = Window.partitionBy(*part).orderBy("_t")
    # both branches below read the same three columns, so Spark shuffles once and reuses the exchange
    placed = base.select(
        *part, "_t", F.lag("_t").over(in_chunk).alias("_before"), F.lead("_t").over(in_chunk).alias("_after")
    )
    inner = placed.where("_before IS NOT NULL").select(*keys, (F.col("_t") - F.col("_before")).alias("gap"))
    edges = placed.where("_before IS NULL OR _after IS NULL").groupBy(*part).agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi")
    )
    keyed = Window.partitionBy(*keys).orderBy("_chunk") if keys else Window.orderBy("_chunk")
    outer = edges.select(*keys, (F.col("_lo") - F.lag("_hi").over(keyed)).alias("gap"))
    return inner.unionByName(outer.where("gap IS NOT NULL"))


def counts_until(
    points: DataFrame, probes: DataFrame, keys: Sequence[str], ident: Sequence[str], t: str = "ts_us", width_us: int = CHUNK_US
) -> DataFrame:
    """Per probe: ``before`` = points of its keys earlier than its time, ``upto`` = points not later than it.

    Two ordered counts instead of a join of all pairs. ``ident`` identifies a probe.
    """
    nothing = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in ident]
    marks = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), *nothing)
    for side in (0, 2):
        marks = marks.unionByName(probes.select(*keys, F.col(t).alias("_t"), F.lit(side).alias("_side"), *ident))
    counted = running(
        marks.withColumn("_chunk", chunk_of("_t", width_us)), keys, ["_t", "_side"],
        {"_seen": Carry("sum", (F.col("_side") == 1).cast("bigint"))}, ["_chunk"],
    )
    at = lambda side: F.max(F.when(F.col("_side") == side, F.col("_seen")))
    return counted.where("_side != 1").groupBy(*keys, *ident).agg(at(0).alias("before"), at(2).alias("upto"))
