"""ISO-TP reassembly as windows over sequence chunks, without a Python worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.bits import byte_at

KEY = ["session_id", "iface", "arb_id"]
SEQUENCE_CHUNK = 1_000_000


def _single_frames(frames: DataFrame) -> DataFrame:
    n = byte_at(F.col("data"), 0)
    ok = n.between(1, 15) & (F.length("data") > n)
    return frames.where(ok).select(
        *KEY, "ts_us", F.col("sequence").alias("completion_seq"), F.substr("data", F.lit(2), n).alias("payload")
    )


def _segments(frames: DataFrame, chunk: int) -> DataFrame:
    """First and consecutive frames numbered inside (key, sequence chunk).

    ``seg`` counts first frames, so segment 0 continues a message of an earlier chunk. Per row: consecutive frames
    and bytes of the segment so far, and the range of (wire sequence - index) mod 16, which is one constant while
    no frame is missing.
    """
    first = F.col("data")
    b0, b1 = byte_at(first, 0), byte_at(first, 1)
    pci = F.call_function("shiftright", b0, F.lit(4))
    total = b0.bitwiseAND(15) * 256 + b1
    rows = (
        frames.where("length(data) > 0")
        .select(*KEY, "ts_us", "sequence", "data", pci.alias("pci"), total.alias("total"), b0.bitwiseAND(15).alias("wire"))
        .where("(pci = 1 AND length(data) >= 2 AND total > 6) OR pci = 2")
        .selectExpr(
            *KEY,
            "ts_us",
            "sequence",
            f"sequence div {chunk} AS chunk",
            "pci = 1 AS is_first",
            "total",
            "wire",
            "hex(if(pci = 1, substring(data, 3), substring(data, 2))) AS part",
        )
    )
    part = f"{', '.join(KEY)}, chunk"
    in_chunk = f"PARTITION BY {part} ORDER BY sequence ROWS UNBOUNDED PRECEDING"
    in_seg = f"PARTITION BY {part}, seg ORDER BY sequence ROWS UNBOUNDED PRECEDING"
    return (
        rows.selectExpr("*", f"sum(int(is_first)) OVER ({in_chunk}) AS seg")
        .selectExpr(
            "*",
            f"sum(int(NOT is_first)) OVER ({in_seg}) AS idx",
            f"sum(length(part) div 2) OVER ({in_seg}) AS bytes",
            f"first_value(if(is_first, struct(ts_us, total, sequence), NULL)) OVER ({in_seg}) AS head",
        )
        .withColumn("drift", F.expr("if(is_first, NULL, pmod(wire - idx, 16))"))
        .selectExpr("*", f"min(drift) OVER ({in_seg}) AS dmin", f"max(drift) OVER ({in_seg}) AS dmax")
    )


def _carried(segments: DataFrame) -> DataFrame:
    """State at the start of each chunk: the open message, its frames and bytes so far, and whether it is intact."""
    # "part" is only named here so that this branch shuffles the same columns as the main one and reuses its exchange
    last = segments.groupBy(*KEY, "chunk").agg(
        F.max_by(F.struct("seg", "idx", "bytes", "head", "dmin", "dmax", "part"), "sequence").alias("s")
    ).where("s.part IS NOT NULL")
    keyed = f"PARTITION BY {', '.join(KEY)} ORDER BY chunk"
    # a chunk with a first frame restarts the state; chunks without one add to it
    grouped = last.selectExpr(
        *KEY, "chunk", "s.*", f"sum(int(s.seg > 0)) OVER ({keyed} ROWS UNBOUNDED PRECEDING) AS era"
    )
    era = f"PARTITION BY {', '.join(KEY)}, era ORDER BY chunk"
    summed = grouped.selectExpr(
        "*",
        f"sum(idx) OVER ({era} ROWS UNBOUNDED PRECEDING) AS idx_end",
        f"sum(bytes) OVER ({era} ROWS UNBOUNDED PRECEDING) AS bytes_end",
        f"first_value(head) OVER ({era} ROWS UNBOUNDED PRECEDING) AS head_end",
    ).withColumn(
        "intact",
        F.expr("idx = 0 OR (dmin = dmax AND dmin = if(seg > 0, 0, pmod(idx_end - idx, 16)))"),
    )
    ended = summed.selectExpr("*", f"min(intact) OVER ({era} ROWS UNBOUNDED PRECEDING) AS intact_end")
    back = f"lag(struct(idx_end, bytes_end, head_end, intact_end)) OVER ({keyed})"
    return ended.selectExpr(*KEY, "chunk", f"{back} AS c").where("c.head_end IS NOT NULL")


def reassemble_isotp(frames: DataFrame, check_seq: bool = True, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Messages per (session, interface, id) in file order, stamped with the time of their first frame.

    A single frame stands alone and leaves an open message alone; a first frame replaces it; a first frame of at
    most six bytes is ignored; with ``check_seq`` a wrong sequence number ends the open message.
    """
    segments = _segments(frames, chunk)
    joined = segments.join(_carried(segments), [*KEY, "chunk"], "left").selectExpr(
        *KEY,
        "sequence",
        "part",
        "coalesce(head, c.head_end) AS head",
        "if(seg = 0, coalesce(c.bytes_end, 0), 0) + bytes AS upto",
        "(idx = 0 OR (dmin = dmax AND dmin = if(seg = 0, pmod(coalesce(c.idx_end, 0), 16), 0))) "
        "AND (seg > 0 OR coalesce(c.intact_end, true)) AS intact",
    )
    used = joined.where("head IS NOT NULL AND upto - length(part) div 2 < head.total")
    if check_seq:
        used = used.where("intact")
    # every row kept here adds at least one of at most 4,095 bytes, or is empty and dropped
    whole = (
        used.where("length(part) > 0")
        .groupBy(*KEY, F.col("head.sequence").alias("first_seq"), F.col("head.ts_us").alias("ts_us"), F.col("head.total").alias("total"))
        .agg(
            F.max("upto").alias("upto"),
            F.max("sequence").alias("completion_seq"),
            F.array_sort(F.collect_list(F.struct("sequence", "part"))).alias("parts"),
        )
        .where("upto >= total")
        .selectExpr(
            *KEY,
            "ts_us",
            "completion_seq",
            "unhex(substring(array_join(transform(parts, p -> p.part), ''), 1, 2 * total)) AS payload",
        )
    )
    return _single_frames(frames).unionByName(whole)
