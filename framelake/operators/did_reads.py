"""First-in first-out pairing of identifier reads, without holding a key's queue in one task.

With requests of a key numbered 1, 2, .. in completion order, the queue is always "all requests after number h".
A response that follows A requests, of which E are too old and G are not later than it, maps h to

    max(h, E) + 1   when h < G and E < G (that request is the match)
    A               otherwise (every waiting request was discarded)

Such maps are closed under composition: each is "x < T ? max(x + k, b) : C". So a chunk of responses folds to four
numbers, the numbers of a key's chunks chain to the h at the start of each chunk, and the chunks then run apart.

That needs request times that do not decrease in completion order, as in a capture. Keys where they do are found first
and go through a queue in order, one pass over the sorted rows of the key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.bits import byte_at
from framelake.operators.isotp import SEQUENCE_CHUNK
from framelake.plans.ordered import CHUNK_US, Carry, counts_until, running
from framelake.session import cut_lineage

KEY = ["session_id", "channel", "did"]
BIG = 1 << 60

_FOLD = "session_id string, channel string, did int, chunk bigint, k bigint, b bigint, t bigint, c bigint"
_START = "session_id string, channel string, did int, chunk bigint, h bigint"
_MATCH = "session_id string, channel string, did int, sequence bigint, number bigint"


def _compose(left: tuple, right: tuple) -> tuple:
    k1, b1, t1, c1 = left
    k2, b2, t2, c2 = right
    k, b = k1 + k2, max(b1 + k2, b2)
    if c1 >= t2:
        return k, b, (min(t1, t2 - k1) if b1 < t2 else -1), c2
    return k, b, t1, max(c1 + k2, b2)


def _step(row) -> tuple:
    return 1, row.old + 1, (row.good if row.old < row.good else -1), row.asked


def _fold_chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    state = (0, -BIG, BIG, BIG)
    for row in rows.sort_values("sequence").itertuples(index=False):
        state = _compose(state, _step(row))
    return pd.DataFrame([(*key, *state)], columns=["session_id", "channel", "did", "chunk", "k", "b", "t", "c"])


def _chain(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
    h, out = 0, []
    for row in chunks.sort_values("chunk").itertuples(index=False):
        out.append((*key, row.chunk, h))
        h = max(h + row.k, row.b) if h < row.t else row.c
    return pd.DataFrame(out, columns=["session_id", "channel", "did", "chunk", "h"])


def _run_chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    h, out = int(rows["h"].iloc[0]), []
    for row in rows.sort_values("sequence").itertuples(index=False):
        _, b, t, c = _step(row)
        if h < t:
            h = max(h + 1, b)
            out.append((*key[:3], row.sequence, h))
        else:
            h = c
    return pd.DataFrame(out, columns=["session_id", "channel", "did", "sequence", "number"])


def _run_queue(window_us: int):
    """Matches of keys in completion order by the queue itself; only the waiting requests of one key are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in zip(*(pdf[c] for c in [*KEY, "sequence", "ts_us", "is_request"])))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:3]):
            waiting: deque[tuple[int, int]] = deque()
            asked = 0
            for *_, sequence, ts, is_request in group:
                if is_request:
                    asked += 1
                    waiting.append((asked, ts))
                    continue
                while waiting:
                    number, asked_at = waiting.popleft()
                    if 0 <= ts - asked_at <= window_us:
                        out.append((*key, sequence, number))
                        break
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=[*KEY, "sequence", "number"])
                    out = []
        yield pd.DataFrame(out, columns=[*KEY, "sequence", "number"])

    return run


def _stepping_back(requests: DataFrame) -> DataFrame:
    """Keys with the number of requests (sequence, ts_us, chunk) that are earlier than the one before them."""
    before = running(requests, KEY, ["sequence"], {"before": Carry("last", F.col("ts_us"), inclusive=False)}, ["chunk"])
    return before.where("before > ts_us").groupBy(*KEY).agg(F.count("*").alias("steps_back"))


def _numbered(rows: DataFrame, window_us: int, chunk: int, chunk_us: int) -> tuple[DataFrame, DataFrame]:
    """Requests with their number, and responses with (asked, old, good) counts."""
    asked = running(
        rows.withColumn("chunk", F.expr(f"sequence div {chunk}")), KEY, ["sequence"],
        {"asked": Carry("sum", F.col("is_request").cast("bigint"))}, ["chunk"],
    )
    requests = asked.where("is_request").select(*KEY, F.col("asked").alias("number"), F.col("ts_us").alias("request_us"), F.hex("payload").alias("request_payload"))
    responses = asked.where("NOT is_request").select(*KEY, "chunk", "sequence", "ts_us", "payload", "asked")
    # "request before t - window" and "request not after t"
    asked_at, answers = rows.where("is_request"), rows.where("NOT is_request")
    probes = answers.select(*KEY, "sequence", F.col("ts_us") - window_us, F.lit(0)).toDF(*KEY, "sequence", "ts_us", "which").unionByName(
        answers.select(*KEY, "sequence", "ts_us", F.lit(1).alias("which"))
    )
    seen = counts_until(asked_at, probes, KEY, ["sequence", "which"], width_us=chunk_us)
    counts = seen.groupBy(*KEY, "sequence").agg(
        F.max(F.when(F.col("which") == 0, F.col("before"))).alias("old"), F.max(F.when(F.col("which") == 1, F.col("upto"))).alias("good")
    )
    joined = responses.join(counts, [*KEY, "sequence"]).select(
        *KEY, "chunk", "sequence", "ts_us", "payload", "asked",
        F.least("old", "asked").alias("old"), F.least("good", "asked").alias("good"),
    )
    return requests, joined


def pair_did_reads(
    messages: DataFrame,
    tx: int = 0x7E4,
    rx: int = 0x7EC,
    window_us: int = 2_000_000,
    chunk: int = SEQUENCE_CHUNK,
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """Service 0x22 requests with their 0x62 responses per (channel, identifier).

    A response takes the first waiting request that is at most ``window_us`` older and not later than it; requests it
    passes over are gone. Keys whose request times never decrease in completion order are cut into chunks; the others,
    which :func:`unordered_requests` lists, are each read once in order.
    """
    p = F.col("payload")
    n = F.length(p)
    asks = (F.col("arb_id") == tx) & (n >= 3) & (byte_at(p, 0) == 0x22)
    answers = (F.col("arb_id") == rx) & (n >= 3) & (byte_at(p, 0) == 0x62)
    rows = messages.where(asks | answers).select(
        "session_id", F.col("iface").alias("channel"), (byte_at(p, 1) * 256 + byte_at(p, 2)).alias("did"),
        F.col("completion_seq").alias("sequence"), "ts_us", "payload", asks.alias("is_request"),
    )
    rows = cut_lineage(rows)  # a small part of all messages, read by the numbering and by the counts
    back = cut_lineage(_stepping_back(rows.where("is_request").select(*KEY, "sequence", "ts_us", F.expr(f"sequence div {chunk}").alias("chunk"))).select(*KEY))
    stepped = rows.join(back, KEY, "left_semi")
    requests, responses = _numbered(rows, window_us, chunk, chunk_us)
    responses = cut_lineage(responses)  # read by the fold, by the run and for the output
    even = responses.join(back, KEY, "left_anti")
    folded = even.select(*KEY, "chunk", "sequence", "asked", "old", "good").groupBy(*KEY, "chunk").applyInPandas(_fold_chunk, _FOLD)
    starts = folded.groupBy(*KEY).applyInPandas(_chain, _START)
    matched = (
        even.join(starts, [*KEY, "chunk"])
        .select(*KEY, "chunk", "sequence", "asked", "old", "good", "h")
        .groupBy(*KEY, "chunk")
        .applyInPandas(_run_chunk, _MATCH)
    )
    in_order = stepped.repartition(*KEY).sortWithinPartitions(*KEY, "sequence").mapInPandas(_run_queue(window_us), _MATCH)
    matched = matched.unionByName(in_order)
    answered = matched.join(responses.select(*KEY, "sequence", "ts_us", "payload"), [*KEY, "sequence"])
    return answered.join(requests, [*KEY, "number"]).select(
        "session_id",
        "channel",
        F.concat(F.lit("0x"), F.lpad(F.hex("did"), 4, "0")).alias("did"),
        (F.col("request_us") / 1e6).alias("request_ts"),
        (F.col("ts_us") / 1e6).alias("response_ts"),
        ((F.col("ts_us") - F.col("request_us")) / 1000.0).alias("latency_ms"),
        "request_payload",
        F.hex("payload").alias("response_payload"),
        F.hex(F.substr("payload", F.lit(4))).alias("data"),
        F.col("sequence").alias("completion_seq"),
    )


def unordered_requests(messages: DataFrame, tx: int = 0x7E4, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Keys whose request times decrease somewhere in completion order."""
    p = F.col("payload")
    rows = messages.where((F.col("arb_id") == tx) & (F.length(p) >= 3) & (byte_at(p, 0) == 0x22)).select(
        "session_id", F.col("iface").alias("channel"), (byte_at(p, 1) * 256 + byte_at(p, 2)).alias("did"),
        F.col("completion_seq").alias("sequence"), "ts_us", F.expr(f"completion_seq div {chunk}").alias("chunk"),
    )
    return _stepping_back(rows)
