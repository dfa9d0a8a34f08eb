"""Pairing of live diagnostic messages over whole captures: open requests carried over time chunks, no key in one task.

The requests that are open on a (session, channel, request id, service) are a map from identifier to time. A response
takes the request of its own identifier, else one without identifier; a response without identifier takes the one
without, else the latest. A final response closes what it takes. Three kinds of keys need three amounts of state:

* Services without identifiers have one open request at most. Whether the last request or final response before a row
  is a request tells all: a running "last" over chunks.
* Where every request carries an identifier and request times do not step back, a chunk acts on the requests that were open before it by a short list of
  steps: "identifier d is taken or asked again" and "the latest k are closed", each identifier once. The lists of a
  key's chunks are applied one after the other, and then the chunks run apart, each from its own start.
* Elsewhere later rows depend on earlier ones in every way; such a key is read once in order, with only its map in
  memory.

Messages are taken in completion order (``sequence``), while a request's age is that of its first frame (``ts_us``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.isotp import SEQUENCE_CHUNK, reassemble_isotp
from framelake.plans.ordered import Carry, running
from framelake.session import cut_lineage
from framelake.streaming.state import PENDING, PendingRequests

KEY = ["session_id", "channel", "request_id", "service"]
#: Services whose messages carry an identifier.
WITH_IDENTIFIER = (0x22, 0x2E)
PAIRED = ["session_id", "channel", "request_id", "ts_us", "sequence", "role", "service", "did", "nrc", "latency_ms"]
_KEYS = "session_id string, channel string, request_id bigint, service int"
_ROWS = _KEYS + ", ts_us bigint, sequence bigint, latency_ms double"
_OPEN = "array<struct<did:int,ts_us:bigint>>"


def _events(rows: pd.DataFrame) -> Iterator[tuple]:
    """(ts, sequence, is request, identifier or None, final) in order."""
    ordered = rows.sort_values("sequence", kind="stable")
    for ts, seq, role, did, nrc in zip(ordered["ts_us"], ordered["sequence"], ordered["role"], ordered["did"], ordered["nrc"]):
        yield int(ts), seq, role == "request", None if pd.isna(did) else int(did), pd.isna(nrc) or int(nrc) != PENDING


def chunk_steps(events: Iterator[tuple]) -> tuple[list[int], list[tuple[int, int]]]:
    """What a chunk does to the requests open before it, and those it leaves open itself (identifier, time).

    Steps are an identifier that leaves the map, or -k for the k latest that do. All requests carry identifiers.
    """
    steps: list[int] = []
    gone: set[int] = set()
    own = PendingRequests()
    for ts, _, asks, did, final in events:
        if asks:
            if did not in gone and (0, did) not in own.open:
                steps.append(did)
                gone.add(did)
            own.push("request", ts, 0, did, None)
        elif did is None:
            if own.open:
                own.push("response", ts, 0, None, None if final else PENDING)
            elif final:
                if steps and steps[-1] < 0:
                    steps[-1] -= 1
                else:
                    steps.append(-1)
        elif (0, did) in own.open:
            own.push("response", ts, 0, did, None if final else PENDING)
        elif final and did not in gone:
            steps.append(did)
            gone.add(did)
    return steps, [(k[1], ts) for k, ts in own.open.items()]


def apply_steps(open_: dict[int, int], steps: Sequence[int]) -> None:
    """Runs the steps of a chunk on the requests open before it; among equal times the smaller identifier is the later one."""
    for step in steps:
        if step >= 0:
            open_.pop(step, None)
        else:
            for _ in range(min(-step, len(open_))):
                del open_[max(open_, key=lambda d: (open_[d], -d))]


def _summaries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    steps, left = chunk_steps(_events(rows))
    return pd.DataFrame({**dict(zip([*KEY, "chunk"], [[k] for k in key])), "steps": [steps], "left": [[{"did": d, "ts_us": t} for d, t in left]]})


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The requests open at the start of each chunk; summaries come sorted by key and chunk."""
    now, open_ = None, {}
    for pdf in batches:
        out = []
        for *key, chunk, steps, left in zip(*(pdf[c] for c in [*KEY, "chunk", "steps", "left"])):
            if key != now:
                now, open_ = key, {}
            out.append((*key, chunk, [{"did": d, "ts_us": t} for d, t in open_.items()]))
            apply_steps(open_, [int(x) for x in steps])
            open_.update((int(x["did"]), int(x["ts_us"])) for x in left)
        yield pd.DataFrame(out, columns=[*KEY, "chunk", "open"])


def _latencies(key: tuple, events: Iterator[tuple], machine: PendingRequests, service: int) -> Iterator[tuple]:
    for ts, seq, asks, did, final in events:
        yield *key, ts, seq, machine.push("request" if asks else "response", ts, service, did, None if final else PENDING)


def _run_chunk(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    names = [*KEY, "ts_us", "sequence", "latency_ms"]
    if not len(rows):
        return pd.DataFrame(columns=names)
    service = int(key[3])
    before = {(service, x["did"]): x["ts_us"] for held in starts["open"] for x in held}
    return pd.DataFrame(list(_latencies(key[:4], _events(rows), PendingRequests(before), service)), columns=names)


def _run_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (r for pdf in batches for r in zip(*(pdf[c] for c in [*KEY, "ts_us", "sequence", "role", "did", "nrc"])))
    held: list[tuple] = []
    for key, group in groupby(rows, key=lambda r: r[:4]):
        machine = PendingRequests()
        for r in group:
            did, nrc = (None if pd.isna(x) else int(x) for x in r[7:9])
            held.append((*key, r[4], r[5], machine.push(r[6], int(r[4]), int(key[3]), did, nrc)))
            if len(held) >= 10_000:
                yield pd.DataFrame(held, columns=[*KEY, "ts_us", "sequence", "latency_ms"])
                held = []
    yield pd.DataFrame(held, columns=[*KEY, "ts_us", "sequence", "latency_ms"])


def pair_messages(messages: DataFrame, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Endpoint messages (see ``streaming.ops.endpoint_messages``) with the latency of responses that answer an open request.

    ``sequence`` must tell the messages of a key apart. Requests are null in latency, and so are responses that nothing
    was open for. responsePending keeps its request open. Of requests of one time the one with the smaller identifier
    counts as the later.
    """
    rows = cut_lineage(messages.select(*PAIRED[:-1], F.expr(f"sequence div {chunk}").alias("chunk")))
    final = F.col("nrc").isNull() | (F.col("nrc") != PENDING)
    asks = F.col("role") == "request"

    single = rows.where(~F.col("service").isin(*WITH_IDENTIFIER))
    state = F.when(asks, F.struct(F.col("ts_us").alias("asked"))).when(final, F.struct(F.lit(None).cast("bigint").alias("asked")))
    tagged = running(single, KEY, ["sequence"], {"_open": Carry("last", state, inclusive=False)}, ["chunk"])
    alone = tagged.select(*PAIRED[:-1], F.when(~asks, (F.col("ts_us") - F.col("_open.asked")) / 1000.0).alias("latency_ms"))

    several = rows.where(F.col("service").isin(*WITH_IDENTIFIER))
    asked = running(several.where(asks), KEY, ["sequence"], {"_p": Carry("last", F.struct("ts_us", "chunk"), inclusive=False)}, ["chunk"])
    steps_back = (F.col("_p.ts_us") > F.col("ts_us")) | ((F.col("_p.ts_us") == F.col("ts_us")) & (F.col("_p.chunk") != F.col("chunk")))
    whole = cut_lineage(asked.where(F.col("did").isNull() | steps_back).select(*KEY).distinct())
    named = several.join(whole, KEY, "left_anti")
    folded = cut_lineage(named.groupBy(*KEY, "chunk").applyInPandas(_summaries, f"{_KEYS}, chunk bigint, steps array<int>, left {_OPEN}"))
    starts = folded.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInPandas(_chain, f"{_KEYS}, chunk bigint, open {_OPEN}")
    grouped = [*KEY, "chunk"]
    ran = named.groupBy(*grouped).cogroup(starts.groupBy(*grouped)).applyInPandas(_run_chunk, _ROWS)
    mixed = several.join(whole, KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "sequence")
    ran = ran.unionByName(mixed.mapInPandas(_run_in_order, _ROWS))
    back = several.join(ran.drop("ts_us"), [*KEY, "sequence"]).select(*PAIRED)
    return alone.unionByName(back)


#: Fixed value: endpoints whose request id is below this one send their payloads unframed.
FRAMED_FROM = 0x700


def endpoint_payloads(frames: DataFrame, endpoints: DataFrame, chunk: int = SEQUENCE_CHUNK) -> DataFrame:
    """Payloads of the endpoints' frames: reassembled for ids of framed endpoints, the frame itself for the others.

    ``endpoints`` has (request_id, response_id), a short list of modules. Remote and empty frames carry nothing.
    """
    ids = F.inline(F.array(*[F.struct(F.col(c).alias("arb_id"), (F.col("request_id") >= FRAMED_FROM).alias("framed")) for c in ("request_id", "response_id")]))
    known = endpoints.select("request_id", "response_id").select("*", ids).groupBy("arb_id").agg(F.max("framed").alias("framed"))
    used = frames.join(known, "arb_id").where(~F.col("remote") & (F.length("data") > 0))
    columns = ["session_id", "iface", "arb_id", "ts_us", "completion_seq", "payload"]
    whole = used.where(~F.col("framed")).select("session_id", "iface", "arb_id", "ts_us", F.col("sequence").alias("completion_seq"), F.col("data").alias("payload"))
    return reassemble_isotp(used.where("framed").drop("framed"), True, chunk).select(*columns).unionByName(whole.select(*columns))


def latest_messages(paired: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` messages of each session, newest first."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("sequence"))
    return paired.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)
