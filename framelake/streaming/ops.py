"""Structured Streaming operators over frames.

The live original has no watermark and takes frames in arrival order. Here windows close by a watermark, and the
keyed operators order each micro-batch by (time, sequence): a key's frames must not arrive later than a batch
that already holds newer ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from framelake import schemas
from framelake.functions.bits import byte_at
from framelake.functions.services import SERVICES, positive_map, request_of_positive
from framelake.operators.correlation import _phase_counts, bits_of_points, candidates_from_counts, piece_bit_counts
from framelake.operators.decode import CELL_COUNT, bicm_slot
from framelake.plans.ordered import CHUNK_US
from framelake.plans.timejoin import asof_backward
from framelake.sources.candump import frame_columns
from framelake.streaming.state import CellsProcessor, DiagPairProcessor, IsoTpProcessor

MESSAGES = "session_id string, iface string, arb_id bigint, ts_us bigint, completion_seq bigint, payload binary"
#: Groups that the keys of the reassembly are dealt to.
ISOTP_BUCKETS = 512
PAIRS = (
    "session_id string, channel string, request_id bigint, ts_us bigint, sequence bigint, role string, service int, "
    "did int, nrc int, latency_ms double"
)


def stream_frames(spark: SparkSession, folder: str, fmt: str = "parquet", session_id: str = "live", files_per_batch: int = 1000) -> DataFrame:
    """Frames from a folder that grows: frame tables (parquet) or capture text.

    A text stream has no line numbers, so its sequence is the time: frames of one microsecond keep no order.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "parquet":
        return reader.schema(schemas.FRAMES).parquet(folder)
    text = reader.text(folder).select(F.trim("value").alias("value"))
    cols = frame_columns(F.col("value"), extended=True)
    parsed = text.select(F.lit(session_id).alias("session_id"), cols["ts_us"].alias("sequence"), *[c.alias(n) for n, c in cols.items()])
    return parsed.where("ts_us IS NOT NULL AND data IS NOT NULL").select(
        "session_id", "sequence", "ts_us", "iface", "arb_id", "is_extended", "remote", F.length("data").alias("dlc"), "data"
    )


def _timed(frames: DataFrame, watermark: str) -> DataFrame:
    out = frames.withColumn("event_time", F.timestamp_micros("ts_us"))
    return out.withWatermark("event_time", watermark) if frames.isStreaming else out


def frame_rate_1s(frames: DataFrame, watermark: str = "10 seconds", per_channel: bool = True) -> DataFrame:
    """Frames and distinct ids per second, by channel or in total; the ids of a second are a set bounded by the id space."""
    keys = [F.window("event_time", "1 second")] + ([F.col("iface")] if per_channel else [])
    return _timed(frames, watermark).groupBy(*keys).agg(
        F.count("*").alias("frames"), F.size(F.collect_set("arb_id")).alias("ids")
    ).select(F.unix_micros("window.start").alias("second_us"), *(["iface"] if per_channel else []), "frames", "ids")


def stream_distinct_ids(frames: DataFrame) -> DataFrame:
    """Each (session, interface, id) once; the state is bounded by the id space."""
    return frames.select("session_id", "iface", "arb_id").dropDuplicates()


def stream_isotp(frames: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Messages reassembled with sequence check; ``ttl_ms`` drops abandoned messages, which the original keeps.

    Keyed state is asked for once per group and batch, so keys share a fixed number of buckets; a checkpoint keeps that number.
    """
    key = ["session_id", "iface", "arb_id"]
    rows = frames.where("length(data) > 0").select(
        F.pmod(F.xxhash64(*key), F.lit(ISOTP_BUCKETS)).cast("int").alias("bucket"), F.to_json(F.struct(*key)).alias("key"), *key, "ts_us", "sequence", "data"
    )
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=IsoTpProcessor(ttl_ms), outputStructType=MESSAGES, outputMode="Append", timeMode=mode
    )


def endpoint_messages(messages: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Messages of known endpoints with role, service, identifier and negative response code.

    ``endpoints`` has (request_id, response_id), a short list of modules. Services that do not fit the role give no row.
    """
    ask = endpoints.select(F.col("request_id").alias("arb_id"), "request_id", F.lit("request").alias("role"))
    reply = endpoints.select(F.col("response_id").alias("arb_id"), "request_id", F.lit("response").alias("role"))
    joined = messages.join(ask.unionByName(reply), "arb_id")
    p = F.col("payload")
    sid = byte_at(p, 0)
    negative = (sid == 0x7F) & (F.length(p) >= 3)
    service = (
        F.when(negative, byte_at(p, 1))
        .when((F.col("role") == "request") & sid.isin(list(SERVICES)), sid)
        .when((F.col("role") == "response") & sid.isin(list(positive_map())), request_of_positive(sid))
    )
    carries_did = ~negative & service.isin(0x22, 0x2E) & (F.length(p) >= 3)
    return joined.select(
        "session_id", F.col("iface").alias("channel"), "request_id", "ts_us", F.col("completion_seq").alias("sequence"), "role",
        service.alias("service"), F.when(carries_did, byte_at(p, 1) * 256 + byte_at(p, 2)).alias("did"),
        F.when(negative, byte_at(p, 2)).alias("nrc"),
    ).where("service IS NOT NULL")


def stream_diag_pairs(messages: DataFrame, ttl_us: int | None = None, watermark: str = "10 seconds") -> DataFrame:
    """Endpoint messages with the latency of responses; responsePending keeps its request open.

    With ``ttl_us`` a request that waits longer than that in event time is dropped once the watermark has passed it, so
    state stays bounded; the original, and a call without it, keep requests until they are answered.
    """
    timed = messages if ttl_us is None else _timed(messages, watermark)
    return timed.groupBy("session_id", "channel", "request_id").transformWithStateInPandas(
        statefulProcessor=DiagPairProcessor(ttl_us), outputStructType=PAIRS, outputMode="Append", timeMode="None" if ttl_us is None else "EventTime"
    )


def stream_cells(frames: DataFrame) -> DataFrame:
    """Complete cell snapshots of the 125 kbit/s battery network."""
    d = F.col("data")
    n = F.length(d)
    value = lambda i: F.when(n > 2 * i + 1, (byte_at(d, 2 * i).bitwiseAND(15) * 256 + byte_at(d, 2 * i + 1)) * F.lit(0.00125))
    rows = frames.where(~F.col("is_extended") & F.col("arb_id").between(0x460, 0x47F) & (n >= 2)).select(
        "session_id", "ts_us", "sequence", bicm_slot(F.col("arb_id")).cast("int").alias("slot"),
        F.filter(F.array(*[value(i) for i in range(4)]), lambda v: v.isNotNull()).alias("volts"),
    )
    return rows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=CellsProcessor(CELL_COUNT),
        outputStructType="session_id string, ts_us bigint, cells_volts array<double>",
        outputMode="Update",
        timeMode="None",
    )


def _batches(frames: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = frames.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def _generation(phases: DataFrame, path: str) -> int:
    """The number of these phases in the table; phases that differ from the last ones are stored under a new number."""
    spark = phases.sparkSession
    here = phases.select("session_id", "discovery_id", "phase", F.col("lo_us").cast("bigint").alias("lo_us"), F.col("hi_us").cast("bigint").alias("hi_us"))
    last = -1
    try:
        known = spark.read.parquet(f"{path}/phases")
    except AnalysisException:  # the first start
        known = None
    if known is not None:
        last = known.agg(F.max("generation")).first()[0]
        last = -1 if last is None else last
        before = known.where(F.col("generation") == last).select(*here.columns)
        if before.exceptAll(here).isEmpty() and here.exceptAll(before).isEmpty():
            return last
    here.write.mode("overwrite").parquet(f"{path}/phases/generation={last + 1}")
    return last + 1


def stream_bit_discovery(frames: DataFrame, phases: DataFrame, counts_path: str, checkpoint: str, once: bool = True, bin_us: int = CHUNK_US) -> StreamingQuery:
    """Add each batch's bit counts to a table; a batch rewrites its own partition, so a retry counts once.

    The counts are those of the pieces that the borders of the phases cut the time into, so the table grows with the frames
    and not with phases that overlap. The phases are stored beside them; a start with other phases leaves earlier batches as they are.
    """
    phases = phases.where(F.col("phase").isin("baseline", "event", "after"))
    generation = _generation(phases, counts_path)
    stored = frames.sparkSession.read.parquet(f"{counts_path}/phases/generation={generation}")

    def add(batch: DataFrame, batch_id: int) -> None:
        piece_bit_counts(batch, stored, bin_us).withColumnRenamed("ones", "packed").write.mode("overwrite").parquet(f"{counts_path}/counts/generation={generation}/batch={batch_id}")

    return _batches(frames, add, checkpoint, once)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The stored pieces; batches of the first layout hold their 64 counts as an array, later ones packed."""
    held = spark.read.parquet(folder).schema
    for name, kind in ("ones", ArrayType(IntegerType())), ("packed", BinaryType()):
        if name not in held.names:
            held = held.add(name, kind)
    digits = lambda x: F.lpad(F.hex(F.shiftleft(x.bitwiseAND(0xFF), 24) + F.shiftleft(x.bitwiseAND(0xFF00), 8) + F.shiftright(x, 8).bitwiseAND(0xFF00) + F.shiftright(x, 24)), 8, "0")
    first = F.unhex(F.array_join(F.transform(F.col("ones").cast("array<bigint>"), digits), ""))
    return spark.read.schema(held).parquet(folder).withColumn("ones", F.coalesce("packed", first)).drop("packed")


def discovered_bits(spark: SparkSession, counts_path: str, bin_us: int = CHUNK_US, **limits: float) -> DataFrame:
    """Candidates of all batches so far."""
    counts = _pieces(spark, f"{counts_path}/counts")
    # a batch that was tried again after a start with other phases counts with these
    counts = counts.join(counts.groupBy("batch").agg(F.max("generation").alias("generation")), ["batch", "generation"], "left_semi")
    used = [r["generation"] for r in counts.select("generation").distinct().collect()]  # one for each change of the phases
    phases = spark.read.parquet(f"{counts_path}/phases")
    of = lambda df, g: df.where(F.col("generation") == g).drop("generation", "batch")
    if len(used) < 2:
        return bits_of_points(of(counts, used[0]), of(phases, used[0]), bin_us=bin_us, **limits) if used else bits_of_points(counts.drop("generation", "batch"), phases.drop("generation"), bin_us=bin_us, **limits)
    summed = [_phase_counts(of(counts, g), of(phases, g), bin_us, ["session_id"]) for g in used]
    return candidates_from_counts(reduce(DataFrame.unionByName, summed), **limits)


def check_phase_order(phases: DataFrame) -> DataFrame:
    """Discoveries whose phases are not baseline, event, after in time, or lack the after phase."""
    at = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c)))
    p = phases.groupBy("discovery_id").agg(
        at("baseline", "hi_us").alias("b"), at("event", "lo_us").alias("e0"), at("event", "hi_us").alias("e1"), at("after", "lo_us").alias("a")
    )
    ok = (F.col("b") <= F.col("e0")) & (F.col("e1") <= F.col("a"))
    return p.where(~F.coalesce(ok, F.lit(False))).select("discovery_id")


def stream_candidate_validation(
    samples: DataFrame, step_markers: DataFrame, out_path: str, checkpoint: str, once: bool = True, by: Sequence[str] = ("session_id",)
) -> StreamingQuery:
    """Tag each batch's samples with the current target of their capture and store them; idempotent per batch."""

    def tag(batch: DataFrame, batch_id: int) -> None:
        asof_backward(batch, step_markers, by, ["target_mph"]).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return _batches(samples, tag, checkpoint, once)


def stream_capture_sink(frames: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append frames durably, once each, every second."""
    writer = frames.writeStream.format("parquet").partitionBy("session_id").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).outputMode("append").start()


def endpoint_counters(frames: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Frames on request/response ids and on stream ids, for a complete-mode snapshot."""
    role = lambda c, name: endpoints.where(F.col(c).isNotNull()).select(F.col(c).alias("arb_id"), F.lit(name).alias("role"))
    roles = role("request_id", "endpoint").unionByName(role("response_id", "endpoint")).unionByName(role("stream_id", "stream")).dropDuplicates()
    return frames.join(roles, "arb_id").groupBy("role").agg(F.count("*").alias("frames"))
