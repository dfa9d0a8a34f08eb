"""Queries that go through files: rows of the driver's tables are written in a source format, read back and checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import bridge as B
from framelake import jobs, schemas
from framelake.functions.text import iso_utc
from framelake.operators import quality, reports, trace
from framelake.session import cut_lineage, shared_folder
from framelake.sinks.tables import overwrite_sessions, write_c5_tables, write_candump
from framelake.sources import c5, candump, dims

Query = Callable[[SparkSession, str], DataFrame]
FILE_QUERIES: dict[str, Query] = {}
MANIFEST_SCHEMA = "bridge.capture.v1"


def query(fn: Query) -> Query:
    FILE_QUERIES[fn.__name__] = fn
    return fn


def _captures(spark: SparkSession, d: str) -> DataFrame:
    """One capture per interface."""
    return B.frames(spark, d).withColumn("session_id", F.col("iface"))


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, name, size_bytes, sha256) of the capture logs below ``folder``; files are a few per session."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = files.select(quality.relative_path(F.col("path"), folder).alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    session = F.regexp_extract("name", "session_id=([^/]*)/", 1)
    return listed.where(F.col("name").endswith(".txt")).select(session.alias("session_id"), "name", "size_bytes", "sha256")


@query
def ingest_files(spark: SparkSession, d: str) -> DataFrame:
    """Captures written as text with a manifest each, then taken into the session store by the ingest job."""
    base = shared_folder(spark)
    frames = cut_lineage(_captures(spark, d))
    write_candump(frames, f"{base}/logs")
    named = F.struct("name", F.lit("candump_log").alias("role"), F.lit("candump").alias("format"), "size_bytes", F.upper("sha256").alias("sha256"))
    files = _written(spark, f"{base}/logs").groupBy("session_id").agg(F.collect_list(named).alias("files"))
    bus = F.struct(F.max("iface").alias("logged_interface"), F.max("iface").alias("bus"), F.count("*").alias("frames"), F.lit(True).alias("captured"))
    told = frames.groupBy("session_id").agg(F.array(bus).alias("buses"), F.count("*").alias("total"), F.min("ts_us").alias("first_us")).join(files, "session_id")
    lines = told.select(F.col("session_id").alias("s"), F.to_json(F.struct(
        F.lit(MANIFEST_SCHEMA).alias("schema"), "session_id", F.lit("log").alias("capture_type"), F.struct(F.lit("bridge").alias("model")).alias("vehicle"),
        F.struct(iso_utc(F.col("first_us")).alias("metadata_started_utc")).alias("time"), F.struct(F.col("total").alias("total_frames")).alias("capture_status"), "buses", "files",
    )).alias("value"))
    lines.repartition("s").write.partitionBy("s").text(f"{base}/manifests")
    stored = jobs.ingest(spark, f"{base}/manifests", f"{base}/logs", f"{base}/store", MANIFEST_SCHEMA)
    return stored.select("session_id", "ts_us", "iface", "arb_id", "dlc", F.hex("data").alias("payload"))


@query
def file_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries of written logs, with another hash for one capture, another size for one, and one file that is not there."""
    base = shared_folder(spark)
    write_candump(_captures(spark, d), base)
    s = F.col("session_id")
    entries = _written(spark, base).select(
        "session_id", F.when(s == "can3", F.concat("name", F.lit(".gone"))).otherwise(F.col("name")).alias("name"), F.lit("candump_log").alias("role"),
        F.when(s == "can2", F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(s == "can1", F.sha2("sha256", 256)).when(s == "can4", F.lit(None)).otherwise(F.col("sha256")).alias("sha256"),
    )
    return quality.verify_files(cut_lineage(entries), spark, base).select("session_id", "status").distinct()


@query
def transcript_files(spark: SparkSession, d: str) -> DataFrame:
    """Errors as one transcript per interface; every fourth text is blank and dropped after counting."""
    base = shared_folder(spark)
    e = B.events(spark, d).where("event_type = 'error'")
    iface = F.concat(F.lit("can"), (F.col("user_id") % 5).cast("string")).alias("iface")
    at = F.col("ts_us") / 1e6
    rows = e.select(iface, "ts_us", at.alias("audio_start_seconds"), at.alias("audio_end_seconds"), F.when(F.col("k") % 4 == 0, " ").otherwise(F.concat(F.lit("step "), F.col("k").cast("string"))).alias("text"))
    sorted_ = rows.repartition("iface").sortWithinPartitions("iface", "ts_us").drop("ts_us")
    sorted_.write.partitionBy("iface").csv(base, sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = dims.read_transcript(spark, base, drop_empty=False)
    blank = F.col("text") == ""
    return read.groupBy("idx").agg(F.count("*").alias("rows"), F.sum(blank.cast("int")).alias("blank"), F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))


@query
def transcript_faults(spark: SparkSession, d: str) -> DataFrame:
    """Spans that overlap the one before or end before they start."""
    e = B.events(spark, d).where("event_type = 'purchase'")
    iface = F.concat(F.lit("can"), (F.col("user_id") % 5).cast("string")).alias("iface")
    start = F.col("ts_us") / 1e6
    rows = e.select(iface, F.col("event_id").alias("idx"), start.alias("start_s"), (start + (F.col("k") - 10) * 60.0).alias("end_s"))
    return quality.check_transcript_order(rows, ["iface"]).select("iface", "idx", "rule")


@query
def registry_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a signal registry in CSV; rows of the other network and rows without a length are left out."""
    base = shared_folder(spark)
    p = spark.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey")
    p.select(
        F.lit("bridge").alias("source"), F.when(key % 3 == 0, "other").otherwise(dims.REGISTRY_NETWORK).alias("network"), F.lit(dims.REGISTRY_KBPS).alias("bitrate_kbps"),
        F.concat(F.lit("0x"), F.hex(key % 2048)).alias("can_id_hex"), F.col("p_brand").alias("message_name"), F.concat(F.lit(" S_"), key.cast("string")).alias("signal_name"),
        (key % 64).alias("start_bit"), F.when(key % 5 == 0, "").otherwise(F.col("p_size").cast("string")).alias("length"), F.when(key % 2 == 0, "Intel").otherwise("MOTOROLA").alias("endian"),
        F.when(key % 2 == 0, "yes").otherwise("0").alias("signed"), F.lit("0.5").alias("scale"), (key % 7).alias("offset"), F.col("p_name").alias("unit"), F.lit("c").alias("confidence"), F.col("p_type").alias("notes"),
    ).write.csv(base, header=True)
    return dims.read_registry_csv(spark, base).select("signal", "can_id", "message", "start_bit", "length", "endian", "signed", "scale", "offset", "unit", "notes")


@query
def trace_files(spark: SparkSession, d: str) -> DataFrame:
    """Trace records as JSON lines, a folder per trace, read back and validated; lines are those of the file."""
    base = shared_folder(spark)
    records = B.trace_records(spark, d)
    records.repartition("trace_id").sortWithinPartitions("trace_id", "line").drop("line").write.partitionBy("trace_id").json(base)
    read = dims.read_trace_jsonl(spark, base).withColumn("trace_id", F.regexp_extract("trace_id", "trace_id=([^/]*)/", 1))
    return trace.validate_trace(read, B.TRACE_SCHEMA).groupBy("trace_id", "rule", "detail").agg(F.count("*").alias("n"))


@query
def bench_files(spark: SparkSession, d: str) -> DataFrame:
    """Bench observations as JSON lines; counted by direction, id and label."""
    base = shared_folder(spark)
    e = B.events(spark, d)
    marker = F.col("event_type") == "purchase"
    e.select(
        iso_utc(F.col("ts_us")).alias("timestamp"), F.when(marker, "marker").otherwise("rx").alias("direction"), F.when(~marker, F.concat(F.lit("0x"), F.hex(F.lit(0x240) + F.col("user_id") % 40))).alias("canId"),
        F.lpad(F.hex("k"), 2, "0").alias("data"), F.when(marker, "step").alias("label"),
    ).write.json(base)
    rows = reports.bench_rows(dims.read_bench_jsonl(spark, base))
    return rows.groupBy("direction", "label").agg(F.count("*").alias("n"), F.bit_xor("ts_us").alias("times"), F.countDistinct("can_id").alias("ids"))


@query
def c5_table_files(spark: SparkSession, d: str) -> DataFrame:
    """Logger records as tables of files: frames per bus and id, from the table of counts."""
    base = shared_folder(spark)
    write_c5_tables(cut_lineage(c5.decode_blobs(B.c5_blobs(spark, d))), base)
    counts = spark.read.csv(f"{base}/id_counts", header=True, schema="bus INT, can_id INT, frames BIGINT")
    can = spark.read.csv(f"{base}/can", header=True, schema="source STRING, path STRING, offset BIGINT, timestamp_ms BIGINT, bus INT, can_id INT, dlc INT, data STRING")
    again = can.groupBy("bus", "can_id").agg(F.count("*").alias("rows"), F.max("data").alias("last_data"))
    return counts.join(again, ["bus", "can_id"])


@query
def bad_capture_lines(spark: SparkSession, d: str) -> DataFrame:
    """Capture text with broken lines: what the lenient reader leaves out, by reason."""
    base = shared_folder(spark)
    e = B.events(spark, d)
    body = F.concat(F.lit("("), F.floor(F.col("ts_us") / 1_000_000).cast("string"), F.lit(".5) can0 1"), F.lpad(F.hex("k"), 2, "0"), F.lit("#"), F.lpad(F.hex("cents"), 4, "0"))
    line = F.when(F.col("k") % 10 == 1, F.concat(body, F.lit("F"))).when(F.col("k") % 10 == 2, F.concat(F.lit("x"), body)).otherwise(body)
    e.select(line.alias("value")).write.text(base)
    bad = candump.bad_lines(spark, base).groupBy("reason").agg(F.count("*").alias("lines"))
    good = candump.read_candump(spark, base, mode="lenient").agg(F.count("*").alias("lines"))
    return bad.unionByName(good.select(F.lit("read").alias("reason"), "lines"))


@query
def session_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows of three captures written over: one anew, one without rows any more, one untouched."""
    base = shared_folder(spark)
    counts = _captures(spark, d).groupBy("session_id", "arb_id").agg(F.count("*").alias("frames"))
    counts = cut_lineage(counts)
    overwrite_sessions(counts, base)
    some = counts.where("session_id = 'can1'").withColumn("frames", -F.col("frames"))
    overwrite_sessions(some, base, spark.createDataFrame([("can1",), ("can2",)], "session_id STRING"))
    return spark.read.schema(counts.schema).parquet(base)
