"""Writers: session tables, derived tables, capture text, logger tables, reports and markers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from framelake.functions.bits import id_text
from framelake.functions.text import marker_label, marker_source
from framelake.plans.ordered import chunk_of


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(0).count()
        return True
    except AnalysisException:
        return False


def overwrite_sessions(df: DataFrame, path: str, sessions: DataFrame | None = None) -> None:
    """Replace session partitions: those of ``sessions`` (session_id) are deleted first, so that a session without rows keeps
    no stale ones; without ``sessions`` those present in ``df`` are replaced."""
    if sessions is not None:
        drop_sessions(df.sparkSession, path, sessions)
    df.write.partitionBy("session_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def check_frame_count(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions whose parsed frames differ from the manifest total (which is the actual count when absent)."""
    actual = frames.groupBy("session_id").agg(F.count("*").alias("parsed"))
    return (
        sessions.select("session_id", "total_frames")
        .join(actual, "session_id", "left")
        .withColumn("parsed", F.coalesce("parsed", F.lit(0)))
        .where("total_frames IS NOT NULL AND total_frames != parsed")
    )


def write_session(
    frames: DataFrame, sessions: DataFrame, path: str, replace: bool = False, derived: tuple[str, ...] = ()
) -> DataFrame:
    """Write frames by session; refuses existing sessions unless ``replace``.

    The frames go to a folder beside the table, are read back and counted there, and only then take the place of the old
    partitions: a check that fails leaves the table as it was. Frames are clustered by (session, interface, id, hour) and
    sorted by time inside files, so that row-group statistics prune time ranges and one id is never one task. Replacing
    a session, also by one without frames, clears its old frames and its partitions in the ``derived`` tables.
    """
    spark = frames.sparkSession
    ids = sessions.select("session_id").distinct()
    if _exists(spark, path) and not replace:
        known = spark.read.parquet(path).select("session_id").distinct()
        if not known.join(ids, "session_id", "left_semi").isEmpty():
            raise ValueError("Session already present; use replace")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    laid_out = frames.repartition("session_id", "iface", "arb_id", chunk_of("ts_us")).sortWithinPartitions("session_id", "iface", "arb_id", "ts_us", "sequence")
    laid_out.write.partitionBy("session_id").parquet(staging)
    staged = spark.read.schema(frames.schema).parquet(staging)
    if not check_frame_count(staged, sessions).isEmpty():
        raise ValueError("Frame count differs from the manifest")
    drop_sessions(spark, path, ids)
    _move_partitions(spark, staging, path)
    for table in derived:
        drop_sessions(spark, table, ids)
    return spark.read.schema(frames.schema).parquet(path).join(ids, "session_id", "left_semi")


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the constructor of paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _move_partitions(spark: SparkSession, source: str, target: str) -> None:
    """Rename each session partition into the table; their number is that of the sessions written."""
    fs, path = _hadoop(spark, target)
    fs.mkdirs(path(target))
    for part in fs.listStatus(path(source)):
        if part.isDirectory():
            fs.rename(part.getPath(), path(path(target), part.getPath().getName()))
    fs.delete(path(source), True)


def drop_sessions(spark: SparkSession, path: str, sessions: DataFrame) -> None:
    """Remove the partitions of some sessions from a table: those of its partition folders that are named for them."""
    fs, hadoop_path = _hadoop(spark, path)
    if not fs.exists(hadoop_path(path)):
        return
    there = [(p.getPath().getName(), p.getPath().getName().partition("=")[2]) for p in fs.listStatus(hadoop_path(path)) if p.getPath().getName().startswith("session_id=")]
    if not there:
        return
    folders = spark.createDataFrame(there, "folder STRING, escaped STRING")
    named = folders.withColumn("session_id", F.try_url_decode(F.replace("escaped", F.lit("+"), F.lit("%2B"))))
    for row in named.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("folder").toLocalIterator():
        fs.delete(hadoop_path(hadoop_path(path), row["folder"]), True)


def candump_lines(frames: DataFrame, width_by_flag: bool = True) -> DataFrame:
    """Capture text lines; ids are 3 wide, or 8 wide when extended (or above 0x7FF with ``width_by_flag`` off)."""
    ident = id_text(F.col("arb_id"), F.col("is_extended") if width_by_flag else None)
    seconds = (F.col("ts_us") / F.lit(1_000_000)).cast("bigint")
    micros = F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0")
    body = F.when(F.col("remote"), F.concat(F.lit("R"), F.col("dlc").cast("string"))).otherwise(F.hex("data"))
    line = F.concat(F.lit("("), seconds.cast("string"), F.lit("."), micros, F.lit(") "), "iface", F.lit(" "), ident, F.lit("#"), body)
    return frames.select("session_id", "sequence", "ts_us", line.alias("value"))


def write_candump(frames: DataFrame, path: str, width_by_flag: bool = True) -> None:
    """Capture text by session, in time order inside and across files (range partitioned, not through one task)."""
    lines = candump_lines(frames, width_by_flag)
    ordered = lines.repartitionByRange("session_id", "ts_us", "sequence").sortWithinPartitions("session_id", "ts_us", "sequence")
    ordered.select("session_id", "value").write.partitionBy("session_id").mode("errorifexists").text(path)


def write_c5_tables(records: DataFrame, path: str) -> None:
    """Logger records as CAN, GPS, session and id-count tables."""
    from framelake.sources.c5 import can_records, gps_records, source_summary

    can = can_records(records)
    can.withColumn("data", F.hex("data")).write.mode("overwrite").csv(f"{path}/can", header=True)
    gps_records(records).write.mode("overwrite").csv(f"{path}/gps", header=True)
    source_summary(records).write.mode("overwrite").csv(f"{path}/sessions", header=True)
    can.groupBy("bus", "can_id").agg(F.count("*").alias("frames")).write.mode("overwrite").csv(f"{path}/id_counts", header=True)


def write_mapping(assignments: DataFrame, path: str) -> None:
    """Mapping rows as CSV with the eight report columns."""
    assignments.select(
        "cell", "slot", "score", "rmse_v", "delta_correlation", "overlap", "confidence", "mapping_status"
    ).write.mode("overwrite").csv(path, header=True)


def write_json_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_marker(spark: SparkSession, path: str, label: str, source: str, ts_us: int) -> None:
    """Append one operator marker row; an empty label is refused, line breaks become blanks."""
    if not label.strip():
        raise ValueError("marker label must not be empty")
    row = spark.createDataFrame([(ts_us, source.strip(), label.strip())], "ts_us BIGINT, source STRING, label STRING")
    row.select("ts_us", marker_source(F.col("source")).alias("source"), marker_label(F.col("label")).alias("label")).write.mode("append").json(path)
