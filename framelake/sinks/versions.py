"""A session store that is never seen half written: rows go to folders of their own, and a pointer names them afterwards.

Rows of a write lie below ``data/version=<id>``. A row (session_id, version, at) of the pointer table, appended when they
are written and counted, makes them the session's rows; a null version removes the session. Readers take each session's
latest pointer. A write that fails has no pointer, so what was there before is still read, and nothing is renamed or
deleted for it. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from framelake.plans.ordered import chunk_of
from framelake.sinks.tables import check_frame_count

_POINTERS = "session_id STRING, version STRING, at BIGINT"


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, version, at): the latest pointer of each session, also of removed ones."""
    try:
        told = spark.read.schema(_POINTERS).parquet(f"{path}/pointers")
    except AnalysisException:
        told = spark.createDataFrame([], _POINTERS)
    return told.groupBy("session_id").agg(F.max(F.struct("at", "version")).alias("p")).select("session_id", "p.version", "p.at")


def _point(sessions: DataFrame, path: str, version: str | None) -> None:
    spark = sessions.sparkSession
    last = pointers(spark, path).agg(F.max("at")).first()[0]
    rows = sessions.select(F.col("session_id").cast("string"), F.lit(version).cast("string").alias("version"), F.lit((last or 0) + 1).cast("bigint").alias("at"))
    rows.distinct().coalesce(1).write.mode("append").parquet(f"{path}/pointers")


def commit_sessions(frames: DataFrame, sessions: DataFrame, path: str, replace: bool = False) -> None:
    """Write the frames of ``sessions`` (session_id, total_frames) and make them current, all sessions at once.

    Refuses sessions that are present unless ``replace``, and frames whose number differs from total_frames (null: any
    number). Sessions without frames become empty ones.
    """
    spark = frames.sparkSession
    present = pointers(spark, path).where("version IS NOT NULL")
    if not replace and not present.join(sessions.select("session_id"), "session_id", "left_semi").isEmpty():
        raise ValueError("Session already present; use replace")
    version = uuid.uuid4().hex
    folder = f"{path}/data/version={version}"
    # clustered so that one id is never one task, sorted so that statistics of row groups prune time ranges
    laid_out = frames.repartition("session_id", "iface", "arb_id", chunk_of("ts_us")).sortWithinPartitions("session_id", "iface", "arb_id", "ts_us", "sequence")
    laid_out.write.partitionBy("session_id").parquet(folder)
    if not check_frame_count(spark.read.schema(frames.schema).parquet(folder), sessions).isEmpty():
        raise ValueError("Frame count differs from the manifest")
    _point(sessions, path, version)


def remove_sessions(sessions: DataFrame, path: str) -> None:
    """Readers no longer see ``sessions``; their rows stay until :func:`unused_versions` are deleted."""
    _point(sessions, path, None)


def read_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current rows of all sessions; pointers and rows meet by partition columns, so old versions are not read."""
    current = pointers(spark, path).where("version IS NOT NULL").select("session_id", "version")
    try:
        rows = spark.read.schema(f"{schema}, version STRING").parquet(f"{path}/data")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.join(current, ["session_id", "version"], "left_semi").drop("version")


def unused_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version): folders that no session's latest pointer names, left by replaced sessions and failed writes."""
    rows = spark.read.schema("session_id STRING, version STRING").parquet(f"{path}/data").select("version").distinct()
    return rows.join(pointers(spark, path).where("version IS NOT NULL"), "version", "left_anti")
