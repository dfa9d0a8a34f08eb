"""Data-quality checks as violation tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.session import spread


def relative_path(path: Column, folder: str) -> Column:
    """The part of a file's whole path below ``folder``, url escapes undone."""
    whole = F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^[A-Za-z0-9]+:/*", "/")
    base = "/" + re.sub("^[A-Za-z0-9]+:/*", "/", folder).strip("/") + "/"
    return F.when(whole.startswith(base), F.substr(whole, F.lit(len(base) + 1)))


def _sha256(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of each file, read in blocks, so that its size does not matter."""
    from pyarrow.fs import FileSystem

    for pdf in batches:
        digests = []
        for path in pdf["path"]:
            fs, at = FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with fs.open_input_stream(at, compression=None) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pdf.assign(actual_sha256=digests)


def verify_files(capture_files: DataFrame, spark: SparkSession, folder: str, check_hash: bool = True) -> DataFrame:
    """Manifest entries with status verified, missing, sizeMismatch, hashMismatch or unhashed (no hash given or asked for).

    Names are paths below ``folder``, so equal base names in two folders are two files. Files are listed without their
    content and hashed by a streamed read on the executors, dealt to tasks by their number.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = raw.select("path", relative_path(F.col("path"), folder).alias("name"), F.col("length").alias("actual_size"))
    listed = listed.join(capture_files.select("name").distinct(), "name", "left_semi")
    if check_hash:
        listed = spread(listed).mapInPandas(_sha256, "name string, path string, actual_size bigint, actual_sha256 string")
    else:
        listed = listed.withColumn("actual_sha256", F.lit(None).cast("string"))
    joined = capture_files.join(listed.drop("path"), "name", "left")
    status = (
        F.when(F.col("name").isNull() | F.col("role").isNull(), "incompleteEntry")
        .when(F.col("actual_size").isNull(), "missing")
        .when(F.col("size_bytes") != F.col("actual_size"), "sizeMismatch")
        .when(F.lower("sha256") != F.col("actual_sha256"), "hashMismatch")
        .when(F.col("sha256").isNull() | F.col("actual_sha256").isNull(), "unhashed")
        .otherwise("verified")
    )
    return joined.select("session_id", "name", "role", status.alias("status"))


def sessions_without_log(capture_files: DataFrame) -> DataFrame:
    """Sessions whose manifest names no capture log."""
    return capture_files.groupBy("session_id").agg(
        F.max((F.col("role") == "candump_log").cast("int")).alias("has_log")
    ).where("coalesce(has_log, 0) = 0").select("session_id")


def check_transcript_order(transcript: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Transcript rows that overlap the row before or end before they start; a transcript is one recording."""
    keys = by or [F.lit(0)]
    before = F.lag("end_s").over(Window.partitionBy(*keys).orderBy("idx"))
    rule = F.when(F.col("end_s") < F.col("start_s"), "negativeDuration").when(F.col("start_s") < F.col("_before"), "overlap")
    return transcript.withColumn("_before", before).withColumn("rule", rule).where("rule IS NOT NULL").drop("_before")
