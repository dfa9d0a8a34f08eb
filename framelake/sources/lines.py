"""Line-numbered text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.ordered import Carry, running


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with (path, block, line_no, value); line_no counts from 1 in each file, blank lines included.

    A file is scanned in blocks, and a scan counts up its row ids without a gap inside a block. So the first id and the
    count of each block are enough to number all lines: these few rows are summed up and joined back, and the text
    itself is not shuffled.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    blocks = raw.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = running(blocks, ["path"], ["block"], {"_before": Carry("sum", F.col("_n"), inclusive=False)}).select("path", "block", "_first", "_before")
    numbered = raw.join(before, ["path", "block"])
    return numbered.select("path", "block", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "value")
