"""Shared folder, tables and graph components for the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a shingle and the similarity at which texts count as near copies, where an operator has no contract of its own.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Edges that one task joins by itself.
LOCAL_EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only a session in one process may fall back to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="framelake-shared-")
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/llm-{uuid.uuid4().hex}"


def store(uri: str) -> tuple[FileSystem, str]:
    """The file system of a qualified folder or file and the path in it, for tasks that write or read bytes."""
    return FileSystem.from_uri(uri)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the edges (a, b): the smallest node that each node is joined to by these edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as links from each node to its root among them."""
    a = b = np.zeros(0, dtype=np.int64)
    for pdf in batches:
        a, b = np.concatenate([a, pdf["a"].to_numpy(np.int64)]), np.concatenate([b, pdf["b"].to_numpy(np.int64)])
        if len(a) > 2 * LOCAL_EDGES:  # no more is held than a link per node
            a, b = forest(a, b)
            a, b = a[a != b], b[a != b]
    nodes, roots = forest(a, b)
    yield pd.DataFrame({"a": nodes[nodes != roots], "b": roots[nodes != roots]})


def components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (node, root) per node with a link; root is the smallest node.

    Each task joins its own edges first, and some hundred thousand are one task's work; from more, large-star and
    small-star steps alternate. Each keeps at most one row per edge, so a hub costs as much as its links; minima are
    pre-aggregated and the joins on a hub can be split by adaptive execution.
    """
    ends = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    tasks = max(1, -(-ends.count() // local_edges))
    cur = stored((ends.coalesce(1) if tasks == 1 else ends.repartition(tasks)).mapInPandas(_forests, "a long, b long"))
    if tasks == 1:
        return _labelled(cur)
    state = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        kept = large.join(low, large["a"] == low["n"])
        small = kept.select(F.col("b").alias("a"), F.col("m").alias("b")).union(kept.select("a", F.col("m").alias("b")))
        cur = stored(small.where("a <> b").distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return _labelled(cur)


def _labelled(stars: DataFrame) -> DataFrame:
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the place of a row among those of its ``group`` (not null) by ``order``, and ``size``, their number.

    A range shuffle deals rows by group and order together, so a group of any size takes as many tasks as it needs; only
    the counts per task and group meet afterwards. Rows alike in all of ``order`` are put in any order.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    starts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = starts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    starts = starts.withColumn("size", F.sum("_n").over(Window.partitionBy(group))).drop("_n", "_first")
    return rows.join(starts, [group, "_part"]).withColumn("pos", F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")


def spread(df: DataFrame, rows: int | None = None, per_core: int = 8) -> DataFrame:
    """``df``, whose small rows name much work, dealt to as many tasks as it has rows, up to some per core.

    Without a number of its own a shuffle of paths is made one task by adaptive execution, which sees the size of the
    paths and not of the files.
    """
    most = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(df.count() if rows is None else rows, most)))
