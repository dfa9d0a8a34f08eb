"""Session settings shared by tests, benches and jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "framelake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Create a session with AQE on; a cluster normally supplies its own instead."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share; only a session in one process may fall
    back to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="framelake-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder, so that lost executors do not replay the whole lineage.

    A written table is computed once, where ``checkpoint()`` computes twice, and later reads prune its columns.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows that one task puts in order in memory.
TASK_ROWS = 200_000


def tasks_for(rows: int, per_task: int = TASK_ROWS) -> int:
    """Tasks of an ordered plan over so many rows, never fewer than there are cores.

    Adaptive execution joins small partitions until there are about as many as cores, and what is sorted is many times
    larger than its compressed shuffle files; a number given to ``repartition`` stays, so a task's share does not grow.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_task))


def spread(df: DataFrame, rows: int | None = None, per_core: int = 8) -> DataFrame:
    """Dealt to as many tasks as there are rows, up to some per core, for rows that name work and are small themselves.

    Without a number of its own a shuffle of a few paths is made one task by adaptive execution, which looks at the size
    of the paths and not of what they name.
    """
    most = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(df.count() if rows is None else rows, most)))
