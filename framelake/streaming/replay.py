"""Stored rows as a stream that is stopped and started again: later slices go on from the state that earlier ones left."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelake.session import shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A slice is one batch, whatever the number of its files: files of a slice have no order among each other.
_ALL_FILES = 1_000_000

Start = Callable[[DataFrame, str, str], StreamingQuery]


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, set for the queries that start inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def append(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to a table, each row once."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def replay(rows: DataFrame, start: Start, slices: int = 2, t: str = "ts_us") -> str:
    """Write ``rows`` in equal slices of their time range; after each, ``start`` (stream, output, checkpoint) runs on what is new.

    Returns the output folder. The checkpoint is the same for all runs, so each is a restart of the one before.
    """
    spark = rows.sparkSession
    base = shared_folder(spark)
    ends = rows.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    lo, hi = (0, 0) if ends["lo"] is None else (ends["lo"], ends["hi"])
    width = (hi - lo) // slices + 1
    with keyed_state(spark):
        for k in range(slices):
            inside = (F.col(t) >= lo + k * width) & (F.col(t) < lo + (k + 1) * width)
            rows.where(inside).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", _ALL_FILES).parquet(f"{base}/in")
            start(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"


def streamed(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], slices: int = 2, t: str = "ts_us") -> DataFrame:
    """What an append-mode ``operator`` gives over :func:`replay`."""
    schemas = []

    def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
        df = operator(stream)
        schemas.append(df.schema)
        return append(df, out, checkpoint)

    out = replay(rows, start, slices, t)
    return rows.sparkSession.read.schema(schemas[0]).parquet(out)
