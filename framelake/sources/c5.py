"""Binary logger files: type-length-value records, read in blocks whose first records are found by composing jump maps."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.schemas import C5_RECORDS
from framelake.session import cut_lineage, spread

COLUMNS = [c.split()[0] for c in C5_RECORDS.split(", ")]
#: Bytes of a block, and of the longest record with its type and length.
BLOCK_BYTES = 1 << 20
LONGEST = 257

# Record types.
CONFIGURED, CAN_RECORD, GPS_RECORD = 0x01, 0x05, 0x24


def record_starts(blob: bytes, at: int, end: int, size: int) -> tuple[np.ndarray, int, bool]:
    """Where records begin from ``at`` on and before ``end``, the place behind them, and whether the walk ends there because the
    next record is cut off. ``blob`` holds the bytes up to ``end`` and those of a record that begins before it; the file ends at
    ``size``, counted as in ``blob``."""
    starts = []
    while at < end:
        if at + 2 > size or at + 2 + blob[at + 1] > size:
            return np.array(starts, dtype=np.int64), at, True
        starts.append(at)
        at += 2 + blob[at + 1]
    return np.array(starts, dtype=np.int64), at, False


def jumps(blob: bytes, end: int, size: int) -> list[int]:
    """For each of the places 0..256 at which a record of the block may begin, how far behind the block's ``end`` the walk from
    there leaves it, or -1 - place where it stops at a cut-off record. Walks that meet go on as one, so that a block costs
    its bytes once, whatever they hold."""
    leaves: dict[int, int] = {}
    out = []
    for entry in range(LONGEST):
        at, path = entry, []
        while at < end and at not in leaves:
            if at + 2 > size or at + 2 + blob[at + 1] > size:
                leaves[at] = -1 - at
                break
            path.append(at)
            at += 2 + blob[at + 1]
        result = leaves[at] if at in leaves else at - end
        leaves.update(dict.fromkeys(path, result))
        out.append(result)
    return out


def decode_records(blob: bytes, starts: np.ndarray, base: int = 0) -> dict[str, list]:
    """Columns of the records at ``starts`` that are of a known type and valid; ``base`` is the file offset of ``blob``."""
    b = np.frombuffer(blob, np.uint8)
    cols: dict[str, list] = {c: [] for c in COLUMNS[2:]}
    kinds, sizes = b[starts], b[starts + 1]

    def number(at: np.ndarray, n: int) -> np.ndarray:
        return sum(b[at + i].astype(np.int64) << 8 * i for i in range(n)) if len(at) else np.zeros(0, np.int64)

    def add(kind: str, at: np.ndarray, **known: Sequence) -> None:
        for c, held in cols.items():
            held.extend({"kind": [kind] * len(at), "offset": at + base, **known}.get(c, [None] * len(at)))

    at = starts[(kinds == CONFIGURED) & (sizes == 5)]
    value = number(at + 5, 2)
    add("configured", at, bus=number(at + 2, 1), can_id=number(at + 3, 2), config_value=value - (value >> 15 << 16))
    at = starts[(kinds == CAN_RECORD) & (sizes == 16)]
    bus, can_id, dlc = number(at + 2, 1), number(at + 3, 2), number(at + 5, 1)
    valid = (bus >= 1) & (bus <= 5) & (can_id <= 0x7FF) & (dlc <= 8)
    at, bus, can_id, dlc = at[valid], bus[valid], can_id[valid], dlc[valid]
    add("can", at, timestamp_ms=number(at + 6, 4), bus=bus, can_id=can_id, dlc=dlc, data=[blob[i + 10 : i + 10 + n] for i, n in zip(at.tolist(), dlc.tolist())])
    at = starts[(kinds == GPS_RECORD) & (sizes >= 4)]
    text = [blob[i + 6 : i + 2 + n].decode("ascii", errors="replace").rstrip("\x00\r\n") for i, n in zip(at.tolist(), b[at + 1].tolist())]
    told = np.array([bool(t) for t in text], dtype=bool)
    add("gps", at[told], timestamp_ms=number(at[told] + 2, 4), sentence=[t for t in text if t])
    return cols


def _status(at: int, size: int) -> dict[str, list]:
    known = {"kind": "status", "offset": at, "malformed_tail": at != size, "bytes_consumed": at}
    return {c: [known.get(c)] for c in COLUMNS[2:]}


def _frames(source: str, path: str, cols: dict[str, list]) -> Iterator[pd.DataFrame]:
    if not cols["kind"]:
        return
    out = pd.DataFrame({"source": source, "path": path, **cols}, columns=COLUMNS)
    for c in ("offset", "timestamp_ms", "bus", "can_id", "dlc", "config_value", "bytes_consumed"):
        out[c] = out[c].astype("Int64")
    yield out


def _walk_stream(source: str, path: str, read: Callable[[int], bytes], size: int) -> Iterator[pd.DataFrame]:
    """A file that is read from its start to its end: blocks of records, then its status. Memory holds one block."""
    base, held, at = 0, b"", 0
    while True:
        more = read(BLOCK_BYTES)
        held += more
        known = size - base if not more else min(size - base, len(held))
        last = not more or base + len(held) >= size
        # records that begin before ``end`` are whole, or cut off by the end of the file
        end = known if last else max(at, len(held) - LONGEST + 1)
        starts, at, stopped = record_starts(held, at, end, known)
        yield from _frames(source, path, decode_records(held, starts, base))
        if stopped or last:
            yield from _frames(source, path, _status(base + at, size))
            return
        keep = min(at, len(held))
        base, held, at = base + keep, held[keep:], at - keep


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _archive_members(f: BinaryIO) -> list[zipfile.ZipInfo]:
    """The logger files of an archive, from its central directory."""
    with zipfile.ZipFile(f) as archive:
        return sorted((m for m in archive.infolist() if m.filename.upper().endswith(".BIN")), key=lambda m: m.filename)


def _decode_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            if not path.lower().endswith(".zip"):
                yield from _walk_stream(_name(path), path, io.BytesIO(content).read, len(content))
                continue
            for m in _archive_members(io.BytesIO(content)):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(m) as f:
                    yield from _walk_stream(_name(m.filename), f"{path}!{m.filename}", f.read, m.file_size)


def decode_blobs(blobs: DataFrame) -> DataFrame:
    """(path, content) rows to tagged records; see ``C5_RECORDS``. Base names may repeat, so ``path`` stays too."""
    return blobs.select("path", "content").mapInPandas(_decode_rows, C5_RECORDS)


def _open(path: str) -> BinaryIO:
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    return fs.open_input_file(at)


def _block(path: str, length: int, block: int, block_bytes: int) -> tuple[bytes, int, int]:
    """The bytes of a block and of a record that begins in it, its end, and the file's end counted from the block's start."""
    start = block * block_bytes
    with _open(path) as f:
        f.seek(start)
        blob = f.read(min(block_bytes + LONGEST, length - start))
    return blob, min(block_bytes, length - start), length - start


def _jump_rows(block_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [jumps(*_block(p, n, k, block_bytes)) for p, n, k in zip(pdf["path"], pdf["length"], pdf["block"])]
            yield pdf.assign(jumps=found)

    return run


def _entry_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the first record of each block begins; the blocks of a file come in order, those behind a stop have none."""
    now, entry = None, 0
    for pdf in batches:
        out = []
        for path, length, block, leaves in zip(pdf["path"], pdf["length"], pdf["block"], pdf["jumps"]):
            if path != now:
                now, entry = path, 0
            if entry >= 0:
                out.append((path, length, block, entry))
                entry = int(leaves[entry])
        yield pd.DataFrame(out, columns=["path", "length", "block", "entry"])


def _block_rows(block_bytes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, length, block, entry in zip(pdf["path"], pdf["length"], pdf["block"], pdf["entry"]):
                blob, end, size = _block(path, length, block, block_bytes)
                starts, at, stopped = record_starts(blob, entry, end, size)
                base = block * block_bytes
                yield from _frames(_name(path), path, decode_records(blob, starts, base))
                if stopped or base + end >= length:
                    yield from _frames(_name(path), path, _status(base + at, length))

    return run


def _member_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            with _open(path) as f:
                out += [(path, m.filename, m.file_size) for m in _archive_members(f)]
        yield pd.DataFrame(out, columns=["path", "member", "length"])


def _decode_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, member, length in zip(pdf["path"], pdf["member"], pdf["length"]):
            with _open(path) as f, zipfile.ZipFile(f) as archive, archive.open(member) as data:
                yield from _walk_stream(_name(member), f"{path}!{member}", data.read, int(length))


def read_c5(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A .BIN file, a folder searched for *.BIN, or ZIP archives, as one tagged table.

    Records have no synchronisation mark, so where a block's first record begins depends on all bytes before it. But it
    is one of its first 257 places: each block tells, for all of them at once, where a walk from there leaves it; these
    maps are put one after the other per file, and then blocks are decoded apart. So a file of any size is read by many
    tasks, twice in all; a file of one block is read once. Members of an archive are tasks of their own, found by its
    central directory, and read as streams. Spark lists no empty files, so these have no status row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.lower().endswith((".bin", ".zip")):
        reader = reader.option("pathGlobFilter", "*.{BIN,ZIP,zip}")
    files = reader.load(path).select("path", "length")
    zipped = F.lower("path").endswith(".zip")
    last = F.greatest(F.ceil(F.col("length") / block_bytes).cast("int") - 1, F.lit(0))
    blocks = files.where(~zipped).select("path", "length", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    told = spread(blocks.where(F.col("length") > block_bytes)).mapInPandas(_jump_rows(block_bytes), "path string, length bigint, block int, jumps array<int>")
    entries = told.repartition("path").sortWithinPartitions("path", "block").mapInPandas(_entry_rows, "path string, length bigint, block int, entry int")
    entries = cut_lineage(entries.unionByName(blocks.where(F.col("length") <= block_bytes).withColumn("entry", F.lit(0))))
    plain = spread(entries).mapInPandas(_block_rows(block_bytes), C5_RECORDS)
    members = cut_lineage(spread(files.where(zipped).select("path")).mapInPandas(_member_rows, "path string, member string, length bigint"))
    return plain.unionByName(spread(members).mapInPandas(_decode_members, C5_RECORDS))


def can_records(records: DataFrame) -> DataFrame:
    return records.where("kind = 'can'").select("source", "path", "offset", "timestamp_ms", "bus", "can_id", "dlc", "data")


def gps_records(records: DataFrame) -> DataFrame:
    return records.where("kind = 'gps'").select("source", "path", "offset", "timestamp_ms", "sentence")


def configured_ids(records: DataFrame) -> DataFrame:
    return records.where("kind = 'configured'").select("source", "path", "offset", "bus", "can_id", "config_value")


def source_status(records: DataFrame) -> DataFrame:
    return records.where("kind = 'status'").select("source", "path", "malformed_tail", "bytes_consumed")


def source_summary(records: DataFrame) -> DataFrame:
    """Per file: CAN, GPS and configured records, whether the tail was cut, bytes read."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    return records.groupBy("path", "source").agg(
        of("can").alias("can_records"), of("gps").alias("gps_records"), of("configured").alias("configured_ids"),
        F.max("malformed_tail").alias("malformed_tail"), F.max("bytes_consumed").alias("bytes_consumed"),
    )


def anchor_logger_time(can: DataFrame, anchors: DataFrame) -> DataFrame:
    """Logger milliseconds to wall time: anchor + (logger ms - anchor ms); ``anchors`` has (path, wall_us, logger_ms)."""
    return can.join(anchors, "path").withColumn(
        "ts_us", F.col("wall_us") + (F.col("timestamp_ms") - F.col("logger_ms")) * 1000
    ).drop("wall_us", "logger_ms")


def logger_frames(can: DataFrame) -> DataFrame:
    """CAN records as frames on the logger's own clock (not an epoch)."""
    return can.select(
        F.col("path").alias("session_id"), F.col("offset").alias("sequence"), (F.col("timestamp_ms") * 1000).alias("ts_us"),
        F.col("bus").cast("string").alias("iface"), F.col("can_id").cast("bigint").alias("arb_id"), F.lit(False).alias("is_extended"),
        F.lit(False).alias("remote"), F.length("data").alias("dlc"), "data",
    )
