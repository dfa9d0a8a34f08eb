"""WARC archives: a writer with one gzip member per record and a reader that splits files anywhere."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import shared_folder, spread, store, stored, table

#: Compressed bytes after which the writer begins a new file, and of a split of the reader.
FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
#: Payloads of fewer bytes are never stored as a revisit.
REVISIT_BYTES = 100
MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the format: first line, date of records without one, profile of revisits.
VERSION = "WARC/1.1"
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 18
_HEADER_LIMIT = 1 << 20


# ---- records -------------------------------------------------------------------------------------------------


def record_uri(key: str) -> str:
    """Record ids are made from the row's key, so that a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + key)}>"


def record(kind: str, page: str | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, whose Content-Length tells the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page if page is not None else digest + str(url))}", f"WARC-Date: {NO_DATE}"]
    head += [f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Page-ID: {page}"] if page is not None else []
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


def parse_record(data: bytes, offset: int) -> Record | None:
    """The record of a decoded member; None if it isn't one."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not headers.get("content-length", "").isdigit():
        return None
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    return Record(offset, headers, block) if len(block) == int(headers["content-length"]) else None


def _looks_valid(f: BinaryIO, offset: int) -> bool:
    """Whether the bytes at ``offset`` decode to the head of a record."""
    f.seek(offset)
    unpacker, seen = zlib.decompressobj(31), b""
    try:
        while len(seen) < _HEADER_LIMIT and not unpacker.eof:
            raw = f.read(4096)
            if not raw:
                break
            seen += unpacker.decompress(raw)
            if not seen.startswith(b"WARC/"[: len(seen)]):
                return False
            if b"\r\n\r\n" in seen:
                head = seen[: seen.index(b"\r\n\r\n")].lower()
                return b"\r\nwarc-type:" in head and b"\r\ncontent-length:" in head
    except zlib.error:
        pass
    return False


def _candidates(f: BinaryIO, start: int, end: int) -> Iterator[int]:
    """Offsets in [start, end) at which the gzip magic stands."""
    at, tail = start, b""
    while at < end:
        f.seek(at)
        raw = f.read(min(_READ, end + len(MAGIC) - 1 - at))
        if not raw:
            return
        data, base = tail + raw, at - len(tail)
        pos = data.find(MAGIC)
        while pos >= 0 and base + pos < end:
            yield base + pos
            pos = data.find(MAGIC, pos + 1)
        tail, at = data[-(len(MAGIC) - 1) :], at + len(raw)


def _member(f: BinaryIO, offset: int) -> tuple[bytes, int] | None:
    """The decoded member at ``offset`` and the offset after it; None if it is damaged or cut off."""
    f.seek(offset)
    unpacker, parts, at = zlib.decompressobj(31), [], offset
    try:
        while not unpacker.eof:
            raw = f.read(_READ)
            if not raw:
                return None
            parts.append(unpacker.decompress(raw))
            at += len(raw)
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpacker.unused_data)


def records_between(f: BinaryIO, start: int, end: int) -> Iterator[Record]:
    """The records that begin in [start, end), each of them read to its end, wherever that lies.

    The first is found by the magic and by decoding its head; the next begins where a member ends. After a damaged
    member the search by magic goes on behind its first byte.
    """
    at = start
    while at < end:
        found = next((c for c in _candidates(f, at, end) if _looks_valid(f, c)), None)
        if found is None:
            return
        at = found
        while at < end:
            got = _member(f, at)
            parsed = got and parse_record(got[0], at)
            if not parsed:
                at += 1
                break
            yield parsed
            at = got[1]


# ---- on Spark ------------------------------------------------------------------------------------------------


def with_revisits(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """Adds _size, _digest and _first: the smallest id with the same payload, where another row's payload may stand for this one.

    Only digests travel for the grouping; it is pre-aggregated, and only digests that occur twice are joined back.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    keyed = df.withColumn("_size", F.octet_length(text).cast("long")).withColumn("_digest", F.sha2(text.cast("binary"), 256))
    same = keyed.where(F.col("_size") >= REVISIT_BYTES).groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
    same = same.where("_n > 1 and _first is not null").select(F.col("_digest").alias("_same"), "_first")
    return keyed.join(same, (F.col("_digest") == F.col("_same")) & (F.col("_size") >= REVISIT_BYTES), "left").drop("_same")


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row; returns (path, bytes) of the files that hold the rows, each record once.

    Of rows with equal payloads of 100 bytes or more the one with the smallest id is a response, the others revisit it;
    rows that share the smallest id, rows of a group without any id and smaller payloads are all responses. Null
    payloads count as empty. Files have names of their own and count only once they are in the returned table, which
    is written when the tasks have ended: what a lost or repeated task wrote is never read.
    """
    marked = with_revisits(df.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(payload_col).alias("_payload")), "_id", "_payload")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id"))
    rows = marked.select(
        F.col("_id").cast("string").alias("page"), F.col("_url").alias("url"), F.when(~revisit, F.col("_payload")).alias("payload"),
        F.col("_digest").alias("digest"), F.col("_size").alias("size"), F.when(revisit, F.col("_first").cast("string")).alias("refers"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, done, fs = None, "", 0, None
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                if out is None:
                    fs, base = store(folder)
                    fs.create_dir(base)
                    path, done = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                text = lambda v: v if isinstance(v, str) else None
                kind = "revisit" if text(x.refers) else "response"
                data = record(kind, text(x.page), text(x.url), (text(x.payload) or "").encode("utf-8", "replace"), x.digest, int(x.size), text(x.refers))
                out.write(data)
                done += len(data)
                if done >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{folder}/{path}"], "bytes": [done]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path}"], "bytes": [done]})

    return stored(rows.mapInPandas(run, "path string, bytes long"))


def read_warc(files: DataFrame, with_payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``files`` (path, bytes): path, offset, record_type, target_uri, page_id, refers_to, payload_bytes, payload_digest[, payload].

    A task reads byte ranges: it owns the records that begin in its range and no others, so a file of any size is read
    by many tasks and no record twice. The digest of a response is computed from its payload; for a revisit digest
    and size are those of the record's head. Damaged members are passed over; empty files give no rows.
    """
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("begin")
    splits = files.where("bytes > 0").select("path", "bytes", begin)
    splits = spread(splits.select("path", "begin", F.least(F.col("begin") + split_bytes, F.col("bytes")).alias("end")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start, end in zip(pdf["path"], pdf["begin"], pdf["end"]):
                fs, at = store(path)
                with fs.open_input_file(at) as f:
                    rows, held = [], 0
                    for r in records_between(f, start, end):
                        head, _, payload = r.block.partition(b"\r\n\r\n")
                        h = r.headers
                        revisit = h.get("warc-type") == "revisit"
                        size = int(head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0]) if revisit else len(payload)
                        digest = h.get("warc-payload-digest", "").rpartition(":")[2] if revisit else hashlib.sha256(payload).hexdigest()
                        rows.append((path, r.offset, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-page-id"), h.get("warc-refers-to-page-id"), size, digest, payload if with_payload and not revisit else None))
                        held += len(payload)
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                    yield frame(rows)

    names = ["path", "offset", "record_type", "target_uri", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=names).astype({"offset": "int64", "payload_bytes": "int64"})
        return pdf if with_payload else pdf.drop(columns="payload")

    schema = "path string, offset long, record_type string, target_uri string, page_id string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    out = splits.mapInPandas(run, schema)
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), shared_folder(spark))
    return read_warc(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select page_id, octet_length(encode(html)) as n, sha256(html) as digest from p),
m as (select *, min(page_id) over (partition by digest) as first from k)
select page_id, n as payload_bytes, digest as payload_digest,
    case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
    case when n >= 100 and page_id <> first then first end as refers_to
from m
"""
