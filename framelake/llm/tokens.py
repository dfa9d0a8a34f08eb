"""Token ids in files of directly addressable codes: any token is read without decoding a block."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import shared_folder, spread, store, stored, table

MAGIC = b"DACTOK01"
#: Bits of a chunk level, and bitmap bytes per entry of the rank directory.
CHUNK_BITS = 8
RANK_BYTES = 64
#: A file is closed at the first document end after so many tokens.
FILE_TOKENS = 4_000_000
#: Entries of the piece and of the word cache, which a worker process keeps from task to task (some 100 MB each).
CACHE = 500_000

_POPCOUNT = np.array([i.bit_count() for i in range(256)], dtype=np.uint8)


# ---- the code ------------------------------------------------------------------------------------------------


def dac_encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: one byte of each id that reaches it, the bitmap of those that go on, and the set bits before each 64 bytes of it."""
    levels, rest = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while True:
        more = rest >> CHUNK_BITS != 0
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(_POPCOUNT[bitmap], np.arange(0, len(bitmap), RANK_BYTES), dtype=np.uint64) if len(bitmap) else np.zeros(0, np.uint64)
        levels.append((rest.astype(np.uint8), bitmap, np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])))
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK_BITS


def dac_decode(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids."""
    ids = levels[-1][0].astype(np.uint32)
    for low, bitmap, _ in reversed(levels[:-1]):
        more = np.unpackbits(bitmap, count=len(low), bitorder="little").view(bool)
        out = low.astype(np.uint32)
        out[more] |= ids << CHUNK_BITS
        ids = out
    return ids


def dac_get(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], at: int) -> int:
    """The id at a position, by one byte, one bit and one rank per level."""
    value, shift = 0, 0
    for low, bitmap, rank in levels:
        value |= int(low[at]) << shift
        byte, bit = divmod(at, 8)
        if not bitmap[byte] >> bit & 1:
            break
        block = byte // RANK_BYTES
        before = int(_POPCOUNT[bitmap[block * RANK_BYTES : byte]].sum()) + (int(bitmap[byte]) & (1 << bit) - 1).bit_count()
        at, shift = int(rank[block]) + before, shift + CHUNK_BITS
    return value


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file: header, documents (id, whether it has one, length), then the levels, each with its sizes before it."""
    levels = dac_encode(ids)
    parts = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels))]
    parts += [np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is not None for i in doc_ids], np.uint8).tobytes(), np.array(lengths, "<i8").tobytes()]
    for low, bitmap, rank in levels:
        parts += [struct.pack("<QQQ", len(low), len(bitmap), len(rank)), low.tobytes(), bitmap.tobytes(), rank.astype("<u8").tobytes()]
    return b"".join(parts)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Document ids, lengths, and the levels as views of the file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, _, n_levels = struct.unpack_from("<QQQ", data, 8)
    at = 32

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    ids, known, lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
    levels = []
    for _ in range(n_levels):
        a, b, c = struct.unpack_from("<QQQ", data, at)
        at += 24
        levels.append((take("u1", a), take("u1", b), take("<u8", c)))
    return [int(i) if k else None for i, k in zip(ids, known)], lengths, levels


# ---- text to ids ---------------------------------------------------------------------------------------------


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Words(dict):
    """Ids, as bytes, of single words; plain lower-case words go to the merges directly where that gives the library's ids."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.letters, self.tokenize = _byte_letters(), self.tokenizer.model.tokenize
        probes = ["a", "the", "straße", "élève", "zzxqj", "señores", "over", "œuvre"]
        self.direct = all(self._merged(w) == self._encoded(w) for w in probes)

    def _encoded(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, word: str) -> bytes:
        # ASCII letters stand for themselves
        ids = [x.id for x in self.tokenize(word if word.isascii() else "".join([self.letters[b] for b in word.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = got = self._merged(piece) if self.direct and _LOWER.fullmatch(piece) else self._encoded(piece)
        return got


_LOWER = re.compile(r"[a-zß-öø-ÿ]+")
#: A word and the marks behind it, which the vocabularies that pass the probe never join to it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*.,]*)")
_ODD = re.compile("[\x1c-\x1f]")


class _Pieces(dict):
    """Ids, as bytes, of the pieces between white space; a plain word shares them with its other spellings, marks are pieces of their own."""

    def __init__(self, words: _Words) -> None:
        self.words = words

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        plain = _PLAIN.fullmatch(piece)
        if plain:
            got = self.words[plain[1].lower()] + (self.words[plain[2]] if plain[2] else b"")
        else:
            got = self.words[piece]
        self[piece] = got
        return got


class Encoder:
    """``encode(text)`` gives the library's ids as little-endian bytes; equal pieces are encoded once.

    For vocabularies that lower-case, drop white space and never join across it: then each piece between white space
    can be encoded by itself. Texts with the control characters that Python alone takes for white space, and all texts
    under a vocabulary of another kind, go to the library as they are.
    """

    def __init__(self, vocabulary: str) -> None:
        self.words = _Words(vocabulary)
        self.pieces = _Pieces(self.words)
        probe = "The THE  don't, Señor. x-ray 12\n\tÉlève (a) Zq. Der### the&&&. Ça!! onea.### x$%* ny*** A#, z...\n"
        self.piecewise = b"".join(map(self.pieces.__getitem__, probe.split())) == self.words._encoded(probe)

    def encode(self, text: str) -> bytes:
        if not self.piecewise or _ODD.search(text):
            return self.words._encoded(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))


_kept: dict[int, Encoder] = {}


def worker_encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process: its caches serve all tasks that run in it."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(vocabulary)
    return _kept[key]


# ---- files ---------------------------------------------------------------------------------------------------


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of each whole text and ``end_id``, in ascending id order; returns one row per file.

    (path, part, file, docs, tokens, start): start counts the tokens of all files before. Files get names of their own,
    and only those in the returned table, which is written when the tasks have ended, are part of the result: a task
    that runs twice leaves an unused file. Null texts count as empty; rows without id come first; rows that share an id
    are ordered by their text's hash, so that no id makes a large partition. The vocabulary file (a few MB) is read by
    the driver and broadcast.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = worker_encoder(vocabulary.value), np.array([end_id], "<u4").tobytes()
        part, file, docs, lengths, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close() -> pd.DataFrame:
            fs, path = store(folder)
            fs.create_dir(path)
            name = f"part-{part:06d}-{file:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(pack(docs, lengths, np.frombuffer(b"".join(parts), "<u4")))
            return pd.DataFrame({"path": [f"{folder}/{name}"], "part": [part], "file": [file], "docs": [len(docs)], "tokens": [held]})

        for pdf in batches:
            for i, text in zip(pdf["i"], pdf["t"]):
                ids = encoder.encode(text or "") + end
                docs.append(None if pd.isna(i) else int(i))
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= file_tokens:
                    yield close()
                    file, docs, lengths, parts, held = file + 1, [], [], [], 0
        if docs:
            yield close()

    # ids travel as text: a null among integers would turn the whole batch into floats
    order = ["n", F.xxhash64("t")]
    ranged = df.select(F.col(id_col).cast("long").alias("n"), F.col(text_col).alias("t")).repartitionByRange(*order).sortWithinPartitions(*order)
    files = stored(ranged.select(F.col("n").cast("string").alias("i"), "t").mapInPandas(run, "path string, part int, file int, docs long, tokens long"))
    parts = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("own", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(parts, "part").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document of the files that ``write_tokens`` returned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                fs, at = store(path)
                with fs.open_input_file(at) as f:
                    docs, lengths, levels = unpack(f.read())
                ids = dac_decode(levels).astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                out = {"doc_id": pd.array(docs, dtype="Int64"), "start": begins + start, "n_tokens": lengths, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]}
                if with_ids:
                    out["ids"] = [ids[a:b].astype(np.int32) for a, b in zip(begins, ends)]
                yield pd.DataFrame(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spread(files.select("path", "start")).mapInPandas(run, schema)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_tokens(table(spark, sf_dir, "documents"), shared_folder(spark), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(files)
