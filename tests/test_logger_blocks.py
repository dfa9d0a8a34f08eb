"""Logger files read in blocks against a plain walk over the whole file."""

from __future__ import annotations

import random
import struct
import zipfile

import pytest

from framelake.sources import c5


def plain_walk(blob):
    out, at = [], 0
    while at + 2 <= len(blob) and at + 2 + blob[at + 1] <= len(blob):
        kind, n = blob[at], blob[at + 1]
        body = blob[at + 2 : at + 2 + n]
        if kind == 1 and n == 5:
            bus, can_id, value = struct.unpack("<BHh", body)
            out.append(("configured", at, None, bus, can_id, None, None, None, value, None, None))
        elif kind == 5 and n == 16:
            bus, can_id, dlc, ms = struct.unpack_from("<BHBI", body)
            if 1 <= bus <= 5 and can_id <= 0x7FF and dlc <= 8:
                out.append(("can", at, ms, bus, can_id, dlc, body[8 : 8 + dlc], None, None, None, None))
        elif kind == 0x24 and n >= 4:
            text = body[4:].decode("ascii", errors="replace").rstrip("\x00\r\n")
            if text:
                out.append(("gps", at, struct.unpack_from("<I", body)[0], None, None, None, None, text, None, None, None))
        at += 2 + n
    out.append(("status", at, None, None, None, None, None, None, None, at != len(blob), at))
    return out


def logger_file(seed, size, tail=b""):
    rng = random.Random(seed)
    out = b""
    while len(out) < size:
        what = rng.random()
        if what < 0.6:
            out += bytes([5, 16, rng.randrange(7)]) + struct.pack("<HBI", rng.randrange(0x900), rng.randrange(10), rng.randrange(1 << 32)) + rng.randbytes(8)
        elif what < 0.7:
            out += bytes([1, 5, rng.randrange(6)]) + struct.pack("<Hh", rng.randrange(1 << 16), rng.randrange(-9, 9))
        elif what < 0.8:
            text = rng.choice([b"", b"$VTG,1,K\r\n", b"\xff\x00", b"$" + b"x" * 200])
            out += bytes([0x24, 4 + len(text)]) + struct.pack("<I", 7) + text
        else:
            n = rng.choice([0, 1, 255, 255, rng.randrange(256)])
            out += bytes([rng.choice([5, 1, 0x24, 9]), n]) + rng.randbytes(n)
    return out + tail


def rows(df):
    return sorted((tuple(None if x is None else bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in df.select("path", "kind", "offset", "timestamp_ms", "bus", "can_id", "dlc", "data", "sentence", "config_value", "malformed_tail", "bytes_consumed").collect()), key=str)


def test_blocks_equal_one_walk(spark, tmp_path):
    files = {"a.BIN": logger_file(1, 20_000), "b.BIN": logger_file(2, 9_000, b"\x05\x10\x01"), "empty.BIN": b"", "tiny.BIN": b"\x05", "edge.BIN": bytes([9, 255]) + bytes(255) * 1 + bytes([9, 253]) + bytes(253), "junk.BIN": random.Random(3).randbytes(5_000), "long.BIN": (bytes([9, 255]) + bytes(255)) * 30 + b"\x05\xff"}
    for name, blob in files.items():
        (tmp_path / name).write_bytes(blob)
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.BIN", "b.BIN", "empty.BIN"):
            z.writestr(f"trip/{name}", files[name])
        z.writestr("note.txt", "x")
    want = [(f"file:{tmp_path}/{name}", *r) for name, blob in files.items() if blob for r in plain_walk(blob)]  # Spark lists no empty files
    want += [(f"file:{tmp_path}/z.zip!trip/{name}", *r) for name in ("a.BIN", "b.BIN", "empty.BIN") for r in plain_walk(files[name])]
    for block in (512, 1 << 20):
        assert rows(c5.read_c5(spark, str(tmp_path), block)) == sorted(want, key=str)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.BIN").write_bytes(logger_file(5, 40_000))
    tasks = c5.read_c5(spark, str(tmp_path / "a.BIN"), 1024).rdd.getNumPartitions()
    assert tasks >= 40


@pytest.mark.parametrize("seed", range(5))
def test_jump_maps_compose_to_the_walk(seed):
    blob = logger_file(seed, 4_000, b"\x05\x30" * (seed % 2))
    starts = {r for r in _starts(blob)}
    entry, at = 0, 0
    while at < len(blob):
        end = min(300, len(blob) - at)
        leaves = c5.jumps(blob[at : at + end + c5.LONGEST], end, len(blob) - at)
        assert entry >= end or at + entry in starts or at + entry == max(starts) + 2 + blob[max(starts) + 1]
        entry, at = leaves[entry], at + end
        if entry < 0:
            break


def _starts(blob):
    at = 0
    while at + 2 <= len(blob) and at + 2 + blob[at + 1] <= len(blob):
        yield at
        at += 2 + blob[at + 1]


def test_streams_in_small_reads(monkeypatch):
    import io

    monkeypatch.setattr(c5, "BLOCK_BYTES", 300)
    for seed in range(4):
        blob = logger_file(seed, 3_000, b"\x01" * (seed % 2))
        got = [(r.kind, r.offset) for pdf in c5._walk_stream("n", "p", io.BytesIO(blob).read, len(blob)) for r in pdf.itertuples()]
        assert sorted(got) == sorted((r[0], r[1]) for r in plain_walk(blob))
