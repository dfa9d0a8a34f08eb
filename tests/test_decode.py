from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import text
from framelake.functions.bits import bit_text, byte_array, id_text, intel, motorola
from framelake.operators import decode
from framelake.schemas import SIGNAL_DEFS


def motorola_brute(data, start, length, signed):
    bit, value = start, 0
    for _ in range(length):
        if bit // 8 >= len(data):
            return None
        value = value * 2 + (data[bit // 8] >> bit % 8 & 1)
        bit = bit + 15 if bit % 8 == 0 else bit - 1
    return value - (1 << length) if signed and value >> (length - 1) else value


def intel_brute(data, start, length, signed):
    value = int.from_bytes(data, "little") >> start & ((1 << length) - 1)
    return value - (1 << length) if signed and value >> (length - 1) else value


def test_extraction_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(500):
        data = rnd.randbytes(rnd.choice([1, 2, 3, 8, 12, 16]))
        rows.append((i, data, rnd.randrange(0, 8 * len(data)), rnd.randint(1, 64), rnd.random() < 0.5))
    df = spark.createDataFrame(rows, "i INT, data BINARY, s INT, n INT, g BOOLEAN")
    args = (F.col("data"), F.col("s"), F.col("n"), F.col("g"))
    got = {r["i"]: (r["m"], r["l"]) for r in df.select("i", motorola(*args).alias("m"), intel(*args).alias("l")).collect()}
    for i, data, s, n, g in rows:
        assert got[i] == (motorola_brute(data, s, n, g), intel_brute(data, s, n, g))


def values(df):
    return [(r["signal"], r["slot"], round(r["value"], 5) if r["value"] is not None else r["text"]) for r in df.collect()]


def test_golden_hv_payloads(make_frames):
    f = make_frames([
        (1.0, "can2", 0x200, "177AF73EBBC01800"), (2.0, "can2", 0x302, "038BA18B898C8A1E"), (3.0, "can2", 0x460, "0A3C0A3C"),
        (4.0, "can2", 0x212, "000000011200"), (5.0, "can2", 0x30E, "03"), (6.0, "can2", 0x308, "0102"), (7.0, "can2", 0x123, "00"), (8.0, "can2", 0x210, "BE44"),
    ])
    assert values(decode.decode_hv_frames(f)) == [
        ("cellVoltage", 1, 3.75625), ("cellVoltage", 2, 3.71875), ("cellVoltage", 3, 3.755),
        *[("batteryTemperature", i + 1, v) for i, v in enumerate((29.5, 40.5, 29.5, 28.5, 30.0, 29.0))],
        ("coolantInlet", None, 31.5), ("coolantOutlet", None, 31.5),
        ("hvCurrent", None, 0.0), ("hvVoltage", None, 0.0), ("lvCurrent", None, 0.0), ("lvVoltage", None, 13.7),
        ("chargerMode", None, 3.0), ("ambiguousRaw", None, "0102"),
    ]


@pytest.mark.parametrize("payload,volts", [("004F0149", 4.1125), ("004F6049", 308.1125)])
def test_dc_link(make_frames, payload, volts):
    assert values(decode.decode_dc_link(make_frames([(1.0, "can1", 0x228, payload)]))) == [("dcLinkVoltage", None, volts)]


def test_startup_golden(make_frames):
    got = values(decode.decode_startup_signals(make_frames([(1.0, "can1", 0x2C7, "03BFCABD8000")])))
    assert got == [("hvBatteryCurrent", None, -8.1), ("hvBatteryVoltage", None, 379.0)]


def test_registry_overflow_rules(spark, make_frames):
    defs = [
        ("t", "n", 125, 0x10, "M", "beyond", 15, 16, "motorola", False, 1.0, 0.0, "", "c", ""),
        ("t", "n", 125, 0x10, "M", "padded", 8, 16, "little", False, 1.0, 0.0, "", "c", ""),
        ("t", "n", 125, 0x10, "M", "strange", 0, 8, "middle", False, 1.0, 0.0, "", "c", ""),
        ("t", "other", 500, 0x10, "M", "elsewhere", 0, 8, "little", False, 1.0, 0.0, "", "c", ""),
    ]
    f = make_frames([(1.0, "can0", 0x10, "0102")]).withColumn("network", F.lit("n"))
    out = decode.decode_registry(f, spark.createDataFrame(defs, SIGNAL_DEFS)).collect()
    assert [(r["signal"], r["value"]) for r in out] == [("padded", 2.0)]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("$GPVTG,1,T,2,M,3.4,N,6.5,K,A", 1.0), ("$GPVTG,K", 0.1), ("$GPRMC,6.5,K", -2.5e-7), ("$GPVTG,x,K", 123456.789), (None, 1e22)], "s STRING, v DOUBLE"
    )
    rows = df.select(text.vtg_speed(F.col("s")).alias("x"), text.number_text(F.col("v")).alias("n")).collect()
    assert [r["x"] for r in rows] == [6.5, None, None, None, None]
    assert [r["n"] for r in rows[:4]] == ["1", "0.1", "-2.5e-07", "123456.789"]
    one = spark.range(1).select(
        id_text(F.lit(0x7FF)).alias("a"), id_text(F.lit(0x800)).alias("b"), bit_text(F.lit(b"\x80\x01")).alias("c"), byte_array(F.lit(b"\x01\xff")).alias("d"),
        text.provider_fingerprint(F.create_map(F.lit("name"), F.lit('a"b'))).alias("e"),
    ).first()
    import hashlib
    import json

    ident = {"registryPath": None, "registrySubkey": None, "name": 'a"b', "vendor": None, "functionLibrary": None}
    want = hashlib.sha256(json.dumps(ident, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert (one["a"], one["b"], one["c"], one["d"], one["e"]) == ("7FF", "00000800", "1000000000000001", [1, 255], want)
