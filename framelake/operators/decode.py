"""Payload decoders: registry and catalog driven, and the fixed battery, contactor and start-up layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.bits import be16, byte_at, hex_to_long, intel, motorola
from framelake.plans.ordered import place

# Contactor phases, charger modes, cell block ids.
CONTACTOR_PHASES = {0x68: "hvOff", 0x6A: "firstMainContactorEngaged", 0x6F: "prechargeActive", 0x6B: "hvBusEstablished"}
CHARGER_MODES = {0: "disabled", 1: "lv12VOnly", 2: "hvOnly", 3: "hvAndLv12V"}
CELL_BLOCKS = {0x200: 1, 0x202: 2, 0x204: 3, 0x206: 4}
CELL_COUNT = 96


def _named(code: Column, names: dict[int, str]) -> Column:
    out = F.lit("unknown")
    for key, text in names.items():
        out = F.when(code == key, F.lit(text)).otherwise(out)
    return out


def decode_registry(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per (frame, matching definition); value = raw x scale + offset.

    A big-endian signal running past the payload gives no row, a little-endian one reads zeros there, an unknown
    byte order gives no row. When the frames carry a ``network`` column it is part of the key, because an id alone
    is not an identity. The registry is a catalog; Spark broadcasts it while it is small and shuffles otherwise.
    """
    match = F.col("arb_id") == F.col("can_id")
    keyed = frames
    if "network" in frames.columns:
        keyed = frames.withColumnRenamed("network", "frame_network")
        match = match & (F.col("frame_network") == F.col("network"))
    joined = keyed.join(registry, match)
    data = F.col("data")
    endian = F.lower(F.trim("endian"))
    args = (F.col("start_bit"), F.col("length"), F.col("signed"))
    raw = (
        F.when(endian.isin("motorola", "big", "big_endian"), motorola(data, *args))
        .when(endian.isin("little", "intel", "little_endian"), intel(data, *args))
    )
    return (
        joined.withColumn("raw", raw.cast("double"))
        .where("raw IS NOT NULL")
        .select(
            "session_id",
            "sequence",
            "ts_us",
            F.col("iface").alias("bus"),
            "network",
            "bitrate_kbps",
            "arb_id",
            "message",
            "signal",
            (F.col("raw") * F.col("scale") + F.col("offset")).alias("value"),
            "unit",
            "confidence",
            "source",
            F.hex("data").alias("payload"),
            "notes",
        )
    )


def decode_catalog(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """Apply a catalog's eight decode types; channel N is interface can(N-1), the id's width must agree too."""
    d = F.col("decode")
    data = F.col("data")
    joined = frames.join(
        catalog,
        (F.col("arb_id") == hex_to_long(F.regexp_replace("canId", "^0[xX]", "")))
        & (F.col("is_extended") == F.col("extended"))
        & (F.col("iface") == F.concat(F.lit("can"), (F.col("channel") - 1).cast("string"))),
    )
    byte = byte_at(data, d["byte"])
    nxt = byte_at(data, d["byte"] + 1)
    word = F.when(F.coalesce(d["endianness"], F.lit("big")) == "little", byte + nxt * 256).otherwise(byte * 256 + nxt)
    signed_word = F.when(word >= 32768, word - 65536).otherwise(word)
    mask = F.coalesce(hex_to_long(F.regexp_replace(d["mask"], "^0[xX]", "")), F.lit(255))
    field = F.call_function("shiftright", byte.cast("bigint").bitwiseAND(mask), F.coalesce(d["shift"], F.lit(0)))
    start, length, signed = d["startBit"], d["length"], F.coalesce(d["signed"], F.lit(False))
    dbc = F.when(
        F.coalesce(d["endianness"], F.lit("motorola")).isin("motorola", "big"), motorola(data, start, length, signed)
    ).otherwise(intel(data, start, length, signed))
    kind = d["type"]
    raw = (
        F.when(kind == "bit", F.call_function("shiftright", byte, d["bit"]).bitwiseAND(1).cast("double"))
        .when(kind.isin("enum", "uint8"), byte.cast("double"))
        .when(kind == "uint16", word.cast("double"))
        .when(kind == "int16", signed_word.cast("double"))
        .when(kind == "bitfieldEnum", field.cast("double"))
        .when(kind == "dbcSignal", dbc.cast("double"))
        .when(kind == "payloadEnum", F.length(data).cast("double"))
    )
    hex_key = F.concat(F.lit("0x"), F.lpad(F.hex(F.col("raw").cast("bigint")), 2, "0"))
    names = d["values"]
    text = (
        F.when(kind == "bit", F.when(F.col("raw") == 1, d["true"]).otherwise(d["false"]))
        .when(kind == "payloadEnum", F.try_element_at(names, F.hex(data)))
        .when(kind.isin("enum", "bitfieldEnum"), F.try_element_at(names, hex_key))
        .when(kind == "dbcSignal", F.try_element_at(names, F.col("raw").cast("bigint").cast("string")))
    )
    scaled = F.col("raw") * F.coalesce(d["scale"], F.lit(1.0)) + F.coalesce(d["offset"], F.lit(0.0))
    return (
        joined.withColumn("raw", raw)
        .where("raw IS NOT NULL")
        .select(
            "session_id",
            "sequence",
            "ts_us",
            F.col("iface").alias("bus"),
            "arb_id",
            F.col("name").alias("signal"),
            F.when(kind != "payloadEnum", scaled).alias("value"),
            text.alias("text"),
            d["unit"].alias("unit"),
            F.col("status").alias("confidence"),
        )
    )


def _signal(name: str, value: Column, unit: str, confidence: str, slot: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("signal"),
        (slot if slot is not None else F.lit(None)).cast("int").alias("slot"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"),
        F.lit(confidence).alias("confidence"),
    )


_HEAD = ["session_id", "sequence", "ts_us", "iface", "arb_id"]


def _emit(frames: DataFrame, cells: Column) -> DataFrame:
    return frames.select(*_HEAD, F.inline(cells))


def decode_hv_frames(frames: DataFrame) -> DataFrame:
    """High-voltage bus signals by fixed id and minimum length; other ids give no rows."""
    d = F.col("data")
    n = F.length(d)
    # one branch of the inline below reads only its own id, so the scan keeps a pushed-down id filter
    known = [*CELL_BLOCKS, 0x210, 0x212, 0x302, 0x304, 0x30E, 0x460, 0x308, 0x30A]
    f = frames.where(F.col("arb_id").isin(known))
    big = lambda start, length, signed=False: motorola(d, start, length, signed).cast("double")
    block = F.lit(0)
    for can_id, number in CELL_BLOCKS.items():
        block = F.when(F.col("arb_id") == can_id, number).otherwise(block)
    base = (block - 1) * 24 + big(55, 3) * 3
    cells = F.array(
        *[
            _signal("cellVoltage", big(start, 12) * 0.00125, "V", "slotOrderUnconfirmed", slot=base + i + 1)
            for i, start in enumerate((4, 20, 39))
        ]
    )
    pack = F.array(
        _signal("packVoltage", big(7, 12) * 0.125, "V", "confirmed"),
        _signal("packCurrent", big(23, 8, True) * 0.1 - 0.1, "A", "candidate"),
    )
    charger = F.array(
        _signal("hvCurrent", big(7, 13) * 0.05, "A", "communityCorroborated"),
        _signal("hvVoltage", big(10, 10) * 0.5, "V", "communityCorroborated"),
        _signal("lvCurrent", big(16, 8) * 0.2, "A", "communityCorroborated"),
        _signal("lvVoltage", big(24, 8) * 0.1, "V", "communityCorroborated"),
    )
    mux = F.call_function("shiftright", byte_at(d, 0), F.lit(2)).bitwiseAND(1)
    temps = F.when(
        mux == 0,
        F.array(*[_signal("batteryTemperature", byte_at(d, 1 + i) * 0.5 - 40.0, "degC", "communityCorroborated", slot=F.lit(i + 1)) for i in range(6)]),
    ).otherwise(
        F.array(*[_signal("batteryTemperature", byte_at(d, 1 + i) * 0.5 - 40.0, "degC", "communityCorroborated", slot=F.lit(i + 7)) for i in range(3)])
    )
    setpoints = F.array(
        _signal("requestedCurrent", byte_at(d, 1) * 0.05, "A", "communityCorroborated", text=F.lit("validOnlyWhileModeEnabled")),
        _signal("requestedVoltage", be16(d, 2) * 0.5, "V", "communityCorroborated", text=F.lit("validOnlyWhileModeEnabled")),
    )
    mode = F.array(_signal("chargerMode", byte_at(d, 0), "", "communityCorroborated", text=_named(byte_at(d, 0), CHARGER_MODES)))
    coolant = F.array(
        _signal("coolantInlet", big(1, 10) * 0.125 - 40.0, "degC", "observedCandidate"),
        _signal("coolantOutlet", big(17, 10) * 0.125 - 40.0, "degC", "observedCandidate"),
    )
    raw = F.array(_signal("ambiguousRaw", F.lit(None), "", "ambiguous", text=F.hex(d)))
    arb = F.col("arb_id")
    chosen = (
        F.when(arb.isin(list(CELL_BLOCKS)) & (n >= 8), cells)
        .when((arb == 0x210) & (n >= 8), pack)
        .when((arb == 0x212) & (n >= 5), charger)
        .when((arb == 0x302) & (n >= 8), temps)
        .when((arb == 0x304) & (n >= 4), setpoints)
        .when((arb == 0x30E) & (n >= 1), mode)
        .when((arb == 0x460) & (n >= 4), coolant)
        .when(arb.isin(0x308, 0x30A), raw)
    )
    return _emit(f, chosen)


def _twelve_bits(d: Column, offset: int) -> Column:
    return byte_at(d, offset).bitwiseAND(15) * 256 + byte_at(d, offset + 1)


def bicm_slot(arb_id: Column) -> Column:
    """0x460..0x46F are slots 0, 2, .. 30 and 0x470..0x47F are 1, 3, .. 31."""
    r = arb_id - 0x460
    return F.when(r >= 16, (r - 16) * 2 + 1).otherwise(r * 2)


def decode_bicm_frames(frames: DataFrame) -> DataFrame:
    """Cell voltages (0x460-0x47F) and module temperatures (0x7E0-0x7EF) of the 125 kbit/s battery bus."""
    d = F.col("data")
    n = F.length(d)
    arb = F.col("arb_id")
    f = frames.where(~F.col("is_extended") & (arb.between(0x460, 0x47F) | arb.between(0x7E0, 0x7EF)))
    volts = F.filter(
        F.array(
            *[
                _signal("moduleVoltage", F.when(n > 2 * i + 1, _twelve_bits(d, 2 * i) * 0.00125), "V", "communityDerived", slot=bicm_slot(arb), text=F.lit(str(i)))
                for i in range(4)
            ]
        ),
        lambda c: c["value"].isNotNull(),
    )
    index = arb - 0x7E0
    pair = F.when(index.isin(0, 1, 8, 12, 13), 0).when(index.isin(2, 5, 9), 2)
    raw = F.when(pair == 0, _twelve_bits(d, 0)).when(pair == 2, _twelve_bits(d, 2))
    temp = F.filter(
        F.array(_signal("moduleTemperature", F.lit(110.7) - raw * 0.0294, "degC", "communityDerived", slot=index)),
        lambda c: c["value"].isNotNull(),
    )
    return _emit(f, F.when(arb < 0x500, volts).otherwise(temp))


def cells_snapshot(frames: DataFrame) -> DataFrame:
    """Latest voltage frame per slot of each session; 96 values, last slot first, or null while incomplete."""
    d = F.col("data")
    n = F.length(d)
    f = frames.where(~F.col("is_extended") & F.col("arb_id").between(0x460, 0x47F) & (n >= 2))
    values = F.filter(
        F.array(*[F.when(n > 2 * i + 1, _twelve_bits(d, 2 * i) * F.lit(0.00125)) for i in range(4)]), lambda v: v.isNotNull()
    )
    latest = f.select("session_id", bicm_slot(F.col("arb_id")).alias("slot"), place().alias("at"), values.alias("volts"))
    per_slot = latest.groupBy("session_id", "slot").agg(F.max_by("volts", "at").alias("volts"))
    # at most 32 slots of at most 4 values per session
    joined = per_slot.groupBy("session_id").agg(
        F.reverse(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "volts"))), lambda s: s["volts"]))).alias("all_cells")
    )
    return joined.select(
        "session_id",
        F.size("all_cells").alias("observed_values"),
        F.when(F.size("all_cells") == CELL_COUNT, F.col("all_cells")).alias("cells_volts"),
    )


def decode_dc_link(frames: DataFrame) -> DataFrame:
    """DC-link voltage: id 0x228, bytes 2-3 big-endian x 0.0125."""
    f = frames.where((F.col("arb_id") == 0x228) & (F.length("data") >= 4))
    return _emit(f, F.array(_signal("dcLinkVoltage", be16(F.col("data"), 2) * 0.0125, "V", "candidate")))


def decode_contactor(frames: DataFrame) -> DataFrame:
    """Contactor state samples: id 0x5EC, byte 0 = 0xFE, state in byte 1."""
    d = F.col("data")
    f = frames.where((F.col("arb_id") == 0x5EC) & (F.length(d) >= 2) & (byte_at(d, 0) == 0xFE))
    raw = F.col("raw_state")
    return f.withColumn("raw_state", byte_at(d, 1)).select(
        "session_id",
        F.col("sequence").alias("seq"),
        "ts_us",
        F.col("iface").alias("channel"),
        "raw_state",
        raw.isin(list(CONTACTOR_PHASES)).alias("known"),
        _named(raw, CONTACTOR_PHASES).alias("phase"),
        (raw.bitwiseAND(1) > 0).alias("main_contactor_bit0"),
        (raw.bitwiseAND(2) > 0).alias("main_contactor_bit1"),
        (raw.bitwiseAND(4) > 0).alias("precharge_bit2"),
    )


def decode_startup_signals(frames: DataFrame) -> DataFrame:
    """Pedal (0x0F1), power mode (0x1F1), pack current and voltage (0x2C7)."""
    d = F.col("data")
    n = F.length(d)
    arb = F.col("arb_id")
    f = frames.where(arb.isin(0x0F1, 0x1F1, 0x2C7))
    pedal = F.array(
        _signal("brakePressed", F.when(byte_at(d, 0).bitwiseAND(2) > 0, 1).otherwise(0), "", "confirmed"),
        _signal("brakePosition", byte_at(d, 1), "raw", "confirmed"),
    )
    mode = F.array(_signal("systemPowerMode", byte_at(d, 0).bitwiseAND(3), "", "confirmed"))
    hv = F.array(
        _signal("hvBatteryCurrent", motorola(d, 12, 13, True).cast("double") * 0.15, "A", "candidate"),
        _signal("hvBatteryVoltage", motorola(d, 31, 12).cast("double") * 0.125, "V", "confirmed"),
    )
    chosen = (
        F.when((arb == 0x0F1) & (n >= 2), pedal)
        .when((arb == 0x1F1) & (n >= 1), mode)
        .when((arb == 0x2C7) & (n >= 5), hv)
    )
    return _emit(f, chosen)


__all__ = [
    "bicm_slot", "cells_snapshot", "decode_bicm_frames", "decode_catalog", "decode_contactor",
    "decode_dc_link", "decode_hv_frames", "decode_registry", "decode_startup_signals",
]
