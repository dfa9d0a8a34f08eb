"""Payload expressions: bytes, words, bits and signal extraction as plain Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payload bytes that are held in two words; longer payloads are opened in blocks of this many bytes.
BLOCK = 8


def with_words(df: DataFrame, data: str = "data") -> DataFrame:
    """One row per block of eight payload bytes, with ``w_block`` (from 0), ``w_len`` (bytes of the block), ``w_hi`` and
    ``w_lo`` (the block as two unsigned 32-bit words) and ``w_next`` (the first byte behind it, or null).

    A payload of up to eight bytes, an empty or a null one gives one row; no byte of a longer one is left out.
    """
    d, n = F.col(data), F.length(F.col(data))
    more = F.sequence(F.lit(0), F.ceil(n / F.lit(BLOCK)).cast("int") - 1)
    blocks = df.select("*", F.explode(F.when(n > BLOCK, more).otherwise(F.array(F.lit(0)))).alias("w_block"))
    start = F.col("w_block") * BLOCK

    def word(first: int) -> Column:
        text = F.rpad(F.hex(F.substr(d, start + first, F.lit(4))), 8, "0")
        return F.conv(text, 16, 10).cast("bigint")

    return blocks.select("*", F.when(n.isNotNull(), F.least(n - start, F.lit(BLOCK))).alias("w_len"), word(1).alias("w_hi"), word(5).alias("w_lo"), byte_at(d, start + BLOCK).alias("w_next"))


def word_byte(i: int) -> Column:
    """Byte ``i`` (0..7) of a block prepared by :func:`with_words`; null beyond the payload."""
    source, shift = (F.col("w_hi"), 24 - 8 * i) if i < 4 else (F.col("w_lo"), 56 - 8 * i)
    return F.when(F.col("w_len") > i, F.shiftright(source, shift).bitwiseAND(255).cast("int"))


def byte_at(data: Column, i: int | Column) -> Column:
    """Byte ``i`` of a binary column as INT, null beyond the payload."""
    pos = (F.lit(i) if isinstance(i, int) else i) + 1
    cell = F.substr(data, pos, F.lit(1))
    return F.when(F.length(cell) == 1, F.conv(F.hex(cell), 16, 10).cast("int"))


def byte_array(data: Column) -> Column:
    """All payload bytes as ARRAY<INT>; empty for an empty payload."""
    n = F.length(data)
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte_at(data, i))
    ).otherwise(F.array().cast("array<int>"))


def be16(data: Column, i: int) -> Column:
    return byte_at(data, i) * 256 + byte_at(data, i + 1)


def le16(data: Column, i: int) -> Column:
    return byte_at(data, i) + byte_at(data, i + 1) * 256


def bit_text(data: Column) -> Column:
    """The payload as a string of 0/1, most significant bit of byte 0 first, any length."""
    n = F.length(data)
    groups = F.ceil(n / F.lit(4)).cast("int")

    def group(i: Column) -> Column:
        part = F.substr(data, i * 4 + 1, F.lit(4))
        return F.lpad(F.conv(F.hex(part), 16, 2), F.length(part) * 8, F.lit("0"))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), group), "")).otherwise(F.lit(""))


def _unsigned(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("decimal(20,0)")


def _apply_sign(bits: Column, signed: Column) -> Column:
    """Value of at most 64 bits; a negative one is sign-extended to 64 bits and read as two's complement."""
    negative = signed & (F.substr(bits, F.lit(1), F.lit(1)) == "1")
    extended = F.conv(F.lpad(bits, 64, F.lit("1")), 2, -10).cast("decimal(20,0)")
    return F.when(negative, extended).otherwise(_unsigned(bits))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def motorola(data: Column, start, length, signed=False) -> Column:
    """Big-endian signal as DECIMAL(20,0), null when it runs past the payload.

    DBC bit numbering counts bit 7 of byte 0 first, so a signal is one contiguous slice of ``bit_text``.
    """
    start, length, signed = _col(start), _col(length), _col(signed)
    first = F.floor(start / F.lit(8)).cast("int") * 8 + 7 - (start % 8)
    bits = F.substr(bit_text(data), first + 1, length)
    return F.when(first + length <= F.length(data) * 8, _apply_sign(bits, signed))


def intel(data: Column, start, length, signed=False) -> Column:
    """Little-endian signal as DECIMAL(20,0); bits beyond the payload read as zero."""
    start, length, signed = _col(start), _col(length), _col(signed)
    low_first = F.concat(_low_first(data), F.repeat(F.lit("0"), start + length))
    bits = F.reverse(F.substr(low_first, start + 1, length))
    return _apply_sign(bits, signed)


def _low_first(data: Column) -> Column:
    """0/1 text with bit 0 of byte 0 first, then bit 1, and so on."""
    n = F.length(data)

    def one(i: Column) -> Column:
        return F.reverse(F.lpad(F.conv(F.hex(F.substr(data, i + 1, F.lit(1))), 16, 2), 8, "0"))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")).otherwise(F.lit(""))


def id_text(arb_id: Column, extended: Column | None = None) -> Column:
    """CAN id in upper-case hex: 3 wide, or 8 wide when extended (flag given) or above 0x7FF."""
    wide = extended if extended is not None else arb_id > 0x7FF
    return F.when(wide, F.lpad(F.hex(arb_id), 8, "0")).otherwise(
        F.when(F.length(F.hex(arb_id)) > 3, F.hex(arb_id)).otherwise(F.lpad(F.hex(arb_id), 3, "0"))
    )


def hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def byte_hex(value: Column) -> Column:
    """``0xNN`` text of a byte value."""
    return F.concat(F.lit("0x"), F.lpad(F.hex(value), 2, "0"))


def explode_words(wide: DataFrame) -> DataFrame:
    """One row per (row, byte_index, value) of a table prepared by :func:`with_words`."""
    cells = F.array(*[word_byte(i) for i in range(BLOCK)])
    words = ("data", "w_block", "w_len", "w_hi", "w_lo", "w_next")
    kept = [c for c in wide.columns if c not in words]
    opened = wide.where("w_len > 0").select(*kept, "w_block", F.posexplode(F.slice(cells, F.lit(1), F.col("w_len"))).alias("_at", "value"))
    return opened.select(*kept, (F.col("w_block") * BLOCK + F.col("_at")).alias("byte_index"), "value")


def explode_bytes(frames: DataFrame) -> DataFrame:
    """One row per (frame, byte_index, value)."""
    return explode_words(with_words(frames))


def explode_bits(frames: DataFrame) -> DataFrame:
    """One row per bit, least significant bit of each byte first; remote and empty frames are skipped."""
    per_byte = explode_bytes(frames.where(~F.col("remote")))
    bits = F.array(*[F.shiftright("value", b).bitwiseAND(1) for b in range(8)])
    kept = [c for c in per_byte.columns if c not in ("value", "byte_index")]
    return per_byte.select(*kept, "byte_index", F.posexplode(bits).alias("bit_index", "bit"))


def series_array() -> Column:
    """All u8, u16le and u16be readings of a ``with_words`` block as ARRAY<STRUCT<kind, offset, x>>; pairs reach into the next block."""
    cells: list[Column] = []
    at = [word_byte(i) for i in range(BLOCK)] + [F.col("w_next")]

    def entry(kind: str, offset: int, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col("w_block") * BLOCK + offset).alias("offset"), x.cast("bigint").alias("x"))

    for i in range(BLOCK):
        cells.append(entry("u8", i, at[i]))
        cells.append(entry("u16le", i, at[i] + at[i + 1] * 256))
        cells.append(entry("u16be", i, at[i] * 256 + at[i + 1]))
    return F.filter(F.array(*cells), lambda c: c["x"].isNotNull())


def extract_words(frames: DataFrame) -> DataFrame:
    """One row per (frame, kind, offset, x): each byte and each adjacent pair in both byte orders."""
    kept = [c for c in frames.columns if c != "data"]
    return with_words(frames).select(*kept, F.inline(series_array()))
