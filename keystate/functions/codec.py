"""Binary records as column expressions: log records, run entries, index and footer, commands.

Layouts (fixed values). Log record, little-endian: CRC-32 of the rest, tombstone byte,
key length, value length, key, value. Run entry: the same without the CRC. Index:
entry count, then key length, key, 8-byte offset, length for each block. Footer: index
offset and index length, 8 bytes each, and the magic. Command, big-endian: type byte,
key length, key, value length, value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RUN_MAGIC


def _turned(x: Column) -> Column:
    """An unsigned number of 4 bytes with its bytes in opposite order."""
    low = F.lit(0xFF00)
    return F.shiftleft(x.bitwiseAND(F.lit(0xFF)), 24).bitwiseOR(F.shiftleft(x.bitwiseAND(low), 8)).bitwiseOR(F.shiftright(x, 8).bitwiseAND(low)).bitwiseOR(F.shiftright(x, 24))


def be(x: Column, size: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * size, "0"))


def le(x: Column, size: int = 4) -> Column:
    """The number in 4 bytes, or in 8: its low half, then its high half."""
    x = x.cast("long")
    if size == 4:
        return be(_turned(x))
    return F.concat(le(x.bitwiseAND(F.lit(0xFFFFFFFF))), le(F.shiftrightunsigned(x, 32)))


def from_be(data: Column, pos: int | Column, size: int = 4) -> Column:
    """The unsigned integer of ``size`` bytes from a position (counted from 1)."""
    return F.conv(F.hex(data.substr(F.lit(pos) if isinstance(pos, int) else pos, F.lit(size))), 16, 10).cast("long")


def from_le(data: Column, pos: int | Column, size: int = 4) -> Column:
    if size == 4:
        return _turned(from_be(data, pos))
    return from_le(data, pos).bitwiseOR(F.shiftleft(from_le(data, pos + 4), 32))


def _bytes(x: Column) -> Column:
    return F.coalesce(x.cast("binary"), F.lit(b""))


def run_entry(key: Column, value: Column, tombstone: Column) -> Column:
    k, v = _bytes(key), _bytes(value)
    return F.concat(be(tombstone.cast("int"), 1), le(F.octet_length(k)), le(F.octet_length(v)), k, v)


def log_record(key: Column, value: Column, tombstone: Column) -> Column:
    body = run_entry(key, value, tombstone)
    return F.concat(le(F.crc32(body)), body)


def decode_log_record(data: Column) -> Column:
    """struct(ok, tombstone, key, value); ok is false where the record is cut off or its CRC is wrong."""
    klen, vlen = from_le(data, 6), from_le(data, 10)
    body = data.substr(F.lit(5), F.octet_length(data))
    ok = (F.octet_length(data) >= 13) & (F.octet_length(data) == 13 + klen + vlen) & (F.crc32(body) == from_le(data, 1))
    key = data.substr(F.lit(14), klen.cast("int"))
    value = data.substr((14 + klen).cast("int"), vlen.cast("int"))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, from_be(data, 5, 1) == 1).alias("tombstone"), F.when(ok, key).alias("key"), F.when(ok, value).alias("value"))


def index_entry(last_key: Column, offset: Column, length: Column) -> Column:
    k = _bytes(last_key)
    return F.concat(le(F.octet_length(k)), k, le(offset, 8), le(length))


def footer(index_offset: Column, index_length: Column) -> Column:
    return F.concat(le(index_offset, 8), le(index_length, 8), le(F.lit(RUN_MAGIC), 8))


def decode_footer(data: Column) -> Column:
    """struct(ok, index_offset, index_length); ok: 24 bytes with the magic."""
    ok = (F.octet_length(data) == 24) & (from_le(data, 17, 8) == RUN_MAGIC)
    return F.struct(ok.alias("ok"), from_le(data, 1, 8).alias("index_offset"), from_le(data, 9, 8).alias("index_length"))


def command(op: Column, key: Column, value: Column) -> Column:
    k, v = _bytes(key), _bytes(value)
    return F.concat(be(op.cast("int"), 1), be(F.octet_length(k)), k, be(F.octet_length(v)), v)


def decode_command(data: Column) -> Column:
    """struct(error, op, key, value): error names what is wrong, else it is null."""
    size = F.octet_length(data)
    klen = F.when(size >= 9, from_be(data, 2))
    vlen = F.when(size >= 9 + klen, from_be(data, (6 + klen).cast("int")))
    error = F.when(size < 9, "too short").when(size < 9 + klen, "key length").when(size < 9 + klen + vlen, "value length")
    fine = error.isNull()
    return F.struct(
        error.alias("error"),
        F.when(fine, from_be(data, 1, 1).cast("int")).alias("op"),
        F.when(fine, data.substr(F.lit(6), klen.cast("int"))).alias("key"),
        F.when(fine, data.substr((10 + klen).cast("int"), vlen.cast("int"))).alias("value"),
    )
