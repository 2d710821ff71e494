"""Integer encodings as column expressions.

Parquet packs the values on disk; these expressions give the logical encoding:
what a value is mapped to, how many bits it takes, and the way back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each integer type that a column can be declared with.
TYPE_BITS = {"u8": 8, "u16": 16, "u32": 32, "u64": 64, "i8": 8, "i16": 16, "i32": 32, "i64": 64}


def zigzag(value: Column) -> Column:
    """Signed to unsigned order 0, -1, 1, -2, ...; the same number for every width that holds the value."""
    v = value.cast("bigint")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def from_unsigned(value: Column) -> Column:
    """An unsigned 64-bit value, kept as decimal(20,0), as the bigint with the same bits. Others are an error."""
    v = value.cast("decimal(20,0)")
    fits = (v >= 0) & (v < F.lit(str(1 << 64)).cast("decimal(20,0)"))
    code = F.when(v >= F.lit(str(1 << 63)).cast("decimal(20,0)"), v - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(v).cast("bigint")
    return F.when(v.isNull() | fits, code).otherwise(F.raise_error(F.lit("not an unsigned 64-bit value")).cast("bigint"))


def to_unsigned(code: Column) -> Column:
    """The way back: decimal(20,0) from 0 to 2^64 - 1."""
    c = code.cast("decimal(20,0)")
    return F.when(c < 0, c + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(c).cast("decimal(20,0)")


def unzigzag(code: Column) -> Column:
    c = code.cast("bigint")
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1).cast("bigint")))


def encode(value: Column, kind: str) -> Column:
    """A column of type ``kind`` as the number that is packed."""
    return zigzag(value) if kind[0] == "i" else value.cast("bigint")


def decode(code: Column, kind: str) -> Column:
    """The way back; bits above the type's width are ignored."""
    c = code.cast("bigint")
    if TYPE_BITS[kind] < 64:
        c = c.bitwiseAND(low_mask(TYPE_BITS[kind]))
    return unzigzag(c) if kind[0] == "i" else c


def low_mask(bits: int) -> Column:
    """The lowest ``bits`` bits set."""
    return F.lit(-1 if bits >= 64 else (1 << max(0, bits)) - 1).cast("bigint")


def bit_width(code: Column) -> Column:
    """Bits that an encoded number takes: 1 for 0, 64 for numbers with the top bit."""
    return F.length(F.bin(code.cast("bigint")))


def clamped_width(width: Column, kind: str) -> Column:
    return F.least(width, F.lit(TYPE_BITS[kind]))


def column_width(value: Column, kind: str) -> Column:
    """Aggregate: the one width that holds every value of a column, found on the encoded values."""
    return F.max(bit_width(encode(value, kind)))


def packed_bytes(count: Column, width: Column) -> Column:
    """Size of ``count`` values of ``width`` bits with their 4-byte count; nothing for none."""
    return F.when(count == 0, F.lit(0)).otherwise(4 + F.ceil(count * width / 8)).cast("bigint")


def pair(a: Column, b: Column) -> Column:
    """Two columns as one; each keeps its own width."""
    return F.struct(a.alias("a"), b.alias("b"))
