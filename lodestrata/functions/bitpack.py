"""Bit-packed bytes as column expressions, for the rare case that bytes themselves are wanted.

Values follow each other with the lowest bit first; the last byte is filled up
with zeros. On disk Parquet does the packing; this is for exchange and small arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .encoding import bit_width, decode, encode
from .text import bound_once


def _bits(code: Column, width: Column) -> Column:
    """The ``width`` lowest bits as text, lowest first."""
    return F.reverse(F.call_function("lpad", F.right(F.bin(code), width), width, F.lit("0")))


def _bytes(bits: Column) -> Column:
    def of(b: Column) -> Column:
        n = F.ceil(F.length(b) / 8).cast("int")
        filled = F.call_function("rpad", b, n * 8, F.lit("0"))
        pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.conv(F.reverse(F.substring(filled, (i - 1) * 8 + 1, F.lit(8))), 2, 16), 2, "0"))
        return F.when(n == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(pairs, "")))

    return bound_once(bits, of)


def _bits_of(data: Column) -> Column:
    def of(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.reverse(F.lpad(F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 2), 8, "0")))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(parts, ""))

    return bound_once(F.hex(data), of)


def _number(bits: Column) -> Column:
    return F.conv(F.reverse(bits), 2, -10).cast("bigint")


def pack(codes: Column, width: Column) -> Column:
    """An array of encoded numbers as bytes, ``width`` bits each."""
    return _bytes(F.array_join(F.transform(codes, lambda v: _bits(v, width)), ""))


def unpack(data: Column, width: Column, count: Column) -> Column:
    """``count`` numbers from bytes; where the bytes end early, as many as there are whole."""

    def of(b: Column) -> Column:
        n = F.least(count, F.floor(F.length(b) / width)).cast("int")
        found = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _number(F.substring(b, ((i - 1) * width + 1).cast("int"), width)))
        return F.when((n < 1) | (width < 1), F.array().cast("array<bigint>")).otherwise(found)

    return bound_once(_bits_of(data), of)


def _little_endian(value: Column) -> Column:
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.lpad(F.hex(F.call_function("shiftright", value, i * 8).bitwiseAND(F.lit(255))), 2, "0")), ""))


def encode_values(values: Column, kind: str) -> Column:
    """(width, bytes): a 4-byte count and the packed values at the width of the widest; (0, nothing) for none."""
    codes = F.transform(values, lambda v: encode(v, kind))
    width = F.coalesce(F.array_max(F.transform(codes, bit_width)), F.lit(0))
    made = bound_once(width, lambda w: F.struct(w.alias("width"), F.concat(_little_endian(F.size(values)), pack(codes, w)).alias("bytes")))
    return F.when(F.size(values) == 0, F.struct(F.lit(0).alias("width"), F.lit(b"").alias("bytes"))).otherwise(made)


def decode_values(packed: Column, kind: str) -> Column:
    """The array that ``encode_values`` was given."""
    data, width = packed["bytes"], packed["width"]
    count = unpack(F.substring(data, 1, 4), F.lit(32), F.lit(1))[0]
    codes = F.when(width > 0, unpack(F.substring(data, F.lit(5), F.length(data)), width, count)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(codes, lambda c: decode(c, kind))


def encode_pairs(pairs: Column, kinds: tuple[str, str], widths: tuple[Column, Column]) -> Column:
    """An array of (a, b) as bytes, the two numbers of a pair side by side at their own widths."""
    return _bytes(F.array_join(F.transform(pairs, lambda p: F.concat(_bits(encode(p["a"], kinds[0]), widths[0]), _bits(encode(p["b"], kinds[1]), widths[1]))), ""))


def decode_pairs(data: Column, kinds: tuple[str, str], widths: tuple[Column, Column], count: Column) -> Column:
    """``count`` pairs from bytes; bytes that end inside a pair are an error."""
    both = widths[0] + widths[1]

    def one(b: Column, i: Column) -> Column:
        at = ((i - 1) * both + 1).cast("int")
        a, c = _number(F.substring(b, at, widths[0])), _number(F.substring(b, (at + widths[0]).cast("int"), widths[1]))
        return F.struct(decode(a, kinds[0]).alias("a"), decode(c, kinds[1]).alias("b"))

    def of(b: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int")), lambda i: one(b, i))
        whole = F.when(F.length(b) >= count * both, some).otherwise(F.raise_error(F.lit("the bytes end inside a pair")))
        return F.when(count < 1, F.slice(some, 1, 0)).otherwise(whole)

    return bound_once(_bits_of(data), of)
