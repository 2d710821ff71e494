import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import bitpack

from .test_functions import edge_values


def lists_of(kind: str) -> list[list[int]]:
    """No value, each end of the type alone, all edges at once, and seeded draws from ranges of growing width."""
    edges, draw = edge_values(kind), random.Random(f"{kind} lists")
    return [[], [edges[0]], [edges[-1]], edges, *([draw.choice(edges[: 2 + k]) for _ in range(draw.randint(1, 40))] for k in range(0, len(edges) - 1, 7))]


@pytest.mark.parametrize(("kind", "values"), [(k, v) for k in ("u8", "u32", "i16", "i32", "i64") for v in lists_of(k)[:8]])
def test_values_round_trip(spark, kind, values):
    df = spark.createDataFrame([(values,)], "v array<bigint>").select(bitpack.encode_values(F.col("v"), kind).alias("p"))
    row = df.select("p", bitpack.decode_values(F.col("p"), kind).alias("back")).first()
    assert row.back == values
    assert len(row.p.bytes) == (4 + -(-len(values) * row.p.width // 8) if values else 0)


def test_layout_is_lowest_bit_first(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2],)], "v array<bigint>")
    assert bytes(df.select(bitpack.pack(F.col("v"), F.lit(2))).first()[0]) == bytes([1 | 2 << 2 | 3 << 4 | 1 << 6, 2])
    assert bytes(df.select(bitpack.encode_values(F.col("v"), "u8")["bytes"]).first()[0])[:4] == b"\x05\0\0\0"


def test_bytes_that_end_early_give_whole_values(spark):
    df = spark.createDataFrame([(b"\xff\x01",)], "d binary")
    assert df.select(bitpack.unpack(F.col("d"), F.lit(3), F.lit(99))).first()[0] == [7, 7, 7, 0, 0]
    assert df.select(bitpack.unpack(F.col("d").substr(1, 0).cast("binary"), F.lit(3), F.lit(9))).first()[0] == []


def test_pairs_round_trip(spark):
    draw = random.Random(4)
    rows = [(-(1 << 15), (1 << 16) - 1), ((1 << 15) - 1, 0), *((draw.randrange(-(1 << 15), 1 << 15), draw.randrange(1 << 16)) for _ in range(7))]
    df = spark.createDataFrame([(rows,)], "p array<struct<a:int,b:int>>")
    widths = F.lit(16), F.lit(16)
    packed = df.select(bitpack.encode_pairs(F.col("p"), ("i16", "u16"), widths).alias("d"))
    back = lambda n: packed.select(bitpack.decode_pairs(F.col("d"), ("i16", "u16"), widths, F.lit(n))).first()[0]
    assert [tuple(x) for x in back(9)] == rows and back(0) == []
    with pytest.raises(Exception, match="end inside a pair"):
        back(10)
