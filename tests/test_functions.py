import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import coerce, encoding, text


def one(spark, column, value, kind="bigint"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def edge_values(kind: str) -> list[int]:
    """The bounds of a type, its powers of two with their neighbours, and seeded draws (below 2^63, what a bigint holds)."""
    bits = encoding.TYPE_BITS[kind]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if kind[0] == "i" else (0, min((1 << bits) - 1, (1 << 63) - 1))
    draw = random.Random(kind)
    near = {s * (1 << k) + d for k in range(bits) for d in (-1, 0, 1) for s in (-1, 1)} | {low, high, 0} | {draw.randint(low, high) for _ in range(50)}
    return sorted(v for v in near if low <= v <= high)


@pytest.mark.parametrize("kind", sorted(encoding.TYPE_BITS))
def test_encoding_round_trip(spark, kind):
    values = edge_values(kind)
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    rows = df.select("v", encoding.decode(encoding.encode(F.col("v"), kind), kind).alias("back")).collect()
    assert all(r.v == r.back for r in rows)


@pytest.mark.parametrize(("value", "kind", "width"), [(0, "u8", 1), (1, "u8", 1), (255, "u8", 8), (256, "u16", 9), (-1, "i16", 1), (1023, "u16", 10), (-1, "u64", 64)])
def test_bit_width(spark, value, kind, width):
    assert one(spark, lambda v: encoding.bit_width(encoding.encode(v, kind)), value) == width


@pytest.mark.parametrize(("width", "kind", "expected"), [(10, "u8", 8), (20, "i16", 16), (64, "u64", 64), (65, "u64", 64)])
def test_clamped_width(spark, width, kind, expected):
    assert one(spark, lambda v: encoding.clamped_width(v, kind), width, "int") == expected


def test_negative_values_set_the_column_width(spark):
    df = spark.createDataFrame([(-1000,), (1,)], "v bigint")
    assert df.agg(encoding.column_width(F.col("v"), "i32")).first()[0] == 11


def test_unsigned_values_over_all_64_bits(spark):
    values = sorted({0, 1, 2**64 - 1} | {2**k + d for k in range(1, 64) for d in (-1, 0)})
    df = spark.createDataFrame([(str(v),) for v in values], "s string").select(F.col("s").cast("decimal(20,0)").alias("v"))
    code = encoding.from_unsigned(F.col("v"))
    rows = df.select("v", code.alias("code"), encoding.bit_width(code).alias("width"), encoding.to_unsigned(code).alias("back")).collect()
    assert all(int(r.back) == int(r.v) and r.code % 2**64 == int(r.v) and r.width == max(1, int(r.v).bit_length()) for r in rows)
    for bad in ("-1", str(2**64)):
        with pytest.raises(Exception, match="unsigned 64-bit"):
            spark.createDataFrame([(bad,)], "s string").select(encoding.from_unsigned(F.col("s").cast("decimal(20,0)"))).collect()


def test_pairs_keep_their_widths(spark):
    rows = list(zip(edge_values("i16"), edge_values("u16") * 2, strict=False))
    rows[-1] = (rows[-1][0], 65535)
    df = spark.createDataFrame(rows, "a int, b int").select(encoding.pair(F.col("a"), F.col("b")).alias("p"))
    assert sorted((r.p.a, r.p.b) for r in df.collect()) == sorted(rows)
    assert df.agg(encoding.column_width(F.col("p.a"), "i16"), encoding.column_width(F.col("p.b"), "u16")).first()[:] == (16, 16)


def test_packed_bytes(spark):
    assert one(spark, lambda v: encoding.packed_bytes(v, F.lit(10)), 5, "int") == 4 + 7
    assert one(spark, lambda v: encoding.packed_bytes(v, F.lit(10)), 0, "int") == 0


@pytest.mark.parametrize(("raw", "parts"), [("", [""]), ("a  b ", ["a", "", "b", ""]), ("one", ["one"]), ("a\tb c", ["a\tb", "c"])])
def test_tokens(spark, raw, parts):
    assert one(spark, text.tokens, raw, "string") == parts


@pytest.mark.parametrize(
    ("parts", "size", "last", "expected"),
    [([], 3, 3, []), (["a"], 3, 3, ["a"]), (["a", "b"], 3, 3, ["a b"]), (list("abcd"), 2, 2, ["a b", "b c", "c d"]), (list("abcd"), 3, 1, ["a b c", "b c d", "c d", "d"]),
     (list("abc"), 2, 9, [])],
)
def test_windows(spark, parts, size, last, expected):
    assert one(spark, lambda v: text.windows(v, size, last), parts, "array<string>") == expected


@pytest.mark.parametrize(
    ("doc", "phrase", "found"),
    [
        ("we sail at dawn", "sail at", True), ("we sail at dawn", "sail dawn", False), ("we sail at dawn", "dawn at", False), ("we sail at dawn", "sail tomorrow", False),
        ("we sail at dawn", "we sail at dawn", True), ("we sail", "we sail at", False), ("tide", "tide", True), ("tide", "ebb", False),
        ("to and to and fro", "to and fro", True), ("row row row", "row row", True), ("row row", "row row row", False), ("far off and far on", "far on", True),
    ],
)
def test_phrases(spark, doc, phrase, found):
    from lodestrata.operators import postings

    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    assert (postings.search_texts(docs, "text", phrase.split()).count() == 1) is found
    index = postings.positional_index(docs, "doc_id", "text")
    assert (postings.search_index(index, "doc_id", phrase.split()).count() == 1) is found


def test_empty_phrase_is_never_found(spark):
    from lodestrata.operators import postings

    docs = spark.createDataFrame([(1, "low tide"), (2, "")], "doc_id long, text string")
    assert postings.search_texts(docs, "text", []).count() == 0
    assert postings.search_index(postings.positional_index(docs, "doc_id", "text"), "doc_id", []).count() == 0


@pytest.mark.parametrize(("raw", "kind", "value"), [(None, "int", 0), ("", "int", 0), (" \t ", "int", 0), (" 7 ", "int", 7), (" x ", "string", "x"), (" 1.5", "double", 1.5), (None, "boolean", False)])
def test_empty_to_default(spark, raw, kind, value):
    assert one(spark, lambda v: coerce.empty_to_default(v, kind), raw, "string") == value


@pytest.mark.parametrize("raw", ["1.5", "abc"])
def test_bad_numbers_are_errors(spark, raw):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, lambda v: coerce.empty_to_default(v, "int"), raw, "string")


@pytest.mark.parametrize(("raw", "numbers"), [("[1|2|3]", [1, 2, 3]), ("1| 2 |x|70000|3", [1, 2, 3]), ("[]", []), ("", []), ("[5|5]", [5, 5]), (None, [])])
def test_number_list(spark, raw, numbers):
    assert one(spark, coerce.number_list, raw, "string") == numbers
