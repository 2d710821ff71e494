import pytest
from pyspark.sql import functions as F

from lodestrata.operators import catindex
from lodestrata.operators.project import FieldSpec, TableSpec
from lodestrata.sources.container import Container, section, strict_section
from lodestrata.sources.ingest import Source, read_delimited


def test_container_reads_one_column(spark, tmp_path):
    box = Container(spark, str(tmp_path / "box"))
    rows = lambda *x: spark.createDataFrame(list(x), "column_id int, bytes binary")
    box.write(rows((1, b"Hello Rust"), (2, b"Hello World")))
    box.write(rows((3, b"Hello World")))
    assert [bytes(r.bytes) for r in box.column(1).collect()] == [b"Hello Rust"]
    assert {r.column_id for r in box.columns([2, 3, 9]).collect()} == {2, 3}
    with pytest.raises(ValueError, match="unique"):
        box.write(rows((3, b"again")))
    with pytest.raises(KeyError):
        box.column(9)


@pytest.mark.parametrize(("offset", "length", "expected"), [(10, 10, b"abcdefghij"), (0, 3, b"012"), (36, 5, b""), (40, 5, b""), (30, 99, b"uvwxyz")])
def test_sections(spark, offset, length, expected):
    df = spark.createDataFrame([(b"0123456789abcdefghijklmnopqrstuvwxyz",)], "data binary")
    assert bytes(df.select(section(F.col("data"), F.lit(offset), F.lit(length))).first()[0]) == expected


def test_strict_sections_end_at_the_end(spark):
    df = spark.createDataFrame([(b"HEADER..DATA-SECTION..FOOTER",)], "data binary")
    read = lambda o, n: df.select(strict_section(F.col("data"), F.length("data"), F.lit(o), F.lit(n))).first()[0]
    assert bytes(read(8, 12)) == b"DATA-SECTION"
    with pytest.raises(Exception, match="seek past the end"):
        read(99, 1)


def test_delimited_source(spark, tmp_path):
    (tmp_path / "in.csv").write_text("rcid,new_rcid,weight,skills,title\n 7 ,,1.5,[1|2|x],  boss \n,3,,,\n")
    sources = [Source("rcid", "int"), Source("next_rcid", "int", "new_rcid"), Source("weight", "float"), Source("skills", "array<int>"), Source("title", "string"), Source("inflow", "boolean", None)]
    rows = [tuple(r) for r in read_delimited(spark, str(tmp_path / "in.csv"), sources).collect()]
    assert rows == [(7, 0, 1.5, [1, 2], "boss", False), (0, 3, 0.0, [], "", False)]


def test_stream_appends_columns_and_index(spark, tmp_path):
    from pyspark.sql import types as T

    from lodestrata.streaming.sink import append_columns

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string, kind string"
    spec = TableSpec((FieldSpec("doc_id", rename="id"), FieldSpec("text", T.StringType(), encoder="string", index=True, index_type="doc_index"),
                      FieldSpec("kind", T.StringType(), encoder="string", index=True, index_type="categorical", index_path=str(tmp_path / "kinds"))), base_path=out)
    for k, rows in enumerate([[(1, "a b", "x")], [(2, "b b", "x")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        append_columns(spark.readStream.schema(schema).parquet(source), spec, None, str(tmp_path / "checkpoint"), "id").awaitTermination(60)
        assert spark.read.parquet(f"{out}/columns").count() == k + 1
    assert spark.read.parquet(f"{out}/columns").columns[:2] == ["id", "text"]
    assert catindex.cardinality(catindex.any_of(spark.read.parquet(str(tmp_path / "kinds")), ["x"])).first().n == 2
    assert {(r.token, r.id, r.freq) for r in spark.read.parquet(f"{out}/index/text").collect()} == {("a", 1, 1), ("b", 1, 1), ("b", 2, 2)}
