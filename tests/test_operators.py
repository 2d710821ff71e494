import os
import random
import re
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import catindex, keytable, pages, postings
from lodestrata.operators.ordered import Ordered
from lodestrata.operators.project import FieldSpec, TableSpec, merge, project, to_columns


def test_rows_to_columns(spark):
    spec = TableSpec.of({"a": {"type": T.IntegerType()}, "b": {"type": T.FloatType(), "rename": "c"}, "d": {"type": T.StringType(), "skip": True}})
    df = to_columns(spark, spec, [(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, "z")])
    assert df.columns == ["a", "c"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert merge(df, df.select("c", "a")).count() == 6


def test_allow_list_names_the_source(spark):
    spec = TableSpec((FieldSpec("a", rename="x"), FieldSpec("b")))
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert project(df, spec, ["a", "unknown"]).columns == ["x"]
    assert project(df, spec, ["x"]).columns == []


def test_unknown_attributes_are_errors():
    with pytest.raises(ValueError, match="unknown attributes"):
        TableSpec.of({"a": {"colour": 1}})
    with pytest.raises(ValueError, match="unknown table"):
        TableSpec.of({"a": {}}, colour=1)
    with pytest.raises(ValueError, match="encoder"):
        FieldSpec("a", encoder="zip")
    with pytest.raises(ValueError, match="index"):
        FieldSpec("a", index=True)


@pytest.mark.parametrize("segments", [1, 3, 16])
def test_order_across_segments(spark, segments):
    rows = [(k, v) for k, v in zip(random.Random(1).sample(range(1000), 200), range(200), strict=True)]
    df = spark.createDataFrame(rows, "k long, v long")
    want = sorted(rows)
    placed = Ordered(df, ["k"], segments).positions().orderBy("row_pos").collect()
    assert [(r.k, r.v, r.row_pos) for r in placed] == [(k, v, i) for i, (k, v) in enumerate(want)]
    delta = Ordered(df, ["k"], segments).delta("v")
    assert [r.delta for r in delta.orderBy("k").collect()] == [want[0][1], *(b[1] - a[1] for a, b in zip(want, want[1:], strict=False))]
    back = Ordered(delta.select("k", "delta"), ["k"], segments).running_sum("delta", "v")
    assert sorted((r.k, r.v) for r in back.collect()) == want


def test_delta_of_the_fixture(spark):
    df = spark.createDataFrame([(0, 10), (1, 12), (2, 11)], "k long, v long")
    assert [r.delta for r in Ordered(df, ["k"], 2).delta("v").orderBy("k").collect()] == [10, 2, -1]
    assert Ordered(df.limit(0), ["k"], 2).delta("v").count() == 0


def test_pages_are_skipped_whole(spark):
    values = [*range(100, 151), *range(900, 951), *range(400, 451)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long")
    per_page = pages.values_per_page(10, 128)
    assert per_page == 51
    paged = pages.paged(df, ["k"], per_page)
    kept = pages.scan_pages(paged, "v", (F.col("min_value") >= 900) & (F.col("max_value") < 1000))
    assert sorted(r.v for r in kept.collect()) == list(range(900, 951))
    # a page that qualifies comes with all its values
    assert pages.scan_pages(paged, "v", F.col("max_value") >= 950).count() == 51
    assert pages.page_stats(pages.paged(df.limit(0), ["k"], 10), "v").count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    from lodestrata.sources.container import write_columns

    write_columns(spark.range(100000).withColumn("other", F.lit(1)), str(tmp_path / "t"), page_rows=1000, bloom=["id"])
    plan = spark.read.parquet(str(tmp_path / "t")).where("id between 5 and 14").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,5), LessThanOrEqual(id,14)]" in plan
    assert "ReadSchema: struct<id:bigint>" in plan


def test_categorical_index(spark):
    df = spark.createDataFrame(list(enumerate("abaca")), "row_pos long, value string")
    assert {r.value: r.positions for r in catindex.positions_by_value(df, "value").collect()} == {"a": [0, 2, 4], "b": [1], "c": [3]}
    index = catindex.bitmaps(df, "value")
    a, b = catindex.any_of(index, ["a"]), catindex.any_of(index, ["b"])
    assert catindex.cardinality(catindex.any_of(index, ["a", "b"])).first().n == 4
    assert catindex.cardinality(catindex.all_of(a, b)).first().n == 0
    assert catindex.cardinality(catindex.any_of(index, ["z"])).first().n == 0


def test_bitmaps_over_many_buckets(spark):
    df = spark.range(100_000).select(F.col("id").alias("row_pos"), (F.col("id") % 3).alias("x"), (F.col("id") % 5).alias("y"))
    x, y = catindex.any_of(catindex.bitmaps(df, "x"), [0]), catindex.any_of(catindex.bitmaps(df, "y"), [0, 1])
    assert catindex.cardinality(catindex.all_of(x, y)).first().n == sum(1 for i in range(100_000) if i % 3 == 0 and i % 5 in (0, 1))


def test_text_indexes(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.token): r.positions for r in postings.positional_index(docs, "doc_id", "text").collect()} == {(1, "a"): [0, 2], (1, "b"): [1], (2, "b"): [0], (3, ""): [0]}
    inverted = postings.inverted_index(docs, "doc_id", "text")
    assert {(r.token, r.doc_id): r.freq for r in inverted.collect()} == {("a", 1): 2, ("b", 1): 1, ("b", 2): 1, ("", 3): 1}
    asked = spark.createDataFrame([("a",), ("z",)], "token string")
    assert [r.token for r in postings.members(asked, "token", inverted).collect()] == ["a"]
    assert {r.doc_id: (r.n_tokens, r.n_distinct) for r in postings.directory(docs, "doc_id", "text").collect()} == {1: (3, 2), 2: (1, 1), 3: (1, 1)}


def test_multi_get_keeps_order_and_repeats(spark):
    shared = spark.createDataFrame([([1], b"Hello, Rust!"), ([2], b"Hello, 2!"), ([3, 4], b"Hello, 3,4!")], "ids array<long>, payload binary")
    table = keytable.share_payload(shared, "ids", "payload")
    rows = keytable.multi_get(spark, table, "id", "payload", [4, 555, 1, 4]).collect()
    assert [(r.id, r.found, r.payload) for r in rows] == [(4, True, b"Hello, 3,4!"), (555, False, None), (1, True, b"Hello, Rust!"), (4, True, b"Hello, 3,4!")]


def test_first_of_repeated_ids_counts(spark):
    table = spark.createDataFrame([(1, b"new", 2), (1, b"old", 1)], "id long, payload binary, seq long")
    assert keytable.multi_get(spark, table, "id", "payload", [1], "seq").first().payload == b"old"


def test_bucketed_table_prunes_buckets(spark, tmp_path):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        spark.sql("drop table if exists keyed")
        spark.range(1000).withColumn("payload", F.lit(b"x")).write.mode("overwrite").option("path", str(tmp_path / "keyed")).bucketBy(8, "id").sortBy("id").saveAsTable("keyed")
        plan = spark.table("keyed").where("id in (5, 77)")._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 2 out of 8" in plan
    finally:
        spark.sql("drop table if exists keyed")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_stored_table_and_its_indexes(spark, tmp_path):
    from lodestrata.operators.store import ColumnStore

    words = ["ash", "birch", "cedar"]
    df = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("k"), (F.col("id") % 3).cast("string").alias("kind"), F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, words)), (F.col("id") % m % 3 + 1).cast("int")) for m in (3, 5))).alias("text"))
    spec = TableSpec((FieldSpec("k", rename="key"), FieldSpec("kind", index=True, index_type="categorical"), FieldSpec("text", index=True, index_type="doc_index", index_path=str(tmp_path / "words"))), base_path=str(tmp_path / "t"))
    ColumnStore(spark, spec).write(df, ["key"], 1000)
    store = ColumnStore(spark, spec)  # opened anew: everything is read back
    kept = store.scan("key", (F.col("max_value") >= 3500) & (F.col("min_value") < 4500))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), GreaterThanOrEqual(page_id,3), LessThanOrEqual(page_id,4)]" in plan and "Exchange" not in plan
    assert sorted(r.key for r in kept.collect()) == list(range(3000, 5000))
    assert store.scan("key", F.lit(False)).count() == 0
    assert store.scan("key", F.col("page_id") % 2 == 0).count() == 10_000
    index = store.categorical("kind")
    assert "Window" not in index._jdf.queryExecution().executedPlan().toString()
    assert catindex.cardinality(catindex.any_of(index, ["0", "2"])).first().n == df.where("kind <> '1'").count()
    rows = {r.row_pos: r.text for r in store.rows().collect()}
    assert {r.row_pos for r in store.search("text", ["birch", "ash"]).collect()} == {p for p, t in rows.items() if t == "birch ash"}
    start = 0
    for r in store.directory("text").orderBy("row_pos").limit(100).collect():
        text = rows[r.row_pos]
        assert (r.start, r.size, r.n_tokens, r.n_distinct) == (start, len(text), 2, len(set(text.split())))
        start += r.size
    with pytest.raises(KeyError):
        store.tokens("kind")


def test_bloom_filter_answers_for_absent_tokens(spark, tmp_path):
    from lodestrata.sources.container import write_columns

    index = spark.range(50_000).select(F.concat(F.lit("w"), F.col("id") * 2).alias("token"), "id").repartition(4)
    write_columns(index, str(tmp_path / "t"), bloom=["token"])

    def read(token):
        found = spark.read.parquet(str(tmp_path / "t")).where(F.col("token") == token)
        found.collect()
        scan = re.search(r"FileScan", found._jdf.queryExecution().executedPlan().toString())
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan and "EqualTo(token" in leaf.toString()
        return leaf.metrics().apply("numOutputRows").value()

    # within the range of all row groups, yet not in them: nothing is read but filters
    assert read("w30001") == 0
    assert read("w30000") > 0


def test_key_tables_are_written(spark):
    rows = spark.range(100).select("id", F.col("id").cast("string").alias("payload"))
    try:
        keytable.write(rows, "written_keys", buckets=4)
        got = keytable.multi_get(spark, spark.table("written_keys"), "id", "payload", [5, 500]).collect()
        assert [(r.id, r.found, r.payload) for r in got] == [(5, True, "5"), (500, False, None)]
        with pytest.raises(ValueError, match="no rows"):
            keytable.write(rows.limit(0), "written_keys_2")
    finally:
        spark.sql("drop table if exists written_keys")


def test_hot_first_key_and_nulls(spark):
    df = spark.createDataFrame([(1, k, k * 3) for k in range(1000)], "a long, b long, v long")
    ordered = Ordered(df, ["a", "b"], 8)
    assert ordered.df.groupBy("__segment").count().agg(F.max("count")).first()[0] < 400
    assert sorted((r.row_pos, r.b) for r in ordered.positions().collect()) == [(k, k) for k in range(1000)]
    for segments in (1, 2):
        with pytest.raises(Exception, match="null has no difference"):
            Ordered(spark.createDataFrame([(0, 5), (1, None), (2, 7)], "k long, v long"), ["k"], segments).delta("v").collect()


def test_steps_are_deleted(spark, tmp_path):
    from lodestrata import steps

    before = set(steps.existing())
    with steps.scope() as keep:
        first = steps.materialize(spark.range(3))
        second = keep(steps.materialize(first))
        third = steps.materialize(second)
        steps.free(third)
    assert set(steps.existing()) - before == {second._step} and second.count() == 3
    where = second._step.removeprefix("file:")
    assert os.path.isdir(where.replace("//", "/"))
    steps.free(second)
    assert not os.path.exists(where.replace("//", "/")) and set(steps.existing()) == before


def test_no_step_is_left_behind_a_driver(tmp_path):
    """Neither after stop() nor at the end: results that nobody freed go with the driver."""
    code = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "from lodestrata import steps\n"
        "steps.materialize(s.range(3)); s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True)
    for _ in range(50):  # the JVM ends a little after the driver
        if not list(tmp_path.rglob("*.parquet")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.rglob("*.parquet"))


def test_buckets():
    assert keytable.bucket_count(15000) == 15000 * 20 // 512 + 1
    with pytest.raises(ValueError, match="no rows"):
        keytable.bucket_count(0)
