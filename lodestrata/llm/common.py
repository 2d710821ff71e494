"""What the training-data operators share: tables, keys, materialised steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import steps
from ..steps import free, scope, shared_dir  # noqa: F401

#: ASCII white space, the only characters that part words in every contract here.
BLANKS = b" \t\n\x0b\x0c\r"

#: Bytes of a batch that Spark hands to Python; texts are long, and the default is 64 MB.
ARROW_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever it was started from."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_lodestrata_sent", False) or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="lodestrata-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._lodestrata_sent = True


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds of its input on both sides of the Arrow channel."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


_resident: tuple[object, object] = (None, None)


def resident(key: object = None, make: Callable[[], object] | None = None) -> object:
    """A tool that a worker process keeps for its next tasks; one at a time, so
    that the caches of one operator don't outlive it. Without a key: none.
    """
    global _resident
    if _resident[0] != key:
        _resident = (None, None)
        _resident = (key, make() if make else None)
    return _resident[1]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null ids: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def materialize(df: DataFrame, long_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (see ``steps``)."""
    small_batches(df.sparkSession)
    return steps.materialize(df, steps.LONG_ROWS if long_rows else None)


def condensed(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as one step; all steps written on the way are deleted."""
    with scope() as keep:
        return keep(materialize(make()))


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text as UTF-8 bytes), nothing else: other columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))


#: Least and most bits of the bitmap that says which ids are wanted (2 MB to 128 MB).
FILTER_BITS, MOST_FILTER_BITS = 1 << 24, 1 << 30


def marked(docs: DataFrame, ids: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, kinds: str = "doc_id long, raw binary") -> DataFrame:
    """(doc_id, raw) of at least all rows whose id is in ``ids`` (id), or what ``each`` makes of them.

    A bitmap of eight bits an id, in the limits above, goes to the executors, so that a later shuffle leaves
    out most other texts; beyond its largest size it lets more pass, which only costs time.
    """
    bits_ = FILTER_BITS
    wanted_ids = ids.count()
    while bits_ < min(MOST_FILTER_BITS, 8 * wanted_ids):
        bits_ *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits_)) + 1
    placed = ids.select(place(F.col("id")).alias("h"))
    parts = placed.groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    bits = np.zeros(bits_ // 8, dtype=np.uint8)
    for r in parts:
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in batches:
            h = batch.column(2).to_numpy() - 1
            yield batch.select(["doc_id", "raw"]).filter(pa.array((bitmap[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        return each(wanted(batches)) if each else wanted(batches)

    texts = id_and_bytes(docs).where("doc_id is not null")
    return texts.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h", place(F.col("doc_id"))).mapInArrow(made, kinds)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
