"""Key table: ids to payloads, with ordered multi-get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an id's header by id type, and headers that a bucket aims at.
HEADER_BYTES = {"u16": 14, "u32": 16, "u64": 20}
BUCKET_BYTES = 512


def share_payload(rows: DataFrame, ids: str, payload: str) -> DataFrame:
    """(id, payload) where many ids share one payload."""
    return rows.select(F.explode(ids).alias("id"), F.col(payload).alias("payload"))


def bucket_count(rows: int, kind: str = "u64") -> int:
    if not rows:
        raise ValueError("no rows to write")
    return rows * HEADER_BYTES[kind] // BUCKET_BYTES + 1


def bucket_histogram(table: DataFrame, key: str, kind: str = "u64") -> DataFrame:
    """(bucket, n) under id modulo the number of buckets."""
    buckets = bucket_count(table.count(), kind)
    return table.groupBy(F.pmod(F.col(key), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def write(table: DataFrame, name: str, key: str = "id", buckets: int = 8) -> None:
    """As a bucketed, sorted table: a lookup reads the buckets of its ids only. No rows are an error."""
    if table.isEmpty():
        raise ValueError("no rows to write")
    table.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def multi_get(spark: SparkSession, table: DataFrame, key: str, payload: str, wanted: list[int], seq: str | None = None) -> DataFrame:
    """(ordinal, id, found, payload) for every requested id in order, repeats kept.

    An id that isn't there gets a row with ``found`` false; of several rows with
    one id the first by ``seq`` counts. The request is a literal list, so the
    filter on it reaches the scan.
    """
    asked = spark.createDataFrame([(k, i) for k, i in enumerate(wanted)], "ordinal long, id long")
    held = table.where(F.col(key).isin(list(dict.fromkeys(wanted)))).select(F.col(key).cast("long").alias("id"), F.col(payload).alias("payload"), *([seq] if seq else []))
    first = F.min_by("payload", seq) if seq else F.min("payload")
    one = held.groupBy("id").agg(first.alias("payload"), F.lit(True).alias("found"))
    return asked.join(one, "id", "left").select("ordinal", "id", F.coalesce("found", F.lit(False)).alias("found"), "payload").orderBy("ordinal")
