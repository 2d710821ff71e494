"""Categorical index: the positions of every value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positions_by_value(df: DataFrame, value: str, position: str = "row_pos") -> DataFrame:
    """(value, positions), the positions in order."""
    return df.groupBy(value).agg(F.sort_array(F.collect_set(position)).alias("positions"))


def bitmaps(df: DataFrame, value: str, position: str = "row_pos") -> DataFrame:
    """(value, bucket, bitmap): 32768 positions a bucket, so no group grows with the table."""
    at = F.col(position) + 1  # buckets count from 1
    placed = df.select(F.col(value).alias("value"), F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    return placed.groupBy("value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def any_of(index: DataFrame, values: list) -> DataFrame:
    """(bucket, bitmap) of the positions that hold one of ``values``."""
    return index.where(F.col("value").isin(values)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def all_of(*parts: DataFrame) -> DataFrame:
    """(bucket, bitmap) of the positions in every part; a missing bucket is empty."""
    every = reduce(DataFrame.union, parts)
    held = every.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n"))
    return held.where(F.col("n") == len(parts)).drop("n")


def cardinality(found: DataFrame) -> DataFrame:
    """(n): how many positions are set."""
    return found.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("bigint").alias("n"))
