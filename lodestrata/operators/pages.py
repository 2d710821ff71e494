"""Pages of values with statistics, and scans that skip them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered

PAGE_BYTES, HEADER_BYTES = 65536, 64


def values_per_page(width: int, page_bytes: int = PAGE_BYTES) -> int:
    """How many values of ``width`` bits fit behind a page's header."""
    return (page_bytes - HEADER_BYTES) * 8 // width if width else 65536


def paged(df: DataFrame, order: list[str], per_page: int) -> DataFrame:
    """``df`` with ``row_pos`` and the ``page_id`` it falls in."""
    return Ordered(df, order).positions().withColumn("page_id", F.floor(F.col("row_pos") / per_page))


def page_stats(pages: DataFrame, value: str) -> DataFrame:
    """(page_id, n, min_value, max_value)."""
    return pages.groupBy("page_id").agg(F.count("*").alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def scan_pages(pages: DataFrame, value: str, keep: Column) -> DataFrame:
    """All rows of the pages whose statistics meet ``keep``; not a filter on rows."""
    stats = page_stats(pages, value).where(keep).select("page_id")
    return pages.join(stats, "page_id", "left_semi")
