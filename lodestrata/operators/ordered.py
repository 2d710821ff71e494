"""Global order without a single-task window.

Rows are dealt into ranges of all order keys together, so that many rows with one first key
don't fall into one range, and sorted inside their task. The sorted rows are written once, each with its range and its
place in it. What crosses ranges (counts, sums, last values) is one small row per range, joined back.

Equal rows may come in any order among themselves, as in any sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import materialize

SEGMENT, PLACE = "__segment", "__place"
#: The lower bits of a monotonically increasing id count the rows of a task.
_IN_TASK = (1 << 33) - 1


class Ordered:
    """``df`` in the total order of ``keys`` (nulls first), in ranges."""

    def __init__(self, df: DataFrame, keys: list[str], segments: int | None = None):
        n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))
        self.df = materialize(dealt.withColumn(SEGMENT, F.spark_partition_id()).withColumn(PLACE, in_task))
        self.window = Window.partitionBy(SEGMENT).orderBy(PLACE)

    def _carried(self, name: str, value: Column, over: Column) -> DataFrame:
        """The rows with ``name``: what the ranges before a row's one give, as ``over`` of their values."""
        totals = self.df.groupBy(SEGMENT).agg(value.alias("__value"))
        # one row per range: a window over all of them is small
        before = totals.select(SEGMENT, over.alias(name))
        return self.df.join(F.broadcast(before), SEGMENT)

    @property
    def _ranges_before(self) -> Window:
        return Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)

    def positions(self, name: str = "row_pos") -> DataFrame:
        """``df`` with contiguous positions from 0."""
        rows = self._carried("__before", F.count("*"), F.coalesce(F.sum("__value").over(self._ranges_before), F.lit(0)))
        return rows.withColumn(name, F.col(PLACE) + F.col("__before")).drop(SEGMENT, PLACE, "__before")

    def delta(self, column: str, name: str = "delta") -> DataFrame:
        """``df`` with the first value as it is, and then differences. A null value has no code: an error."""
        last = F.last("__value").over(self._ranges_before)
        value = F.coalesce(F.col(column), F.raise_error(F.lit(f"{column}: null has no difference")).cast("bigint"))
        rows = self._carried("__before", F.max_by(column, PLACE), last).withColumn("__value", value)
        last = F.coalesce(F.lag("__value").over(self.window), F.col("__before").cast("bigint"), F.lit(0))
        return rows.withColumn(name, F.col("__value") - last).drop(SEGMENT, PLACE, "__before", "__value")

    def running_sum(self, column: str, name: str) -> DataFrame:
        """``df`` with the sum of all values up to each row: the inverse of ``delta``."""
        before = F.coalesce(F.sum("__value").over(self._ranges_before).cast("bigint"), F.lit(0))
        inside = F.sum(column).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        return self._carried("__before", F.sum(column), before).withColumn(name, inside + F.col("__before")).drop(SEGMENT, PLACE, "__before")
