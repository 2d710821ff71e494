"""Column containers, byte sections and column files, all on Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Container:
    """Byte columns by id, one partition folder per id, so that reading one id touches no other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def write(self, columns: DataFrame) -> None:
        """Add (column_id, bytes) rows; an id that is there already is an error."""
        repeated = columns.groupBy("column_id").count().where("count > 1").limit(1).count()
        if repeated or (self._exists() and columns.join(self.spark.read.parquet(self.path).select("column_id").distinct(), "column_id", "left_semi").limit(1).count()):
            raise ValueError("column ids must be unique")
        columns.write.mode("append").partitionBy("column_id").parquet(self.path)

    def column(self, column_id: int) -> DataFrame:
        """(bytes) of one column; an unknown id is an error."""
        found = self.columns([column_id]) if self._exists() else None
        if found is None or found.isEmpty():
            raise KeyError(column_id)
        return found.select("bytes")

    def columns(self, column_ids: list[int]) -> DataFrame:
        """(column_id, bytes) of those that there are."""
        return self.spark.read.parquet(self.path).where(F.col("column_id").isin(column_ids))


def section(data: Column, offset: Column, length: Column) -> Column:
    """``length`` bytes or characters from ``offset``; past the end there is nothing."""
    return F.substring(data, offset + 1, length)


def strict_section(data: Column, size: Column, offset: Column, length: Column) -> Column:
    """As ``section``, but an offset past the end is an error."""
    return F.when(offset <= size, section(data, offset, length)).otherwise(F.raise_error(F.lit("seek past the end")))


def write_columns(df: DataFrame, path: str, page_rows: int | None = None, bloom: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Column files with page statistics, and Bloom filters for the ``bloom`` columns."""
    writer = df.write.mode(mode)
    if page_rows:
        writer = writer.option("parquet.page.row.count.limit", page_rows)
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
