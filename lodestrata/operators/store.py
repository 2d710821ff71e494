"""Stored columns with what their spec declares: pages with a zone map, categorical bitmaps, text indexes.

Everything is written once under the spec's ``base_path`` (an index under its field's ``index_path``, if it names one)
and read back from there; no lookup touches the rows to rebuild an index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.container import write_columns
from ..steps import free
from . import catindex, postings
from .ordered import Ordered
from .pages import page_stats
from .project import FieldSpec, TableSpec, project

#: Runs of kept pages that are asked for by a literal filter; more are met by a join.
MOST_RANGES = 64


class ColumnStore:
    """A table written under ``base_path`` in the order of some of its columns."""

    def __init__(self, spark: SparkSession, spec: TableSpec, base_path: str | None = None):
        self.spark, self.spec, self.base = spark, spec, base_path or spec.base_path
        if not self.base:
            raise ValueError("a store needs a base path")

    def _field(self, column: str, index_type: str | None = None) -> FieldSpec:
        for f in self.spec.stored():
            if f.column == column and (index_type is None or (f.index and f.index_type == index_type)):
                return f
        raise KeyError(column if index_type is None else f"{column} has no index of type {index_type}")

    def index_path(self, column: str) -> str:
        return self._field(column).index_path or f"{self.base}/index/{column}"

    def write(self, df: DataFrame, order: list[str], page_rows: int, zones: list[str] | None = None) -> ColumnStore:
        """Columns, zone maps of ``zones`` (source order columns by default) and all declared indexes. ``order`` names stored columns."""
        ordered = Ordered(project(df, self.spec), order)
        rows = ordered.positions().withColumn("page_id", F.floor(F.col("row_pos") / page_rows))
        write_columns(rows, f"{self.base}/columns", page_rows=page_rows)
        free(ordered.df)
        rows = self.rows()
        for column in zones or order:
            write_columns(page_stats(rows, column), f"{self.base}/pages/{column}")
        for f in self.spec.stored():
            if f.index and f.index_type == "categorical":
                write_columns(catindex.bitmaps(rows, f.column), self.index_path(f.column))
            elif f.index:
                # a lookup of a token that is nowhere ends at the Bloom filters of the row groups
                write_columns(postings.positional_index(rows, "row_pos", f.column).sortWithinPartitions("token"), self.index_path(f.column), bloom=["token"])
                write_columns(self._directory(rows, f.column), f"{self.index_path(f.column)}_directory")
        return self

    @staticmethod
    def _directory(rows: DataFrame, column: str) -> DataFrame:
        """(row_pos, n_tokens, n_distinct, size, start): where each text would stand if all were written one after the other."""
        of = postings.directory(rows, "row_pos", column)
        sizes = rows.select("row_pos", F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint").alias("size"))
        ends = Ordered(sizes, ["row_pos"]).running_sum("size", "end")
        return ends.withColumn("start", F.col("end") - F.col("size")).drop("end").join(of, "row_pos")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/columns")

    def zone_map(self, column: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/pages/{column}")

    def scan(self, column: str, keep: Column) -> DataFrame:
        """All rows of the pages whose stored statistics of ``column`` meet ``keep``; other pages aren't read.

        Neighbouring pages make one run; the runs' bounds reach the scan as filters on ``page_id``, which the files are sorted by.
        """
        pages = self.zone_map(column).where(keep).select("page_id")
        island = F.col("page_id") - F.row_number().over(Window.orderBy("page_id"))
        runs = pages.withColumn("run", island).groupBy("run").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        found = runs.limit(MOST_RANGES + 1).collect()
        if len(found) > MOST_RANGES:
            return self.rows().join(pages, "page_id", "left_semi")
        wanted = [F.col("page_id").between(r["first"], r["last"]) for r in found]
        return self.rows().where(reduce(lambda a, b: a | b, wanted, F.lit(False)))

    def categorical(self, column: str) -> DataFrame:
        """(value, bucket, bitmap) as stored."""
        self._field(column, "categorical")
        return self.spark.read.parquet(self.index_path(column))

    def tokens(self, column: str) -> DataFrame:
        """(row_pos, token, positions) as stored."""
        self._field(column, "doc_index")
        return self.spark.read.parquet(self.index_path(column))

    def directory(self, column: str) -> DataFrame:
        self._field(column, "doc_index")
        return self.spark.read.parquet(f"{self.index_path(column)}_directory")

    def search(self, column: str, phrase: list[str]) -> DataFrame:
        """(row_pos) of the texts with the phrase."""
        return postings.search_index(self.tokens(column), "row_pos", phrase)
