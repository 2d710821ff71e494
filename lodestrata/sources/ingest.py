"""Delimited sources with renames, strict coercion and fields that aren't loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import DEFAULTS, empty_to_default, number_list


@dataclass(frozen=True)
class Source:
    """A target column: its header in the source (None: not loaded, takes the default) and its type."""

    name: str
    kind: str
    header: str | None = ""

    def column(self) -> F.Column:
        header = self.name if self.header == "" else self.header
        if header is None:
            return F.lit(DEFAULTS[self.kind]).cast(self.kind).alias(self.name)
        made = number_list(F.col(header)) if self.kind == "array<int>" else empty_to_default(F.col(header), self.kind)
        return made.alias(self.name)


def coerce(raw: DataFrame, sources: list[Source]) -> DataFrame:
    """All-text columns as typed ones; nothing is null afterwards."""
    return raw.select(*(s.column() for s in sources))


def read_delimited(spark: SparkSession, path: str, sources: list[Source], separator: str = ",") -> DataFrame:
    """Every source column is read as text, never inferred."""
    return coerce(spark.read.option("header", True).option("sep", separator).option("inferSchema", False).csv(path), sources)
