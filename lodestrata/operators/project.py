"""Table specs, projection and merging of row records."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODERS = ("bitpack", "string", "delta")
INDEX_TYPES = ("doc_index", "categorical")


@dataclass(frozen=True)
class FieldSpec:
    """One field: its name in the source and how it is stored."""

    name: str
    type: T.DataType = field(default_factory=T.LongType)
    rename: str | None = None
    skip: bool = False
    encoder: str = "bitpack"
    index: bool = False
    index_type: str | None = None
    index_path: str | None = None

    def __post_init__(self) -> None:
        if self.encoder not in ENCODERS:
            raise ValueError(f"{self.name}: unknown encoder {self.encoder!r}")
        if self.index and self.index_type not in INDEX_TYPES:
            raise ValueError(f"{self.name}: an index needs one of the types {', '.join(INDEX_TYPES)}")

    @property
    def column(self) -> str:
        return self.rename or self.name


@dataclass(frozen=True)
class TableSpec:
    """A fixed schema. ``base_path`` is where it is written."""

    fields: tuple[FieldSpec, ...]
    base_path: str | None = None

    @classmethod
    def of(cls, columns: dict[str, dict], **table: object) -> TableSpec:
        """From plain dictionaries; unknown keys are errors on both levels."""
        known = {f.name for f in fields(FieldSpec)} - {"name"}
        for name, options in columns.items():
            if extra := set(options) - known:
                raise ValueError(f"{name}: unknown attributes {sorted(extra)}")
        if extra := set(table) - {"base_path"}:
            raise ValueError(f"unknown table attributes {sorted(extra)}")
        return cls(tuple(FieldSpec(n, **o) for n, o in columns.items()), **table)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type, False) for f in self.fields])

    def stored(self) -> list[FieldSpec]:
        return [f for f in self.fields if not f.skip]


def to_columns(spark: SparkSession, spec: TableSpec, rows: Iterable) -> DataFrame:
    """Row records as the stored columns."""
    return project(spark.createDataFrame(list(rows), spec.schema), spec)


def project(df: DataFrame, spec: TableSpec, allowed: Iterable[str] | None = None) -> DataFrame:
    """The spec's stored columns under their stored names.

    ``allowed`` keeps only fields whose source name it holds; unknown names are
    ignored. It holds for the whole table, so columns never differ in length.
    """
    wanted = None if allowed is None else set(allowed)
    return df.select(*(F.col(f.name).alias(f.column) for f in spec.stored() if wanted is None or f.name in wanted))


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats included, columns matched by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
