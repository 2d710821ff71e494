"""Incremental column files and their indexes from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.catindex import bitmaps
from ..operators.postings import inverted_index
from ..operators.project import TableSpec, project


def append_columns(stream: DataFrame, spec: TableSpec, path: str | None, checkpoint: str, key: str | None = None, **trigger: object) -> StreamingQuery:
    """Append the spec's columns of every batch under ``path`` (the spec's ``base_path`` if None), and the indexes it declares.

    An index is by ``key``, a stored column: texts by token and key, categorical values by bitmaps over the keys (numbers from 0).
    Every batch replaces its own folders, so one that runs again after a failure doesn't double its rows.
    """
    base = path or spec.base_path
    if not base:
        raise ValueError("neither a path nor a base path")
    indexed = [f for f in spec.stored() if f.index]
    if indexed and key not in [f.column for f in spec.stored()]:
        raise ValueError("an index needs a key among the stored columns")

    def write(batch: DataFrame, number: int) -> None:
        rows = project(batch, spec)
        rows.write.mode("overwrite").parquet(f"{base}/columns/batch={number}")
        for f in indexed:
            index = inverted_index(rows, key, f.column) if f.index_type == "doc_index" else bitmaps(rows, f.column, key)
            index.write.mode("overwrite").parquet(f"{f.index_path or f'{base}/index/{f.column}'}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
