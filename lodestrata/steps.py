"""Written steps: tables in the folder that driver and executors share.

A step cuts the lineage: a lost executor costs a re-read, not a re-computation. Every step
is deleted as soon as ``free`` or ``release`` says so, and at the latest when the driver's JVM ends
(the file system itself keeps that promise, so ``spark.stop()`` or a failure doesn't matter).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
#: Path of every step that still exists, with the file system and path objects that delete it.
_written: dict[str, tuple[object, object]] = {}
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, in local mode only.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def new_path(spark: SparkSession) -> str:
    """A fresh path for a step, which is deleted at the end unless it was before."""
    path = f"{shared_dir(spark)}/lodestrata/{uuid.uuid4().hex}"
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(sc._jsc.hadoopConfiguration())
    _written[path] = (files, where)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


def at_exit(path: str) -> None:
    """Have the file system delete what was written at ``path`` when the JVM ends."""
    files, where = _written[path]
    files.deleteOnExit(where)  # takes existing paths only


#: For rows of a hundred kilobytes and more: Parquet looks at the size of a page and of a row group every hundred rows, and holds all until then.
LONG_ROWS = {
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1000", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(2 << 20),
    "parquet.page.size": str(256 << 10), "parquet.enable.dictionary": "false",
}


def materialize(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    at_exit(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def _delete(path: str) -> None:
    files, where = _written.pop(path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


def free(*steps: DataFrame) -> None:
    """Delete steps that nothing will read again; frames that are no steps are passed over."""
    for step in steps:
        if getattr(step, "_step", None) in _written:
            _delete(step._step)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Steps that this thread writes inside are deleted at the end, but for those given to the function that this yields."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    mine: list[str] = []
    kept: set[str] = set()

    def keep(step: DataFrame) -> DataFrame:
        kept.add(step._step)
        return step

    _scopes.open.append(mine)
    try:
        yield keep
    finally:
        _scopes.open.pop()
        if _scopes.open:
            _scopes.open[-1].extend(p for p in mine if p in kept)
        for path in mine:
            if path not in kept and path in _written:
                _delete(path)


def existing() -> list[str]:
    """Paths of the steps that haven't been deleted."""
    return list(_written)


def release(but: list[str] | None = None) -> None:
    """Delete all steps, except those whose paths ``but`` holds. Results that read them must have been written."""
    for path in [p for p in _written if p not in (but or ())]:
        _delete(path)

