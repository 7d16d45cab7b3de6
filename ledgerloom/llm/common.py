"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import remove_folder, scratch_folder

WHITE = b" \t\n\r\x0b\x0c"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PACKAGE = "ledgerloom"
#: The most bytes of a batch that goes to a Python worker, where the session doesn't say.
BATCH_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Applications whose executors were sent the package.
_shipped: set[str] = set()
_held: list[Broadcast] = []
#: Folders of stored rows, in order.
_stored: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, label: str, **options: str) -> DataFrame:
    """``rows`` written to the shared scratch folder and read again: computed once, and safe from lost executors. ``options`` are the writer's."""
    path = scratch_folder(rows.sparkSession, label)
    rows.write.options(**options).parquet(path)
    _stored.append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers of this session find the package also where it isn't installed, and get batches they can hold.

    A cluster's executors are sent the package. The bound on a batch's bytes is left alone where the session has its own.
    """
    context = spark.sparkContext
    context.environment.setdefault("PYTHONPATH", ROOT)
    if not context.master.startswith("local[") and context.master != "local" and context.applicationId not in _shipped:
        context.addPyFile(_package())
        _shipped.add(context.applicationId)
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(ARROW_BYTES))


def stored_count() -> int:
    return len(_stored)


def forget_stored(spark: SparkSession, since: int) -> None:
    """Remove what was stored after the first ``since`` but for the last; for a job that goes on from that alone."""
    while len(_stored) > since + 1:
        remove_folder(spark, _stored.pop(since))


def shared(spark: SparkSession, value):
    """``value`` broadcast, until :func:`release` is called."""
    held = spark.sparkContext.broadcast(value)
    _held.append(held)
    return held


def release() -> None:
    """Executors drop what was broadcast so far. What is still needed is sent again."""
    while _held:
        _held.pop().unpersist()


def _package() -> str:
    """A zip file of the package's modules, in a folder of the driver's own."""
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return shutil.make_archive(f"{folder}/ledgerloom", "zip", ROOT, PACKAGE)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that hands free memory back when its task ends, as workers live on for other tasks."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:  # glibc
                trim(0)

    return tidy


def texts(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def word_blocks(text: bytes, most_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII white space of a UTF-8 text, A-Z in lower case, about ``most_bytes`` of text at a time."""
    start = 0
    while start < len(text):
        end = start + most_bytes
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[start:end].lower().split()
        start = end


def small(rows: DataFrame, most_rows: int) -> DataFrame:
    """``rows``, marked for broadcasting if counted as ``most_rows`` at most; else joins shuffle them. Results are alike."""
    return F.broadcast(rows) if rows.count() <= most_rows else rows


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most_bytes`` of ``column`` at most, or one row."""
    sizes = (x or 0 for x in _lengths(batch.column(column)))
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if row > start and total + size > most_bytes:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> Iterable[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()
