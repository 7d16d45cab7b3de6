"""Loading landed files once each, into a generation of a stored table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.runs import BATCH, STORED
from ledgerloom.sources.landing import SOURCE_FILE, Misfits, shape_of, shaped, source_path, with_lineage

#: The file that a row came from and its size, which stay in a batch's files and are no columns of the table. With lineage, the table has the file.
LOAD_COLUMNS = ("_load_file", "_load_bytes")

#: A load's tasks for each core, at least. Gzipped files can't be split; dealt to about as many tasks as there are cores, most cores wait for a few.
TASKS_PER_CORE = 4
LEAST_TASKS = "spark.sql.files.minPartitionNum"

#: Told of every batch written: its number, its rows, and its files as ``file, bytes, rows``.
Note = Callable[[int, int, list[dict]], None]


def landed_files(
    spark: SparkSession, source: str, landing_root: str, misfits: Misfits = Misfits.STOP, lineage: bool = True
) -> DataFrame:
    """A source's file, or the files of its folder, as a stream under the same rules as a direct read."""
    path = source_path(landing_root, source)
    shape = shape_of(spark, source, path)
    # As a pattern the path may be that of a single file, too.
    rows = shaped(spark.readStream, shape, misfits).load(f"{path[:-1]}[v]")
    file, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    rows = rows.select("*", file.alias(LOAD_COLUMNS[0]), size.alias(LOAD_COLUMNS[1]))
    return with_lineage(rows, F.col(LOAD_COLUMNS[0])).drop(LOAD_COLUMNS[0]) if lineage else rows


@contextmanager
def finely_dealt(spark: SparkSession) -> Iterator[None]:
    """Within the block, files are dealt to several tasks for each core, unless they are too large for that."""
    before = spark.conf.get(LEAST_TASKS, None)
    spark.conf.set(LEAST_TASKS, max(int(before or 0), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(LEAST_TASKS) if before is None else spark.conf.set(LEAST_TASKS, before)


def start_load(rows: DataFrame, folder: str, state: str, note: Note) -> StreamingQuery:
    """Begin to write the files that ``state`` hasn't seen below ``folder``; ends by itself.

    Every batch has a folder that a repeated attempt writes anew, so a failed run can simply be repeated
    and no file is loaded twice. Files without rows aren't noted.
    """

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/{BATCH}={number}"
        batch.write.mode("overwrite").options(**STORED).parquet(path)
        file, size = LOAD_COLUMNS if LOAD_COLUMNS[0] in batch.columns else (SOURCE_FILE, LOAD_COLUMNS[1])
        written = batch.sparkSession.read.schema(batch.schema).parquet(path).groupBy(file, size).count().orderBy(file)
        files = [{"file": r[file], "bytes": r[size], "rows": r["count"]} for r in written.collect()]  # one row per file
        note(number, sum(f["rows"] for f in files), files)

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()


@contextmanager
def loading(spark: SparkSession) -> Iterator[list[StreamingQuery]]:
    """Wait for the loads that the block has begun and listed; they run side by side. All have ended before the first failure is raised."""
    started: list[StreamingQuery] = []
    failed = None
    with finely_dealt(spark):
        try:
            yield started
            for load in started:
                try:
                    load.awaitTermination()
                except PySparkException as error:
                    failed = failed or error
        finally:
            for load in started:
                load.stop()
    if failed:
        raise failed
