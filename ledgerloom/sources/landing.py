"""Reading headered CSV extracts against their contracts."""

from __future__ import annotations

import csv
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.sources.contracts import CONTRACTS, contract

INGESTION_TS = "_ingestion_ts"
SOURCE_FILE = "_source_file"
RESCUED = "_rescued_data"
#: How many rows a landed file holds at most: one task reads it, so tasks end at about the same time only if files are small.
FILE_ROWS = 200_000


class Misfits(Enum):
    """What becomes of rows that don't fit their contract."""

    STOP = "stop the load"
    RESCUE = "stay, with their text in the column _rescued_data"


def shaped(
    reader: DataFrameReader | DataStreamReader, schema: StructType, misfits: Misfits, line_breaks: bool = False, names: bool = True, text: str = RESCUED
):
    """Set a reader up for extracts with the header and columns of ``schema``.

    Another header, or another order of its names, always stops the load (``enforceSchema=False``).
    Whole rows are parsed (``columnPruning=False``), so that a misfit shows also in a count or a
    one-column select. ``names`` says whether headers are compared at all, ``text`` where a misfit's text goes. Cells may hold line breaks only if asked for: a file is then read by one task.
    """
    if misfits is Misfits.RESCUE:
        if text not in schema.fieldNames():
            schema = StructType([*schema.fields]).add(text, StringType(), True)
        reader = reader.option("columnNameOfCorruptRecord", text)
    return (
        reader.format("csv")
        .schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE" if misfits is Misfits.RESCUE else "FAILFAST")
        .option("enforceSchema", not names)
        .option("columnPruning", False)
        .option("multiLine", line_breaks)
    )


def with_lineage(df: DataFrame, file: Column | None = None) -> DataFrame:
    """Append load time and originating file, which is ``file`` where a frame has no metadata any more."""
    file = F.col("_metadata.file_path") if file is None else file
    return df.withColumns({INGESTION_TS: F.current_timestamp(), SOURCE_FILE: file})


def shape_of(spark: SparkSession, source: str, path: str, infer_types: bool = False) -> StructType:
    """The contract of a registered source, else the columns of the first header found: text, or inferred."""
    if source.upper() in CONTRACTS:
        return contract(source)
    return spark.read.csv(path, header=True, inferSchema=infer_types).schema


def read_extract(
    spark: SparkSession,
    source: str,
    path: str,
    misfits: Misfits = Misfits.STOP,
    lineage: bool = True,
    line_breaks: bool = False,
    infer_types: bool = False,
) -> DataFrame:
    """Load a source; one without a contract has all its files held to the first header."""
    shape = shape_of(spark, source, path, infer_types)
    df = shaped(spark.read, shape, misfits, line_breaks).load(path)
    return with_lineage(df) if lineage else df


def headers_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, header`` of every extract below ``path``: its first line."""
    first = F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), first.alias("place"), "value")
    lines = lines.filter("place.at = 0")
    return lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))


def read_reconciled(spark: SparkSession, source: str, path: str, lineage: bool = True) -> DataFrame:
    """A source whose files have their columns in orders of their own, or lack some, or have others.

    Each file is read by its own header and mapped to the contract by name. Columns that a file lacks are NULL.
    What has no place in the contract is kept in ``_rescued_data``, as JSON by column; so is the text of a row that
    doesn't fit its own header, under an empty name. Files of one header are read together.
    """
    names = contract(source).fieldNames()
    grouped = headers_of(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    parts = []
    for header, files in sorted(map(tuple, grouped.collect())):  # a row for each header that occurs
        own = next(csv.reader([header]), [])
        whole = StructType().add("", StringType())
        shape = StructType([StructField(c, StringType()) for c in own]).add(whole.fields[0])
        rows = shaped(spark.read, shape, Misfits.RESCUE, names=False, text="").load(files)
        rows = with_lineage(rows) if lineage else rows
        surplus = F.create_map(*[x for c in (*(c for c in own if c not in names), "") for x in (F.lit(c), F.col(f"`{c}`"))])
        surplus = F.map_filter(surplus, lambda _, value: value.isNotNull())
        rescued = F.when(F.size(surplus) > 0, F.to_json(surplus)).alias(RESCUED)
        cells = [(F.col(f"`{c}`") if c in own else F.lit(None).cast("string")).alias(c) for c in names]
        extra = [F.col(c) for c in (INGESTION_TS, SOURCE_FILE) if lineage]
        parts.append(rows.select(*cells, rescued, *extra))
    if not parts:
        raise FileNotFoundError(f"no extract below {path}")
    return reduce(DataFrame.unionByName, parts)


def source_path(landing_root: str, source: str) -> str:
    """A source lands as ``<SOURCE>.csv``: one file, or a folder of part files."""
    return f"{landing_root.rstrip('/')}/{source}.csv"


def land(df: DataFrame, source: str, landing_root: str, mode: str = "errorifexists") -> str:
    """Write a frame as an extract of ``source``, blanks kept; empty cells read back as NULL.

    Its files are gzipped, as their text takes several times the room otherwise. Such a file is read by one task, so none is large.
    """
    path = source_path(landing_root, source)
    writer = df.select(*contract(source).fieldNames()).write.mode(mode).option("header", True)
    writer = writer.option("compression", "gzip").option("zlib.compress.level", "FIVE").option("maxRecordsPerFile", FILE_ROWS)
    # The writer's default trims cells.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path
