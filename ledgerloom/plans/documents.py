"""Journal and document headers stored side by side: bucketed by document, so that they join where they lie.

Both tables are dealt by the document's key and a piece number into the same number of buckets, a file each. A join by
those columns then needs no exchange on either side, however often it is made. Documents so large that they would
fill more than their bucket have their lines dealt to several pieces, and their header stored once for each; lines
without a whole key match no header and are dealt to all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.star import estimated_bytes, find_spread, piece_of, pieces_of
from ledgerloom.plans.dimensions import Raw
from ledgerloom.plans.postings import SIDES, SPREAD_BY, journal_lines, packed
from ledgerloom.plans.runs import STORED

HEADER = SIDES["bkpf"]
KEY = tuple(HEADER.on)
PIECE = "_piece"
#: Bytes of the journal's extract, about, that a bucket holds.
BUCKET_BYTES = 256 * 1024 * 1024


def bucket_count(spark: SparkSession, journal: DataFrame) -> int:
    """As many buckets as the journal fills, and no fewer than a shuffle has partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(estimated_bytes(journal) / BUCKET_BYTES))


def store_documents(
    spark: SparkSession, raw: Raw, lines_table: str, headers_table: str, folder: str, buckets: int | None = None, lenient: bool = False
) -> None:
    """Write journal lines, with business names, and headers as bucketed tables of the catalog below ``folder``."""
    buckets = buckets or bucket_count(spark, raw["acdoca"])
    lines, headers = packed(journal_lines(raw["acdoca"], lenient)), HEADER.project(raw["bkpf"])
    spread = find_spread(lines, [HEADER], buckets)[HEADER.name]
    # A missing key is dealt to every bucket, at no cost: there is no header to repeat.
    lines = lines.withColumn(PIECE, piece_of(HEADER, spread, SPREAD_BY, missing=buckets))
    headers = headers.withColumn(PIECE, F.explode(pieces_of(HEADER, spread)))
    headers = headers.withColumnsRenamed({HEADER.key(k): k for k in KEY})
    for rows, table in ((lines, lines_table), (headers, headers_table)):
        where = f"{folder.rstrip('/')}/{table.rsplit('.', 1)[-1]}"
        # Dealt as the buckets are, so that each is one file.
        rows.repartition(buckets, *KEY, PIECE).write.options(**STORED).bucketBy(buckets, *KEY, PIECE).option("path", where).saveAsTable(table)


def lines_with_header(spark: SparkSession, lines_table: str, headers_table: str) -> DataFrame:
    """Journal lines with the columns of their document header, joined bucket by bucket."""
    headers = spark.table(headers_table).hint("merge")
    return spark.table(lines_table).join(headers, [*KEY, PIECE], "left").drop(PIECE)
