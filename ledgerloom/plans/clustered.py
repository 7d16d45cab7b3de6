"""Files that hold ranges of chosen columns, with the least and largest value of each kept beside them.

Filters on those columns name the files that may have rows, so the others aren't opened; what a file skipped by its
footer would cost is saved, too. Rows of one frequent value fill as many files as they need.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ledgerloom.operators.quality import enforce
from ledgerloom.operators.star import join_hints
from ledgerloom.plans.dimensions import CONFORMED_TS, Raw
from ledgerloom.plans.postings import FACT, LINEAGE, SIDES, enrich, journal_lines, ordered, packed, sides_of
from ledgerloom.plans.rules import RULES
from ledgerloom.plans.runs import STORED

FILE = "_file"
#: So many different values are counted, and dealt by their counts; of more, a sample shows the ranges.
COUNTED = 10_000


def dealt(rows: DataFrame, by: Sequence[str], files: int | None = None) -> DataFrame:
    """The rows, a range of ``by`` to each of ``files`` partitions.

    Values are counted first, for which no other column is computed. Where they are too many, ranges are found from a sample, for which
    ``rows`` is computed once more. Rows of one value fill as many partitions as they need, to which a hash of the whole row deals them.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith("map")])
    values = [F.col(c).alias(f"_value_{k}") for k, c in enumerate(by)]
    counts = rows.groupBy(*values).agg(F.count(F.lit(1)).alias("_n")).orderBy(*[f"_value_{k}" for k in range(len(by))]).limit(COUNTED + 1)
    found = counts.collect()
    if len(found) > COUNTED:
        return rows.repartitionByRange(*([files] if files else []), *[F.col(c) for c in by], spread)
    spark = rows.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places, before, total = [], 0, max(1, sum(r["_n"] for r in found))
    for row in found:
        first, last = before * files // total, (before + row["_n"] - 1) * files // total
        places.append((*row[: len(by)], first, last - first + 1))
        before += row["_n"]
    kinds = StructType([*counts.schema.fields[: len(by)]]).add("_first", IntegerType()).add("_pieces", IntegerType())
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"_value_{k}")) for k, c in enumerate(by)])
    placed = rows.join(F.broadcast(spark.createDataFrame(places, kinds)), same, "left")
    place = F.coalesce(F.col("_first") + F.pmod(spread, F.col("_pieces")).cast("int"), F.lit(0))
    return placed.withColumn("_place", place).repartitionById(files, F.col("_place")).select(*[F.col(f"`{c}`") for c in rows.columns])


def write_clustered(rows: DataFrame, folder: str, by: Sequence[str], files: int | None = None) -> None:
    """Write ``rows`` in files of ranges of ``by``, and the files' limits; ``files`` is a shuffle's partitions unless given."""
    write_dealt(dealt(rows, by, files), folder, by)


def write_dealt(rows: DataFrame, folder: str, by: Sequence[str]) -> None:
    """Write rows that :func:`dealt` has dealt, a file for each partition, and the files' limits.

    The limits are those of the files however the rows were dealt.
    """
    rows.sortWithinPartitions(*by).write.options(**STORED).parquet(f"{folder}/data")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/data")
    # Values are counted first: limits of texts are found by sorting, which few rows are left for.
    values = written.groupBy(F.col("_metadata.file_path").alias(FILE), *[F.col(c).alias(f"value_{k}") for k, c in enumerate(by)]).agg(F.count(F.lit(1)).alias("n"))
    limits = [f(f"value_{k}").alias(f"{name}_{k}") for k in range(len(by)) for name, f in (("least", F.min), ("most", F.max))]
    missing = [F.coalesce(F.sum(F.when(F.col(f"value_{k}").isNull(), F.col("n"))), F.lit(0)).alias(f"missing_{k}") for k in range(len(by))]
    limits = values.groupBy(FILE).agg(F.sum("n").alias("rows"), *limits, *missing)
    limits.coalesce(1).write.parquet(f"{folder}/limits-{uuid.uuid4().hex}")


def write_postings(raw: Raw, folder: str, by: Sequence[str], only: Collection[str] | None = None) -> None:
    """Write the fact clustered by columns of the journal.

    Where all sides are broadcast, lines are dealt before they are joined: the joins, which move no rows, are then made
    once, and narrow rows travel. A join by key would deal them anew, so then the fact is dealt when it is whole.
    """
    lines = enforce(journal_lines(raw["acdoca"]), RULES[FACT])
    hints = join_hints(lines.sparkSession, sides_of(raw, tuple(SIDES) if only is None else only))
    stamp = F.current_timestamp().alias(CONFORMED_TS)
    if all(hint == "broadcast" for hint in hints.values()):
        facts = ordered(enrich(dealt(packed(lines), by), raw, only, hints), LINEAGE)
        write_dealt(facts.select("*", stamp), folder, by)
    else:
        write_clustered(ordered(enrich(lines, raw, only, hints), LINEAGE).select("*", stamp), folder, by)


def _may_hold(place: int, values: Collection) -> Column:
    within = [F.lit(v).between(F.col(f"least_{place}"), F.col(f"most_{place}")) for v in values if v is not None]
    if None in values:
        within.append(F.col(f"missing_{place}") > 0)
    return reduce(or_, within, F.lit(False))


def files_with(spark: SparkSession, folder: str, by: Sequence[str], wanted: Mapping[str, Collection]) -> list[str]:
    """The files that may hold rows with one of the wanted values in each of the columns named; others of ``by`` are free."""
    limits = spark.read.parquet(f"{folder}/limits-*")
    chosen = [_may_hold(by.index(c), values) for c, values in wanted.items() if c in by]
    return [r[FILE] for r in limits.filter(reduce(and_, chosen, F.lit(True))).select(FILE).collect()]  # a row for each file


def read_clustered(spark: SparkSession, folder: str, by: Sequence[str], wanted: Mapping[str, Collection]) -> DataFrame:
    """The rows with one of the wanted values in each of the columns named, out of the files that may hold them."""
    schema = spark.read.parquet(f"{folder}/data").schema
    files = files_with(spark, folder, by, wanted)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for column, values in wanted.items():
        given = F.col(column).isin([v for v in values if v is not None])
        rows = rows.filter(given | F.col(column).isNull() if None in values else given)
    return rows
