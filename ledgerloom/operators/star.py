"""Enrichment of a large fact with dimensions of any size.

A dimension is broadcast only after its rows and bytes were counted and found few; an
estimate from compressed files, or from before an aggregation, proves nothing. Every other
dimension is joined by key, and keys that hold a large share of the fact, as well as missing
keys, are spread over many partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.conform import Source, typed

BROADCAST_KEY = "ledgerloom.broadcast.bytes"
BROADCAST_BYTES = 64 * 1024 * 1024

# Least size of the heavy-hitter sketch: it cannot miss a key with half a percent of the rows; it grows with the
# number of partitions. What it misses is left to adaptive execution, which splits large partitions at run time.
TRACKED_KEYS = 4096
REPORTED_KEYS = 100
SKETCH_GROUPS = 256

# The share of rows without a key from which on they are left out of a join, and for how many joins at most.
KEYLESS, KEYLESS_SIDES = 0.1, 2

# What a row, and each of its cells, takes in a broadcast table besides the text itself.
ROW_BYTES = 48
CELL_BYTES = 16


@dataclass(frozen=True)
class Side:
    """One dimension of a star.

    ``on`` maps fact columns to the dimension's key columns and ``columns`` defines what
    to carry over. ``bounded`` marks dimensions whose size follows the
    organisation rather than the volume of postings, so that counting them is cheap.
    """

    name: str
    on: Mapping[str, str]
    columns: Mapping[str, Source | Callable[[], Column]] = field(default_factory=dict)
    bounded: bool = False
    how: str = "left"

    def project(self, dim: DataFrame) -> DataFrame:
        keys = [F.col(right).alias(self.key(left)) for left, right in self.on.items()]
        carried = [
            (source() if callable(source) else typed(source)).alias(name)
            for name, source in self.columns.items()
        ]
        return dim.select(*keys, *carried)

    def only(self, *columns: str) -> Side:
        """The same side, carrying fewer columns."""
        return replace(self, columns={c: self.columns[c] for c in columns})

    def required(self) -> Side:
        """The same side, keeping only the fact rows it matches."""
        return replace(self, how="inner")

    def key(self, left: str) -> str:
        return f"__{self.name}_{left}"

    @property
    def keys(self) -> list[str]:
        return [self.key(left) for left in self.on]


@dataclass(frozen=True)
class Spread:
    """Over how many partitions the rows of a hot key, or of no key, are spread."""

    hot: Mapping[str, int] = field(default_factory=dict)
    missing: int = 1
    #: The share of rows without a key.
    keyless: float = 0.0

    def __bool__(self) -> bool:
        return bool(self.hot) or self.missing > 1


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_KEY, str(BROADCAST_BYTES)))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured_bytes(frames: Mapping[str, DataFrame]) -> dict[str, int]:
    """Actual sizes of several frames, counted in one job that returns one row per frame."""
    if not frames:
        return {}

    def row_sizes(name: str, df: DataFrame) -> DataFrame:
        cells = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
        size = reduce(add, cells, F.lit(ROW_BYTES + CELL_BYTES * len(cells)).cast("bigint"))
        return df.select(F.lit(name).alias("name"), size.alias("bytes"))

    rows = reduce(DataFrame.unionAll, [row_sizes(name, df) for name, df in frames.items()])
    sizes = {row["name"]: row["bytes"] for row in rows.groupBy("name").agg(F.sum("bytes").alias("bytes")).collect()}
    return {name: sizes.get(name, 0) for name in frames}


def join_hints(spark: SparkSession, dims: Sequence[tuple[Side, DataFrame]]) -> dict[str, str | None]:
    """How each side is to be joined.

    Sides that may be small are measured, all in one job: those within the limit are
    broadcast, those beyond it never are. A side without a hint was too large to measure,
    and is left to adaptive execution, which goes by actual sizes.
    """
    limit = broadcast_limit(spark)
    projected = {side.name: side.project(dim) for side, dim in dims}
    candidates = {
        side.name: projected[side.name]
        for side, _ in dims
        if limit > 0 and (side.bounded or estimated_bytes(projected[side.name]) <= limit)
    }
    sizes = measured_bytes(candidates)
    hints = {name: "broadcast" if size <= limit else "merge" for name, size in sizes.items()}
    return {name: hints.get(name) for name in projected}


def composite(columns: Sequence[str]) -> Column:
    """One text key out of several columns; NULL if any of them is."""
    parts: list[Column] = []
    for column in columns:
        parts += [F.lit("\x1f"), F.col(column).cast("string")]
    return F.concat(*parts[1:])


def find_spread(fact: DataFrame, sides: Sequence[Side], partitions: int) -> dict[str, Spread]:
    """Find hot and missing keys of several joins in one pass over the fact's key columns.

    Input partitions are taken together in groups; a bounded sketch per group and join
    names the group's most frequent keys, whose counts are then added up. A key is spread
    once its rows fill more than two average partitions, in proportion to its share. What
    is found here decides only where rows travel, never which rows are joined.
    """
    if not sides:
        return {}
    # A key that fills two average partitions has as many rows as only half as many keys as partitions can have.
    reported, tracked = max(REPORTED_KEYS, partitions), max(TRACKED_KEYS, 4 * partitions)
    keyed = fact.select(*[composite(list(side.on)).alias(side.name) for side in sides])
    sketches = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[
            F.expr(f"approx_top_k(`{side.name}`, {reported}, {tracked})").alias(side.name)
            for side in sides
        ],
    )

    def counted(side: Side) -> Column:
        return F.transform(
            side.name,
            lambda found: F.struct(F.lit(side.name).alias("side"), found["item"].alias("key"), found["count"].alias("n")),
        )

    total = F.struct(F.lit("").alias("side"), F.lit("").alias("key"), F.col("__rows").alias("n"))
    frequent = (
        sketches.select(F.inline(F.concat(F.array(total), *[counted(side) for side in sides])))
        .groupBy("side", "key")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "side", "key")
        .limit(1 + reported * len(sides))
        .collect()
    )
    counts: dict[str, dict[str | None, int]] = {"": {}, **{side.name: {} for side in sides}}
    for row in frequent:
        counts[row["side"]][row["key"]] = row["n"]
    total_rows = counts[""].get("", 0)
    per_partition = max(1.0, total_rows / partitions)
    spreads = {}
    for side in sides:
        pieces = {key: min(partitions, int(n / per_partition)) for key, n in counts[side.name].items()}
        missing = max(1, pieces.pop(None, 1))
        keyless = counts[side.name].get(None, 0) / max(1, total_rows)
        spreads[side.name] = Spread({key: n for key, n in pieces.items() if n > 1}, missing, keyless)
    return spreads


def _pieces(spread: Spread, columns: Sequence[str]) -> Column:
    if not spread.hot:
        return F.lit(1)
    hot = F.create_map(*[F.lit(v) for pair in spread.hot.items() for v in pair])
    return F.coalesce(F.try_element_at(hot, composite(columns)), F.lit(1))


def piece_of(side: Side, spread: Spread, spread_by: Sequence[str], missing: int | None = None) -> Column:
    """The number of the piece of its key that a fact row belongs to, zero but for hot and missing keys.

    It follows from the row's own columns alone, so that filters pass below the join and a recomputed task gives the same one.
    """
    own = list(side.on)
    count = F.when(composite(own).isNull(), spread.missing if missing is None else missing).otherwise(_pieces(spread, own))
    return F.pmod(F.xxhash64(*[F.col(c) for c in (*own, *spread_by)]), count).cast("int")


def pieces_of(side: Side, spread: Spread) -> Column:
    """All piece numbers of the key of a dimension row, projected by its side."""
    return F.sequence(F.lit(0), _pieces(spread, side.keys) - 1)


def attach(
    fact: DataFrame,
    dim: DataFrame,
    side: Side,
    hint: str | None = None,
    spread: Spread = Spread(),
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Join one dimension, already projected by its side, to the fact.

    Rows of a hot key get a piece number and meet that key's dimension rows, repeated once
    per piece; rows without a key match nothing and are spread the same way.
    """
    dim = dim.hint(hint) if hint and not spread else dim
    if not spread:
        on = [F.col(left) == F.col(side.key(left)) for left in side.on]
        return fact.join(dim, on, side.how).drop(*side.keys)

    piece, dim_piece = f"__{side.name}_piece", f"__{side.name}_dim_piece"
    left = fact.withColumn(piece, piece_of(side, spread, spread_by))
    right = dim.withColumn(dim_piece, F.explode(pieces_of(side, spread)))
    right = right.hint(hint) if hint else right
    on = [F.col(name) == F.col(side.key(name)) for name in side.on]
    joined = left.join(right, [*on, F.col(piece) == F.col(dim_piece)], side.how)
    return joined.drop(piece, dim_piece, *side.keys)


def attach_keyed(
    fact: DataFrame, dim: DataFrame, side: Side, hint: str | None = None, spread: Spread = Spread(), spread_by: Sequence[str] = ()
) -> DataFrame:
    """The same rows as :func:`attach`, but those without a key never leave their task.

    They match nothing, so they get empty columns where they are read; only the others are joined. The fact is
    read twice for that, each time with a filter that its scan can take.
    """
    if side.how != "left":
        return attach(fact, dim, side, hint, spread, spread_by)
    missing = reduce(or_, [F.col(c).isNull() for c in side.on])
    keyed = attach(fact.filter(~missing), dim, side, hint, spread, spread_by)
    kinds = {field.name: field.dataType for field in dim.schema.fields}
    own = [F.lit(None).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in keyed.columns]
    return keyed.unionByName(fact.filter(missing).select(*own))


def star(
    fact: DataFrame,
    dims: Sequence[tuple[Side, DataFrame]],
    spread_by: Sequence[str] = (),
    hints: Mapping[str, str | None] | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Join every dimension to the fact.

    Joins by key come first, those that add least ahead of the others, while rows are
    narrow; broadcast joins then add their columns without moving rows again. Pass
    ``hints`` where :func:`join_hints` was already called for more dimensions at once, and
    ``keys``, rows with the fact's key columns, where the fact takes more to compute than they do.
    """
    spark = fact.sparkSession
    if hints is None:
        hints = join_hints(spark, dims)
    small = [(side, dim) for side, dim in dims if hints[side.name] == "broadcast"]
    large = [(side, dim) for side, dim in dims if hints[side.name] != "broadcast"]
    large.sort(key=lambda pair: len(pair[0].columns))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spreads = find_spread(fact if keys is None else keys, [side for side, _ in large], partitions)
    # Each of them has the fact read twice, so only sides that grow, and those with most rows to keep in place.
    keyless = [side.name for side, _ in large if not side.bounded and spreads[side.name].keyless >= KEYLESS]
    apart = sorted(keyless, key=lambda name: -spreads[name].keyless)[:KEYLESS_SIDES]
    # These come ahead of all others, whose joins would be made twice otherwise, once for either half of the rows.
    large.sort(key=lambda pair: apart.index(pair[0].name) if pair[0].name in apart else len(apart))
    for side, dim in large:
        join = attach_keyed if side.name in apart else attach
        fact = join(fact, side.project(dim), side, hints[side.name], spreads[side.name], spread_by)
    for side, dim in small:
        fact = attach(fact, side.project(dim), side, "broadcast")
    return fact


def duplicated_sides(dims: Sequence[tuple[Side, DataFrame]]) -> set[str]:
    """Names of the sides whose key is not unique, and which would therefore multiply rows.

    One job; every side contributes at most one row to the answer.
    """
    checks = [
        dim.select(*[F.col(right).alias(f"k{i}") for i, right in enumerate(side.on.values())])
        .dropna()
        .groupBy(*[f"k{i}" for i in range(len(side.on))])
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.lit(side.name).alias("name"), F.max("n").alias("n"))
        for side, dim in dims
    ]
    if not checks:
        return set()
    rows = reduce(DataFrame.unionAll, checks).collect()
    return {row["name"] for row in rows if (row["n"] or 0) > 1}
