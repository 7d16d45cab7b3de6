"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every place, the polynomial of the code points before it, modulo a prime
and for two bases at once. Any span's hash is a difference of two entries, brought back to where the
span starts; spans are equal if their hashes are, and the longest common extension of two places is
found by binary search over span lengths.

A text's fingerprint is the hash of the whole text and a sketch: the SKETCH smallest of the mixed
hashes of its spans of WIDTH code points (all of them if there are fewer; a shorter text is one span).
The likeness of two fingerprints is the share of the two texts' spans that they have in common, as
their sketches tell it: 1 for equal texts, about 0.5 if half of the text is the same, exact for texts of
few spans. Two empty texts are alike, an empty and another text are not.

Rows: a null text counts as empty. Documents are ordered by descending doc_id, null last, then by a hash of the text, so
rows that repeat a doc_id follow each other; the first follows the last, and a single row itself. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, texts

P = (1 << 31) - 1
BASES = (1_000_003, 754_974_721)
WIDTH = 20
SKETCH = 64
#: Code points whose powers are kept, and that are hashed at a time.
BLOCK = 1 << 20
BATCH_BYTES = 8 << 20
#: Bytes of text of a part, about.
PART_BYTES = 64 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime P."""
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.where(x >= P, x - np.uint64(P), x)


@cache
def _powers(base: int) -> np.ndarray:
    made = np.ones(1, np.uint64)
    while len(made) < BLOCK:
        made = np.concatenate([made, _mod(made * np.uint64(pow(base, len(made), P)))])
    return made


@dataclass
class Sketched:
    """A fingerprint: the whole text's hash and its sketch, both as text and as numbers."""

    whole: int
    sketch: np.ndarray

    def __str__(self) -> str:
        return f"{self.whole:016x}" + self.sketch.astype(">u4").tobytes().hex()

    def likeness(self, other: Sketched) -> float:
        if self.whole == other.whole and np.array_equal(self.sketch, other.sketch):
            return 1.0
        if not len(self.sketch) or not len(other.sketch):
            return 0.0
        union = np.union1d(self.sketch, other.sketch)
        if max(len(self.sketch), len(other.sketch)) >= SKETCH:
            union = union[:SKETCH]
        both = np.isin(union, self.sketch, kind="sort") & np.isin(union, other.sketch, kind="sort")
        share = both.sum() / len(union)
        return float(2 * share / (1 + share))


class Hashed:
    """A text with its prefix arrays."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = len(codes)
        self.prefix = [self._prefix(codes, base) for base in BASES]

    @staticmethod
    def _prefix(codes: np.ndarray, base: int) -> np.ndarray:
        made = np.zeros(len(codes) + 1, np.uint32)
        powers = _powers(base)
        for start in range(0, len(codes), BLOCK):
            part = codes[start : start + BLOCK].astype(np.uint64) + np.uint64(1)
            sums = _mod(np.cumsum(_mod(part * powers[: len(part)])))
            if start:
                sums = _mod(_mod(sums * np.uint64(pow(base, start, P))) + np.uint64(made[start]))
            made[start + 1 : start + 1 + len(part)] = sums
        return made

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of a span, the same wherever in whatever text the span stands."""
        return tuple(
            (int(prefix[end]) - int(prefix[start])) * pow(base, -start, P) % P
            for prefix, base in zip(self.prefix, BASES, strict=True)
        )

    def spans(self) -> Iterator[np.ndarray]:
        """The mixed hashes of all spans of WIDTH code points, block by block."""
        count = self.size - WIDTH + 1
        for start in range(0, count, BLOCK):
            end = min(count, start + BLOCK)
            made = np.zeros(end - start, np.uint64)
            for prefix, base in zip(self.prefix, BASES, strict=True):
                back = pow(base, -1, P)
                apart = prefix[start + WIDTH : end + WIDTH].astype(np.uint64) + np.uint64(P) - prefix[start:end]
                spans = _mod(_mod(apart) * _powers(back)[: end - start])
                if start:
                    spans = _mod(spans * np.uint64(pow(back, start, P)))
                made = (made << np.uint64(31)) | spans
            yield _mixed(made)

    @cached_property
    def fingerprint(self) -> Sketched:
        first, second = self.span(0, self.size)
        whole = first << 31 | second
        if self.size < WIDTH:
            smallest = _mixed(np.array([whole] if self.size else [], np.uint64))
        else:
            parts = [_smallest(x) for x in self.spans()]
            smallest = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))[:SKETCH]
        return Sketched(whole, np.unique(smallest >> np.uint64(32)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * MIX
    x ^= x >> np.uint64(32)
    return x * MIX


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH smallest of the distinct hashes, in order."""
    share = 4 * SKETCH / len(hashes)
    while True:
        few = np.unique(hashes if share >= 1 else hashes[hashes < np.uint64(int(share * 2.0**64))])
        if len(few) >= SKETCH or share >= 1:
            return few[:SKETCH]
        share *= 8  # spans that repeat leave fewer distinct ones


def same_span(a: Hashed, start: int, b: Hashed, other: int, size: int) -> bool:
    return a.span(start, start + size) == b.span(other, other + size)


def common_extension(a: Hashed, start: int, b: Hashed, other: int) -> int:
    """How far the texts agree from these places on."""
    low, high = 0, min(a.size - start, b.size - other)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, start, b, other, middle):
            low = middle
        else:
            high = middle - 1
    return low


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
     ("same_as_edited", pa.int64()), ("same_as_next", pa.int64())]
)
DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, same_as_edited long, same_as_next long"
)


def _row(doc_id: int | None, own: Hashed, following: Hashed) -> tuple:
    changed = Hashed(edited(own.text, following.text))
    return (
        doc_id, own.size, hashlib.sha256(changed.text.encode()).hexdigest(), str(own.fingerprint), str(changed.fingerprint),
        own.fingerprint.likeness(changed.fingerprint), own.fingerprint.likeness(following.fingerprint),
        common_extension(own, 0, changed, 0), common_extension(own, 0, following, 0),
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in order, the first row of the next part behind them as a guest."""
    before: tuple[int | None, Hashed] | None = None
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            made = []
            rows = zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), batch.column("guest").to_pylist(), strict=True)
            for doc_id, text, guest in rows:
                if guest and before is None:
                    break  # only the first guest follows
                own = Hashed(text)
                if before:
                    made.append(_row(*before, own))
                before = None if guest else (doc_id, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], f.type) for k, f in enumerate(SCHEMA)], schema=SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text, of its edited text, and their likeness; ``same_as_edited`` and
    ``same_as_next`` count the code points with which the text begins like the other text.

    Documents are dealt in their order into parts: by ranges of doc_id, and where rows without a doc_id or of
    one doc_id would fill more than two parts, by the hashes of their texts as well, which order such rows. Each
    part also gets the first document of the next one, so texts move once. Only rows equal in doc_id and text stay in one part
    however many they are. There are as many parts as a shuffle has partitions, or as many as PART_BYTES of text fill.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["bytes"] // PART_BYTES + 1)
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), shares or [0.5], 10_000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []), reverse=True) if shares else []
    share = max(1, total["rows"] // parts)
    # At most half as many as there are parts.
    crowds = {r["doc_id"]: r["n"] // share + 1 for r in rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * share).collect()}
    crowded = sorted((i for i in crowds if i is not None), reverse=True)
    # Parts in descending order of doc_id: the number of cuts that are larger, of crowds that are, and the piece of a crowd.
    cut = F.coalesce(_cuts_above(cuts, F.col("doc_id")), F.lit(len(cuts)))
    # An odd number stands for a crowd, an even one for the rows between two crowds.
    above = F.coalesce(_cuts_above(crowded, F.col("doc_id")), F.lit(len(crowded)))
    inside = F.coalesce(F.col("doc_id").isin(crowded), F.lit(False)) if crowded else F.lit(False)
    if None in crowds:
        inside = inside | F.col("doc_id").isNull()
    pieces = F.lit(1)
    for doc_id, n in crowds.items():
        pieces = F.when(F.col("doc_id").eqNullSafe(F.lit(doc_id).cast("long")), n).otherwise(pieces)
    piece = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * pieces).cast("int")
    place = F.struct(cut.alias("cut"), (2 * above + inside.cast("int")).alias("crowd"), F.when(inside, piece).otherwise(0).alias("piece"))
    rows = rows.withColumn("place", place)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.bitwise_not("doc_id").alias("falling"), F.col("hash").alias("hash"))
    firsts = sorted((tuple(r["place"]), r["first"]) for r in rows.groupBy("place").agg(F.min(order).alias("first")).collect())
    # Of each part its number and first document, and the part before; at most twice as many as there are parts.
    numbered = [(*at, k) for k, (at, _) in enumerate(firsts)]
    named = spark.createDataFrame(numbered, "cut int, crowd int, piece int, part int")
    named = named.select(F.struct("cut", "crowd", "piece").alias("place"), "part")
    first = [(None if f["nameless"] else ~f["falling"], f["hash"], k - 1 if k else len(firsts) - 1) for k, (_, f) in enumerate(firsts)]
    guests = spark.createDataFrame(first, "_first long, _hash long, _to int")
    rows = rows.join(F.broadcast(named), "place")
    same = rows["doc_id"].eqNullSafe(guests["_first"]) & (rows["hash"] == guests["_hash"])
    rows = rows.join(F.broadcast(guests), same, "left")
    own, guest = (F.struct(F.col(c).alias("part"), F.lit(g).alias("guest")) for c, g in (("part", False), ("_to", True)))
    copies = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest))
    dealt = rows.select("doc_id", "text", "hash", F.explode(copies).alias("copy")).select("doc_id", "text", "hash", "copy.part", "copy.guest")
    dealt = dealt.repartitionById(max(1, len(firsts)), F.col("part"))
    ordered = dealt.sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "hash", "text")
    return ordered.mapInArrow(_in_order, DDL)


def _cuts_above(cuts: list[int], value):
    """How many of the descending ``cuts`` are larger than ``value``, by halves."""
    if not cuts:
        return F.when(value.isNotNull(), 0)
    middle = len(cuts) // 2
    above = F.when(value < cuts[middle], F.lit(middle + 1) + _cuts_above(cuts[middle + 1 :], value))
    return above.when(value >= cuts[middle], _cuts_above(cuts[:middle], value))
