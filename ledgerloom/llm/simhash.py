"""Near-duplicate documents by SimHash, found through an inverted index of positional bytes.

A fingerprint is eight bytes, each at its position. Two fingerprints that differ in at most two bits
agree in at least six of the eight positional bytes, so a pair whose tally of shared positional bytes
is below six needs no check. Postings of single bytes hold one fingerprint in 256 each, and tallying
all their pairs would grow with the square of the corpus. The index is therefore kept by *six
positional bytes at a time*, for all 28 choices of six positions: two fingerprints meet under a key
exactly if their tally reaches six, and no pair below the guaranteed minimum is ever made. The bytes
that a key leaves open have 65,536 values, which bounds every posting list of distinct fingerprints.

Postings are verified bit by bit; from each list only the links of a spanning forest are kept, since
components need no more. Equal fingerprints are one entry of the index, however many documents have
them.

Rows: a null text counts as empty; empty texts have fingerprint zero and link like any other. Rows that
repeat a doc_id each get their own fingerprint. A null doc_id is never a component's id, unless
no document of the component has one. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import raw_texts, small, stored
from ledgerloom.llm.graph import components

MOST_BITS = 2
SHINGLE = 3
SEED = 42
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
#: Rows of ids that are broadcast at most.
BROADCAST_ROWS = 1 << 19
#: Fingerprints of a partition of the index, each of which becomes as many rows as there are choices of positions.
INDEXED = 1 << 14
WHITE = b" \t\n\r\x0b\x0c"
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text, A-Z in lower case."""
    ones, total, carried = np.zeros((8, 8), np.int64), 0, []
    for block in _blocks(text or b""):
        words = carried + block.lower().split()
        if len(words) >= SHINGLE:
            hashes = _shingle_hashes(words)
            bytes_ = hashes.view(np.uint8).reshape(-1, 8)
            for position in range(8):
                ones[position] += np.bincount(bytes_[:, position], minlength=256) @ BITS
            total += len(hashes)
        carried = words[1 - SHINGLE :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    set_bits = (2 * ones > total).reshape(-1)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def _blocks(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = start + BLOCK
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[start:end]
        start = end


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(x) for x in raw_texts(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def _hashed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(x) for x in raw_texts(batch.column(2))], np.uint64)
        columns = [batch.column(0), batch.column(1), pa.array(made.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks() -> list[int]:
    masks = (sum(0xFF << 8 * p for p in six) for six in combinations(range(8), 6))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links between members at most MOST_BITS apart, enough to connect all that such links connect."""
    if len(members) == 2:
        return [(0, 1)] if np.bitwise_count(members[0] ^ members[1]) <= MOST_BITS else []
    root, kept = list(range(len(members))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(members) - 1):
        near = np.flatnonzero(np.bitwise_count(members[i + 1 :] ^ members[i]) <= MOST_BITS)
        for j in (near + i + 1).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[y] = x
                kept.append((i, j))
    return kept


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for postings in batch.column(0):
            members = postings.values.to_numpy(zero_copy_only=False)
            for i, j in _forest(members.view(np.uint64)):
                a.append(members[i])
                b.append(members[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp``, as many as components need."""
    keys = F.array(*[F.struct(F.lit(i).alias("six"), F.expr(f"fp & {m}L").alias("bytes")) for i, m in enumerate(_masks())])
    # An index row for each choice: dealt out first, as the fingerprints themselves are few bytes.
    dealt = fps.repartition(fps.count() // INDEXED + 1, "fp")
    index = dealt.select("fp", F.explode(keys).alias("key")).groupBy("key.six", "key.bytes")
    postings = index.agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return postings.select("fps").mapInArrow(_verified, "a long, b long").distinct()


def _classes(made: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint of ``doc_id, fp``; the root is the component's own number."""
    distinct = stored(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Documents are linked if their fingerprints differ in at most two bits; a component's id is its
    smallest doc_id.
    """
    made = stored(fingerprints(docs), "simhash")
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return made.join(_classes(made), "fp").select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id, and of its rows the one of least text hash.

    Groups are told apart by their fingerprints, so rows of several groups that share a doc_id all have their
    group's row kept. Of rows equal in doc_id and text the first by all of their columns stays. Rows without a doc_id all stay.
    """
    named = docs.filter("doc_id IS NOT NULL")
    name = uuid.uuid4().hex
    own = {f"_doc_{name}": F.col("doc_id").cast("long"), f"_text_{name}": F.xxhash64("text")}
    rows = named.select(*[c.alias(k) for k, c in own.items()], "text").mapInArrow(_hashed_fingerprints, "doc_id long, text_hash long, fp long")
    made = stored(rows, "simhash")
    copies = made.groupBy("fp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct("doc_id", "text_hash", "rows")
    kept = copies.join(_classes(made), "fp").groupBy("root").agg(F.min(order).alias("kept"))
    kept = stored(kept.select(*[F.col(f"kept.{c}").alias(k) for c, k in zip(("doc_id", "text_hash"), own, strict=True)], "kept.rows"), "simhash-kept")
    keyed = named.withColumns(own)

    def of(which: str) -> DataFrame:
        return keyed.join(small(kept.filter(which).select(*own), BROADCAST_ROWS), list(own), "left_semi")

    single = of("rows = 1").select(*docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = of("rows > 1").groupBy(*own).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return single.unionByName(repeated).unionByName(docs.filter("doc_id IS NULL"))
