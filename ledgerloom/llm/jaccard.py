"""Documents whose sets of word n-grams have a Jaccard similarity of SIMILARITY percent, by parity sketches.

Every n-gram of a set flips one bit of a sketch. What two sets share cancels out, so the Hamming distance of
their sketches is never more than the size of their symmetric difference. Sets of ``a <= b`` n-grams reach the
similarity only if ``b`` is near ``a`` and the difference is ``a / 9`` at most (at 90 percent). Sets are
therefore compared in bands of sizes; a band's sketch has one part of 64 bits more than the difference allowed
in it, and by the pigeonhole principle two sets that reach the similarity agree in some part whole. The parts'
values are the keys of the join.

Parts in which few bits are set say little. Where they are few enough to be worth it, such a part is no key by
itself but together with every part of a second sketch made with other hashes, and so on: two sets
that agree in the first also agree in some part of the second, so nothing is lost.

Equal sets are one entry. Where a key has two sets, they are compared; where it has more, each is compared to
one of them first, which connects groups of near copies without making all their pairs. Sets of a key that
then are in different components meet each other by the key, kept apart by size and by a sketch of 512
bits, and are compared as well. The last check is always the size of the intersection of the n-grams' hashes.

Rows: a null text counts as empty. Texts of fewer than SHINGLE words are one n-gram; texts without words
have no n-grams and no links. Rows that repeat a doc_id are compared each. A null doc_id is never a component's
id unless no row of the component has one. Other columns are not read; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import raw_texts, small, stored, word_blocks
from ledgerloom.llm.graph import components

SHINGLE = 3
#: Percent: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 90
#: A band of sizes ends where this times its start is reached.
BAND = 1.25
#: Parts with so many set bits at most are joined with other sketches, where a sketch has few parts, so many times.
LIGHT, FEW_PARTS, SKETCHES = 1, 64, 4
#: Bits of the sketch that candidates are held against, in longs.
LONGS = 8
#: Rows of ids, and of keys with an id, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_KEYS = 1 << 20, 1 << 19
#: Sets of a key meet each other once there are so many meetings for each of them at most, or other leaders help little.
MEETINGS = 64
WORDS_KEPT = 32 << 20
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    """Hashes of words, remembered up to WORDS_KEPT bytes of words."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 100
        if self.held > WORDS_KEPT:
            self.clear()
            self.held = 0
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x + np.uint64(seed * int(K2) & 0xFFFFFFFFFFFFFFFF)) * K1
    x = (x ^ (x >> np.uint64(32))) * K3
    return x ^ (x >> np.uint64(29))


def ngrams(text: bytes | None, of: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a text's word n-grams, in order."""
    parts = [np.fromiter(map(of.__getitem__, words), np.uint64, len(words)) for words in word_blocks(text or b"")]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    if not size:
        return words
    made = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        made = _mixed(made ^ words[k : k + len(made)], k + 1)
    return np.unique(made)


@lru_cache(maxsize=1)
def _bands() -> list[tuple[int, int, int]]:
    """``first, last, parts``: the sizes of the smaller sets of each band, and the parts of its sketches."""
    spare = 100 - SIMILARITY
    made, first = [], 1
    while first < 1 << 40:
        last = max(first, int(first * BAND) - 1)
        made.append((first, last, last * spare // SIMILARITY + 1))
        first = last + 1
    return made


def bands_of(size: int) -> Iterator[tuple[int, int]]:
    """``band, parts`` of every band that a set belongs to, as the smaller or the larger of two.

    Bands whose sets must be equal need no sketch.
    """
    for band, (first, last, parts) in enumerate(_bands()):
        if size < first:
            break
        if size <= last * 100 // SIMILARITY and parts > 1:
            yield band, parts


def sketch(made: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """The parity sketch of a set: ``parts`` longs, in which every n-gram flips a bit."""
    drawn = _mixed(made, seed)
    part = ((drawn >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    flips = np.bincount((part * np.uint64(64) + (drawn & np.uint64(63))).astype(np.int64), minlength=64 * parts)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _keys_under(made: np.ndarray, parts: int, prefixes: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Keys of the sketch of a level, each below every prefix, and of further levels where parts are light."""
    values = sketch(made, parts, level)
    here = _mixed(values ^ _mixed(np.arange(parts, dtype=np.uint64)))
    keys = _mixed(prefixes[:, None] ^ here, level)
    if level == SKETCHES or parts > FEW_PARTS:
        yield keys.ravel()
        return
    light = np.bitwise_count(values) <= LIGHT
    yield keys[:, ~light].ravel()
    if light.any():
        yield from _keys_under(made, parts, keys[:, light].ravel(), level + 1)


def join_keys(made: np.ndarray) -> np.ndarray:
    """The keys under which a set meets every set that reaches the similarity and isn't equal."""
    keys = [k for band, parts in bands_of(len(made)) for k in _keys_under(made, parts, _mixed(np.array([band], np.uint64)), 1)]
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _digest(made: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits that tell sets apart; nothing for the empty set."""
    if not len(made):
        return None, None
    found = np.frombuffer(xxhash.xxh3_128_digest(made.tobytes()), np.int64)
    return int(found[0]), int(found[1])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)])
    values = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _sets(with_ngrams: bool):
    names = ["doc_id", "n", "hi", "lo", "ngrams"] if with_ngrams else ["doc_id", "n", "hi", "lo", "sketch", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Hashes()
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                made = [ngrams(text, of) for text in raw_texts(batch.column(1))]
                digests = [_digest(m) for m in made]
                columns = [batch.column(0), pa.array(map(len, made), pa.int64())]
                columns += [pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)]
                if with_ngrams:
                    columns.append(_lists(made))
                else:
                    columns += [_lists([sketch(m, LONGS, 99) for m in made]), _lists([join_keys(m) for m in made])]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n long, hi long, lo long, " + ("ngrams array<long>" if with_ngrams else "sketch array<long>, keys array<long>")
    return run, schema


def _near(n_a: str, n_b: str, sketch_a: str, sketch_b: str) -> Column:
    """Whether two sets may reach the similarity, by their sizes and sketches.

    They reach it if ``(200 - s) * shared >= s * (n_a + n_b) - (100 - s) * shared``, put for the difference below.
    """
    apart = " + ".join(f"bit_count({sketch_a}[{k}] ^ {sketch_b}[{k}])" for k in range(LONGS))
    spare = 100 - SIMILARITY
    return F.expr(
        f"100 * least({n_a}, {n_b}) >= {SIMILARITY} * greatest({n_a}, {n_b})"
        f" AND {100 + SIMILARITY} * ({apart}) <= {spare} * ({n_a} + {n_b})"
    )


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that reach the similarity."""
    of = {x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"}
    near = pairs.join(of["a"], "a").join(of["b"], "b").filter(_near("n_a", "n_b", "sketch_a", "sketch_b"))
    near = stored(near.select("a", "b", "n_a", "n_b"), "jaccard-near")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = stored(sets.join(ids, "id").select("id", "hi", "lo", "first"), "jaccard-wanted")
    firsts = small(wanted.select("first").distinct(), BROADCAST_ROWS)
    # The n-grams of the few texts that take part are made again; those of all texts are never stored.
    texts = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["first"]), "left_semi")
    run, schema = _sets(with_ngrams=True)
    made = texts.mapInArrow(run, schema).join(small(wanted.select("id", "hi", "lo"), BROADCAST_KEYS), ["hi", "lo"])
    # Dealt by id once, for both joins; of a crowd and its leader the crowd's n-grams move on, once.
    made = made.groupBy("id").agg(F.any_value("ngrams").alias("ngrams"))
    for x in "ba":
        near = near.join(made.select(F.col("id").alias(x), F.col("ngrams").alias(f"ngrams_{x}")), x)
    shared = F.size(F.array_intersect("ngrams_a", "ngrams_b"))
    reached = 100 * shared >= SIMILARITY * (F.col("n_a") + F.col("n_b") - shared)
    return stored(near.filter(reached).select("a", "b"), "jaccard-links")


def connected(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, root`` of the sets with links; the root is the smallest id of a component."""
    index = sets.select("id", F.explode("keys").alias("key"))
    met = index.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
    met = stored(met.filter("a <> b"), "jaccard-keys")
    crowded = small(met.filter("n > 2").select("key", F.col("a").alias("leader")), BROADCAST_KEYS)
    members = stored(index.join(crowded, "key"), "jaccard-members")
    pairs = met.filter("n = 2").select("a", "b")
    pairs = pairs.unionByName(members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")))
    found = _verified(pairs.distinct(), sets, docs)
    members = members.select("key", "id")
    for turn in count(1):
        roots = components(found)
        mixed, rows, apart = _mixed_keys(members, roots)
        if not apart:
            return roots
        if apart <= MEETINGS * rows or turn > 1 and apart > 0.75 * before:
            break
        # Many pairs to go: another leader for each key connects more before the rest meets.
        before = apart
        order = F.struct(F.xxhash64(F.col("id"), F.lit(turn)), F.col("id"), F.col("part"))
        lead = mixed.groupBy("key").agg(F.min(order).alias("lead")).select("key", F.col("lead.id").alias("a"), F.col("lead.part").alias("own"))
        pairs = mixed.join(lead, "key").filter("part <> own").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
        found = found.unionByName(_verified(pairs.distinct(), sets, docs))
        members = mixed.select("key", "id")
    one, two = (
        mixed.join(sets.select("id", "n", "sketch"), "id").select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "part", "n", "sketch")])
        for x in "ab"
    )
    pairs = one.join(two, "key").filter("part_a < part_b").filter(_near("n_a", "n_b", "sketch_a", "sketch_b"))
    pairs = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    more = _verified(pairs.distinct(), sets, docs)
    return roots if more.isEmpty() else components(found.unionByName(more))


def _mixed_keys(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int, int]:
    """Members of the keys that hold several components, with their component ``part``; their number, and that of pairs to go."""
    labelled = members.join(roots, members["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("part"))
    labelled = stored(labelled, "jaccard-parts")
    sizes = labelled.groupBy("key", "part").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key")
    sizes = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    sizes = stored(sizes, "jaccard-mixed")
    rows, apart = sizes.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.lit(0.0))).first()
    return labelled.join(sizes.select("key"), "key", "left_semi"), int(rows), int(apart)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the component's id is its smallest doc_id."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    run, schema = _sets(with_ngrams=False)
    made = stored(docs.mapInArrow(run, schema), "jaccard")
    sets = made.filter("n > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("first"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("keys").alias("keys")
    )
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()), "jaccard-sets")
    roots = connected(sets, docs)
    rooted = sets.select("hi", "lo", "id", "first").join(roots, sets["id"] == roots["node"], "left")
    rooted = rooted.select("hi", "lo", "first", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(least, "root").select("hi", "lo", "component_id")
    linked = made.filter("n > 0").join(ids, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = made.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


#: The rows of :func:`near_duplicates` in DuckDB.
ORACLE = """
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS MATERIALIZED (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, s, min(doc_id) AS first, len(s) AS n FROM
    (SELECT list_sort(s) AS s, doc_id FROM sets WHERE len(s) > 0) GROUP BY s),
grams AS MATERIALIZED (SELECT c, n, hash(unnest(s)) AS g FROM classes),
links AS MATERIALIZED (
    SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.g = b.g AND a.c <> b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS c, min(first) AS component_id FROM reach JOIN classes ON b = classes.c GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s AND len(sets.s) > 0 LEFT JOIN least USING (c)
"""
