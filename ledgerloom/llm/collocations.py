"""Collocations of each language, from exact counts of all frequent phrases found by Toivonen's method.

A phrase is a run of up to LONGEST words within a piece of text. A sample of one document in SAMPLE proposes: its
phrases are mined level by level at a lowered threshold. One pass over all documents then counts, exactly,
every word, the proposed phrases and their negative border, that is every phrase whose own parts (without its
last word, without its first) were proposed. A phrase of the border that turns out frequent is a failure of the
sample: phrases that hold it may be frequent and weren't counted. An expansion pass counts all phrases that hold a
failure. Any frequent phrase that the first pass left out holds a smallest part that wasn't proposed; that part's own parts
were, so it was counted and is a failure, and the expansion has counted the phrase. So one expansion closes the search.

What was proposed, or failed, reaches the workers as a bitmap of hashes for each number of words, of at most MOST_BITS
bits however many phrases there are. A hash shared by chance only has a phrase counted that needn't be. Which
pass counts a phrase follows from the bitmaps alone, so each phrase is counted by one pass, in whole.

Workers count a slice of text at a time and give out sums, by language and by the 64-bit hashes of a phrase's words;
frequent phrases get their words back from the table of frequent words. Nothing is gathered by language or phrase in one task.

Rows: a null text counts as empty, a null language as ``und``. Rows that repeat a doc_id count each. Texts are
taken whole; long ones are cut at the ends of pieces, which no phrase crosses. A table without texts, or
without frequent phrases, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import raw_texts, stored, tidied

LONGEST = 4
FREQUENT = 30
#: One document in so many is sampled; phrases with so many occurrences there are proposed.
SAMPLE, PROPOSED = 8, 3
#: Percent of a phrase's occurrences that lie in one longer phrase, which then stands for it.
COVERED = 80
SCALE = 2_000_000
REPORTED = 2000
#: Bits of a bitmap for each phrase, and at most; and how many of them each phrase sets.
BITS_EACH, MOST_BITS, SET_EACH = 32, 1 << 27, 3
#: Bytes of text that are counted at a time, and split into words at a time.
SLICE_BYTES, SPLIT_BYTES = 8 << 20, 1 << 18
#: Ends of pieces, as bytes. The mark stands for them; it is in no UTF-8 text.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MARK = b"\xff"
TO_MARK = bytes.maketrans(ENDS, MARK * len(ENDS))
END = re.compile(rb"[.,;:!?\x0a-\x0d]")
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COUNTED = "lang string, words int, key binary, n long"

#: For each number of words but the longest, the bits of some phrases.
Bitmaps = dict[int, np.ndarray]


def _blocks(text: bytes) -> Iterator[bytes]:
    """``text`` cut at ends of pieces, about SLICE_BYTES at a time."""
    start = 0
    while len(text) - start > SLICE_BYTES:
        found = END.search(text, start + SLICE_BYTES)
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about SLICE_BYTES together."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            for block in _blocks(text or b""):
                held[lang].append(block)
                sizes[lang] += len(block)
                if sizes[lang] >= SLICE_BYTES:
                    yield lang, held.pop(lang)
                    del sizes[lang]
        if sum(sizes.values()) >= 2 * SLICE_BYTES:  # many languages
            yield from held.items()
            held.clear()
            sizes.clear()
    yield from held.items()


def _words(texts: list[bytes]) -> list[bytes]:
    """Words in order, with MARK between pieces."""
    joined = MARK.join(texts).lower().translate(TO_MARK)
    return joined.replace(MARK, b" " + MARK + b" ").split()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of phrases out of those of their parts without the last and without the first word."""
    x = (a ^ (b * K2)) * K1
    return x ^ (x >> np.uint64(29))


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, len(lang)) ^ xxhash.xxh64_intdigest(lang)


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits that phrases set, one of each phrase at a time."""
    for turn in range(SET_EACH):
        yield _joined(hashes, np.uint64(turn)) & np.uint64(bits - 1)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(bits)):
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of a slice as numbers, 0 for MARK, and the words by number."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    numbers[MARK]
    found, held, size = [], [], 0
    for k, text in enumerate(texts, 1):
        held.append(text)
        size += len(text)
        if size >= SPLIT_BYTES or k == len(texts):
            said = [MARK, *_words(held)]
            found.append(np.fromiter(map(numbers.__getitem__, said), np.int32, len(said)))
            held, size = [], 0
    return np.concatenate([*found, np.zeros(0, np.int32)]), list(numbers)


def count_slice(
    lang: str, texts: list[bytes], sizes: list[int], proposed: Bitmaps, failed: Bitmaps, frequent: Bitmaps
) -> Iterator[tuple[int, list[bytes] | np.ndarray, np.ndarray]]:
    """``words, keys, counts`` for each number of words in ``sizes``; a phrase's key is the hashes of its words.

    Keys of words are the words themselves, and 0 stands for all words together. Phrases of several words
    count if both their parts are in ``proposed``; in an expansion those others that hold a phrase of ``failed``
    and whose parts are in ``frequent`` or weren't counted before.
    """
    ids, vocabulary = _numbered(texts)
    if 1 in sizes:
        times = np.bincount(ids, minlength=len(vocabulary))
        yield 0, [b""], times[1:].sum(keepdims=True)
        yield 1, vocabulary[1:], times[1:]
    if max(sizes) < 2:
        return
    own = np.array([_word_hash(lang, w) for w in vocabulary], np.uint64)
    hashes, whole = own[ids], ids > 0
    if failed:
        holds = _has(failed[1], own)[ids]
        possible = _has(frequent[1], own)[ids] & whole
    for size in range(2, max(sizes) + 1):
        # Parts start here and one word on.
        part = size - 1
        here = whole & (_has(proposed[1], own)[ids] if part == 1 else _has(proposed[part], hashes))
        wanted = here[:-1] & here[1:]
        whole = whole[:-1] & whole[1:]
        if failed:
            counted = wanted
            possible = possible[:-1] & possible[1:]
            holds = holds[:-1] | holds[1:]
            wanted = ~counted & holds & possible
        if size in sizes:
            at = np.flatnonzero(wanted)
            firsts, counts = _distinct(ids, at, size)
            yield size, own[ids[at[firsts][:, None] + np.arange(size)]], counts
        if size == max(sizes):
            break
        hashes = _joined(hashes[:-1], hashes[1:])
        if failed:
            possible &= ~counted | _has(frequent[size], hashes)
            holds |= _has(failed[size], hashes)


def _distinct(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the places ``at`` of each distinct phrase of ``size`` words, and its number of places."""
    ids = ids.astype(np.int64)
    code = ids[at] << 32 | ids[at + 1]
    if size > 2:
        head = np.unique(code, return_inverse=True)[1]
        rest = ids[at + 2]
        if size > 3:
            rest = np.unique(rest << 32 | ids[at + 3], return_inverse=True)[1]
        code = head << 32 | rest
    _, firsts, counts = np.unique(code, return_index=True, return_counts=True)
    return firsts, counts


def _binary(keys: list[bytes] | np.ndarray) -> pa.Array:
    if isinstance(keys, list):
        return pa.array(keys, pa.binary())
    rows, width = keys.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(8 * width)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])


def _counts(docs: DataFrame, sizes: list[int], least: int, proposed: Bitmaps, failed: Bitmaps, frequent: Bitmaps) -> DataFrame:
    """``lang, words, key, n`` of the phrases counted that occur ``least`` times, stored."""
    held = docs.sparkSession.sparkContext.broadcast((proposed, failed, frequent))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches):
            for words, keys, counts in count_slice(lang, texts, sizes, *held.value):
                for start in range(0, len(keys), 100_000):
                    part = keys[start : start + 100_000]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), words, np.int32))]
                    columns += [_binary(part), pa.array(counts[start : start + 100_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "key", "n"])

    made = docs.mapInArrow(run, COUNTED).groupBy("lang", "words", "key").agg(F.sum("n").alias("n"))
    made = stored(made.filter((F.col("words") == 0) | (F.col("n") >= least)), "collocations")
    held.destroy()
    return made


def _hash_of(lang: str, words: int, key: bytes) -> int:
    if words == 1:
        return _word_hash(lang, key)
    hashes = np.frombuffer(key, np.uint64)
    while len(hashes) > 1:
        hashes = _joined(hashes[:-1], hashes[1:])
    return int(hashes[0])


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """The bits of ``lang, words, key``, all of one number of words."""
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * phrases.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            hashes = np.array([_hash_of(*row) for row in rows], np.uint64)
            at = np.concatenate(list(_places(hashes, bits)))
            masks = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(masks.view(np.int64))], ["place", "mask"])

    longs = phrases.select("lang", "words", "key").mapInArrow(run, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask"))
    found = longs.toArrow()  # MOST_BITS / 64 rows at most
    made = np.zeros(bits // 64, np.int64)
    made[found["place"].to_numpy()] = found["mask"].to_numpy()
    return made.view(np.uint8)


def _of_size(phrases: DataFrame, words: int) -> DataFrame:
    return phrases.filter(F.col("words") == words)


def _proposed(sample: DataFrame) -> tuple[DataFrame, Bitmaps]:
    """The sample's phrases, level by level, with PROPOSED occurrences there; and their bits."""
    found, bits = None, {}
    for words in range(1, LONGEST):
        level = _of_size(_counts(sample, [words], PROPOSED, bits, {}, {}), words)
        found = level if found is None else found.unionByName(level)
        bits[words] = _bitmap(level)
    return found, bits


def frequent_phrases(docs: DataFrame, least: int = FREQUENT) -> DataFrame:
    """``lang, words, said, n`` of every phrase, as its words, with ``least`` occurrences in its language; ``words`` 0 is for all words."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", "doc_id")
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0
    texts = docs.select("lang", "text")
    known, proposed = _proposed(docs.filter(chosen).select("lang", "text"))
    found = _counts(texts, list(range(1, LONGEST + 1)), least, proposed, {}, {})
    # Frequent phrases that weren't proposed: what holds them is still to be counted.
    missed = found.filter(F.col("words").between(1, LONGEST - 1)).join(known, ["lang", "words", "key"], "left_anti")
    missed = stored(missed, "collocations-failed")
    if not missed.isEmpty():
        failed, frequent = ({words: _bitmap(_of_size(rows, words)) for words in range(1, LONGEST)} for rows in (missed, found))
        found = found.unionByName(_counts(texts, list(range(2, LONGEST + 1)), least, proposed, failed, frequent))
    return _spelt(found)


def _spelt(found: DataFrame) -> DataFrame:
    """Phrases with their words in place of hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = np.array([_word_hash(lang, word) for lang, word in zip(langs, words, strict=True)], np.uint64).reshape(-1, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(keys), batch.column(1).cast(pa.string())], ["lang", "part", "word"])

    # Every word of a frequent phrase is frequent.
    words = _of_size(found, 1).select("lang", "key").mapInArrow(hashed, "lang string, part binary, word string")
    several = found.filter("words > 1")
    places = several.select("lang", "words", "key", "n", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("place"))
    parts = places.withColumn("part", F.substring("key", F.col("place") * 8 + 1, F.lit(8))).join(words, ["lang", "part"])
    spelt = parts.groupBy("lang", "words", "key", "n").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("said"))
    spelt = spelt.select("lang", "words", F.col("said.word").alias("said"), "n")
    single = found.filter("words < 2").select("lang", "words", F.array(F.col("key").cast("string")).alias("said"), "n")
    return stored(spelt.unionByName(single), "collocations-spelt")


def _run(words: Column, first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def _big(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, reported: int = REPORTED, least: int = FREQUENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases of several words by score.

    A phrase's score is that of its worst cut into a first part and a rest.
    """
    found = frequent_phrases(docs, least)
    counts = found.filter("words > 0").select("lang", "words", F.array_join("said", " ").alias("phrase"), F.col("n").alias("a"), "said")
    totals = found.filter("words = 0").select("lang", "n")
    candidates = counts.filter("words > 1")

    longer = candidates.filter("words > 2")
    inner = [(k, size) for size in range(2, LONGEST) for k in range(1, LONGEST - size + 2)]
    parts = F.array_compact(F.array(*[F.when((F.col("words") > size) & (F.col("words") >= k + size - 1), _run(F.col("said"), k, size)) for k, size in inner]))
    covers = longer.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").filter(F.col("cover").isNull() | (_big("cover") * 100 < _big("a") * COVERED))

    cuts = F.sequence(F.lit(1), F.col("words") - 1)
    cut = kept.select("lang", "phrase", "a", "said", F.explode(cuts).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _run(F.col("said"), 1, F.col("k")).alias("first"), _run(F.col("said"), F.col("k") + 1, F.lit(LONGEST)).alias("rest"))
    for part, column in (("first", "l"), ("rest", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(column)), ["lang", part])
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    worst = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = worst.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reported)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


#: The rows of :func:`collocations` in DuckDB.
ORACLE = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
said AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM said, sizes WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
covers AS (SELECT lang, phrase, max(a) AS cover FROM (
    SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM candidates, (SELECT unnest([2, 3]) AS size) WHERE size < k) GROUP BY lang, phrase),
kept AS (SELECT c.* FROM candidates c LEFT JOIN covers USING (lang, phrase)
         WHERE cover IS NULL OR 100 * CAST(cover AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)),
cut AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS first, array_to_string(w[i + 1:k], ' ') AS rest
        FROM kept, (SELECT unnest([1, 2, 3]) AS i) WHERE i < k),
scored AS (SELECT cut.lang, cut.phrase, cut.a, i, x.a AS l, y.a AS r, CAST((2000000 * CAST(cut.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
