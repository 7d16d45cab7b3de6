"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

Texts are sequences of words (letters and digits, lower case; in scripts without spaces, characters); an
edit inserts, deletes or replaces one. A document leaks an item if some passage of it is at most ``floor((1 - SIMILARITY) * words)`` edits
from the item.

The CGK embedding walks along a sequence and, at every step, writes down the word it stands on and moves
on or not by a random bit that depends on step and word. Two walks over sequences a few edits apart fall
into step again soon, so edit distance becomes Hamming distance. Windows of an item's size, one at each
word and some ahead of the first, are embedded; bits of the embedding, here single steps, are sampled a few at a time, and a window
that agrees with an item in all the steps of some sample is a candidate. ``samples_for`` gives the number of
samples for a target recall. Candidates are then verified exactly, by the edit distance between the item
and any passage around the window.

Most windows needn't be embedded: k edits leave at least ``words - k`` of an item's words, ``words - 1 - 2k`` of
its pairs of neighbouring words and ``words - 2 - 3k`` of its triples as they were, so a window with fewer words,
pairs or triples that any item has can't be near one. Those bounds are exact; they lose no passage.

Items are taken in blocks of BLOCK_CHARS, whatever their number, so that what every task holds is
bounded; documents are read once for each block, and never move.

Rows: null and empty texts leak nothing. Items of fewer than MIN_WORDS words are left out
unless ``least_words`` asks for them; items of fewer than five allow no edit and are found where they stand word by word. Equal items are found each. Rows that repeat a
doc_id are searched each. Columns other than doc_id and text, and item_id and text, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared, slices, texts, tidied

SIMILARITY = 0.8
#: Items of fewer words are no passage that could be told from chance, unless asked for.
MIN_WORDS = 4
RECALL = 0.99
#: Steps in a sample, walks with random bits of their own, and the least share of steps in which the
#: walks of a passage and its item agree at the largest distance allowed, on average.
STEPS, WALKS, AGREE = 2, 3, 0.3
#: Items whose sizes differ by less than this factor share windows.
SIZES = 1.25
BLOCK_CHARS = 4 << 20
BATCH_BYTES = 2 << 20
#: The blocks of scripts that put no spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han).
SIGNS = r"\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{SIGNS}]")
WORD = re.compile(r"[^\W_]+")
SIGN_OR_WORD = re.compile(rf"[{SIGNS}]|[^\W_{SIGNS}]+")
#: ``item_id, distance, words, start, end``.
Hit = tuple[int | None, int, int, int, int]
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of items are numbered below this from 1 on; a word that no item has is a hash from here on.
STRANGE = 1 << 32
GRAM_BITS = 22
GRAMS = (2, 3)


def edits_allowed(words: int) -> int:
    return math.floor((1 - SIMILARITY) * words + 1e-9)


def samples_for(recall: float, agree: float, steps: int) -> int:
    """Independent samples that make one of them agree with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**steps))


def _told_apart(ids: np.ndarray, said: list[str]) -> np.ndarray:
    """``ids`` with a number for each word that no item has, so that walks move on from it as from any other."""
    told, strange = ids.copy(), np.flatnonzero(ids == 0)
    told[strange] = [STRANGE | crc32(said[k].encode("utf-8", "surrogatepass")) for k in strange.tolist()]
    return told


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return (x ^ (x >> np.uint64(29))) * MIX


def walk(words: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """The CGK embeddings of the rows of ``words``, a row each step; 0 stands for what lies past the end."""
    rows, width = words.shape
    flat = np.concatenate([words, np.zeros((rows, 1), words.dtype)], axis=1).ravel()
    at = np.arange(rows) * (width + 1)
    last = at + width
    made = np.empty((steps, rows), words.dtype)
    # A step's random function: the high bit of the word times an odd number, plus another number.
    times, plus = np.random.default_rng(seed).integers(0, 1 << 64, (2, steps), np.uint64)
    times |= np.uint64(1)
    for step in range(steps):
        now = made[step] = flat[at]
        at = np.minimum(at + ((now * times[step] + plus[step]) >> np.uint64(63)).view(np.int64), last)
    return made


@dataclass
class SizeClass:
    """Items of similar size with the keys of their sampled embeddings."""

    items: list[int]
    words: int
    #: How many words that some item has, and how many of each of GRAMS, a window of ``reach`` words has at least.
    least: list[int]
    reach: int
    #: So many words before the text windows start, for passages at its start that lost their first words.
    lead: int = 0
    samples: list[np.ndarray] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


@dataclass
class Index:
    """A block of items, ready to be searched for."""

    item_ids: list[int | None]
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    #: For each item the hashes of its pairs.
    pairs: list[list[int]]
    #: For each of GRAMS, which hashes some item has.
    grams: list[np.ndarray]
    classes: list[SizeClass]

    def find(self, text: str) -> list[Hit]:
        """The hits of one text."""
        return self.find_all([text])[0]

    def find_all(self, batch: list[str]) -> list[list[Hit]]:
        """``item_id, distance, words, start, end`` of the best passage for each leaked item of each text, in code points.

        All texts lie in one array of words, with room around each for the windows that reach beyond it.
        """
        said = [words_of(text) for text in batch]
        lead = max((group.lead for group in self.classes), default=0)
        room = lead + max((group.reach for group in self.classes), default=0)
        sizes = np.array([len(words) for words in said], np.int64)
        ends = np.cumsum(sizes + room)
        origins = ends - sizes - room + lead
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        of = self.vocabulary
        flat = np.fromiter(map(of.get, chain.from_iterable(said), repeat(0)), np.uint64, int(sizes.sum()))
        ids[np.arange(len(flat)) + np.repeat(origins - np.cumsum(sizes) + sizes, sizes)] = flat
        hashes = _grams(ids)
        told = ids.copy()
        told_apart: set[int] = set()
        known = [np.cumsum(seen, dtype=np.int32) for seen in (ids > 0, *(seen[h] for h, seen in zip(hashes, self.grams, strict=True)))]
        known = [np.concatenate([np.zeros(1, np.int32), before]) for before in known]
        near: dict[tuple[int, int], list[int]] = {}
        for group in self.classes:
            # As many windows as start anywhere and end within the array; the room makes that all there are.
            passes = np.ones(max(0, len(ids) - group.reach + 1), bool)
            for n, before, least in zip((1, *GRAMS), known, group.least, strict=True):
                wide = group.reach - n + 1
                if wide > 0 and len(passes):
                    passes &= before[wide : wide + len(passes)] - before[: len(passes)] >= least
            starts = np.flatnonzero(passes)
            owners = np.searchsorted(ends, starts, side="right")
            inside = starts >= origins[owners] - group.lead
            starts, owners = starts[inside], owners[inside]
            for owner in set(np.unique(owners).tolist()) - told_apart:  # few texts get here
                first, last = origins[owner], origins[owner] + sizes[owner]
                told[first:last] = _told_apart(ids[first:last], said[owner])
                told[first - lead : first] = np.arange(lead, dtype=np.uint64) + np.uint64(STRANGE)
                told_apart.add(owner)
            for at in range(0, len(starts), 4096):
                members, rows = self._candidates(group, told, starts[at : at + 4096])
                for member, row in zip(members.tolist(), (rows + at).tolist(), strict=True):
                    owner = int(owners[row])
                    near.setdefault((owner, group.items[member]), []).append(int(starts[row] - origins[owner]))
        found: list[list[Hit]] = [[] for _ in batch]
        places: dict[int, list[tuple[int, int]]] = {}
        last_owner, pairs = -1, []
        for (owner, item), windows in sorted(near.items()):
            own = slice(origins[owner], origins[owner] + sizes[owner])
            if owner != last_owner:
                last_owner, pairs = owner, hashes[0][own].tolist()
            best = self._verified(told[own], pairs, item, windows)
            if best:
                distance, first, last = best
                at = places.get(owner) or places.setdefault(owner, _places(batch[owner]))
                found[owner].append((self.item_ids[item], distance, len(self.words[item]), at[first][0], at[last - 1][1]))
        return found

    def _candidates(self, group: SizeClass, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the class, and the numbers of the windows that agree with them in some sample."""
        windows = ids[starts[:, None] + np.arange(group.words)]
        met = []
        for seed, (steps, table) in enumerate(zip(group.samples, group.keys, strict=True)):
            made = walk(windows, seed, 2 * group.words)
            for keys, (wanted, members) in zip(_keys(made, steps), table, strict=True):
                first = np.searchsorted(wanted, keys)
                many = np.searchsorted(wanted, keys, side="right") - first
                rows = np.flatnonzero(many)
                if len(rows):
                    many = many[rows]
                    # The places of every member with the key, window after window.
                    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    met.append(members[np.repeat(first[rows], many) + within] * len(starts) + np.repeat(rows, many))
        pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        return np.divmod(pairs, len(starts))

    def _verified(self, ids: np.ndarray, pairs: list[int], item: int, starts: list[int]) -> tuple[int, int, int] | None:
        """Distance, first and last word of the passage nearest to the item around the windows, if near enough."""
        wanted, most = self.words[item], edits_allowed(len(self.words[item]))
        own, least = self.pairs[item], len(wanted) - 1 - 2 * most
        best = None
        starts = sorted(set(starts))
        reach = len(wanted) + 2 * most
        while starts:
            first, last = starts[0], starts[0]
            while starts and starts[0] <= last + reach:
                last = starts.pop(0)
            low = max(0, first - 2 * most)
            if sum(map(set(pairs[low : last + reach]).__contains__, own)) < least:
                continue
            found = nearest_passage(wanted, ids[low : last + reach])
            if found[0] <= most and (best is None or found[0] < best[0]):
                best = (found[0], low + found[1], low + found[2])
        return best


def nearest_passage(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to any stretch of ``words``, and that stretch; the first that ends, the longest then."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        index = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else index.copy()
        for k, word in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = k
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != word))
            row = np.minimum.accumulate(new - index) + index  # insertions, from left to right
        return row

    ends = last_row(item, words, True)
    end = int(ends.argmin())
    back = last_row(item[::-1], words[:end][::-1], False)
    return int(ends[end]), end - int(len(back) - 1 - back[::-1].argmin()), end


def words_of(text: str) -> list[str]:
    """Words in lower case; each character of a script without spaces is one."""
    low = text.lower()
    return (WORD if UNSPACED.search(low) is None else SIGN_OR_WORD).findall(low)


def _places(text: str) -> list[tuple[int, int]]:
    """Where each word stands in ``text``; lower case is as long as the text but for rare characters."""
    low = text.lower()
    found = SIGN_OR_WORD.finditer(low)
    if len(low) == len(text):
        return [m.span() for m in found]
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in found]


def _grams(ids: np.ndarray) -> list[np.ndarray]:
    """For each of GRAMS hashes of the runs of so many words, 0 for runs with a word that no item has.

    A shared hash only lets more windows through.
    """
    found, made, full = [], _mixed(ids), ids > 0
    for _ in GRAMS:  # each is one word longer than the one before
        size = max(0, len(made) - 1)
        later = len(ids) - size
        made, full = _mixed(made[:size] ^ ids[later:]), full[:size] & (ids[later:] > 0)
        found.append(np.where(full, (made >> np.uint64(64 - GRAM_BITS)) | np.uint64(1), np.uint64(0)).astype(np.int64))
    return found


def _keys(embedded: np.ndarray, samples: np.ndarray) -> Iterator[np.ndarray]:
    for steps in samples:
        key = embedded[steps[0]]
        for step in steps[1:]:
            key = key * MIX ^ embedded[step]
        yield key


def index(items: list[tuple[int | None, str | None]], least_words: int = MIN_WORDS) -> Index:
    """An index of a block of items, without those of fewer than ``least_words`` words."""
    vocabulary: dict[str, int] = {}
    ids, words = [], []
    for item_id, text in items:
        said = words_of(text or "")
        if len(said) >= max(1, least_words):
            ids.append(item_id)
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in said], np.uint64))
    grams = [np.zeros(1 << GRAM_BITS, np.int8) for _ in GRAMS]
    pairs = []
    for w in words:
        made = _grams(w)
        pairs.append(made[0].tolist())
        for hashes, seen in zip(made, grams, strict=True):
            seen[hashes] = 1
    classes: list[SizeClass] = []
    for item in sorted(range(len(words)), key=lambda i: len(words[i])):
        size = len(words[item])
        # The bounds fall where a size allows one edit more, so each item of a class may lower them;
        # the largest sets the reach of its windows.
        least = [max(0, size - n + 1 - n * edits_allowed(size)) for n in (1, *GRAMS)]
        if not classes or size > SIZES * classes[-1].words:
            classes.append(SizeClass([], size, least, 0))
        classes[-1].least = [min(pair) for pair in zip(classes[-1].least, least, strict=True)]
        classes[-1].items.append(item)
        classes[-1].lead = edits_allowed(size)
        classes[-1].reach = size + classes[-1].lead
    for group in classes:
        _sample(group, words)
    return Index(ids, vocabulary, words, pairs, grams, classes)


def _sample(group: SizeClass, words: list[np.ndarray]) -> None:
    random = np.random.default_rng(group.words)
    each = -(-samples_for(RECALL, AGREE, STEPS) // WALKS)
    block = np.zeros((len(group.items), group.words), np.uint64)
    for row, item in enumerate(group.items):
        block[row] = words[item][: group.words]
    for seed in range(WALKS):
        # Steps of the first half of the walk are the ones that stand on words almost always.
        steps = np.array([random.choice(2 * group.words, STEPS, replace=False) for _ in range(each)])
        made = walk(block, seed, 2 * group.words)
        group.samples.append(steps)
        group.keys.append([(np.sort(k), np.argsort(k, kind="stable")) for k in _keys(made, steps)])


def blocks(benchmark: DataFrame, least_words: int = MIN_WORDS) -> Iterator[Index]:
    """Indexes of the benchmark's items, BLOCK_CHARS at a time; one item at least."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if block and size + len(row["text"] or "") > BLOCK_CHARS:
            yield index(block, least_words)
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
    yield index(block, least_words)


HIT = [("item_id", pa.int64()), ("distance", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]


def leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, distance, similarity, start, end``: the best passage of every leaked item in every row."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, distance int, words int, start int, end int"

    def search(held):
        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", BATCH_BYTES):
                    hits = held.value.find_all([text or "" for text in texts(batch.column(1))])
                    found = [(doc_id, *hit) for doc_id, own in zip(batch.column(0).to_pylist(), hits, strict=True) for hit in own]
                    columns = [pa.array([f[k] for f in found], t) for k, (_, t) in enumerate([("doc_id", pa.int64()), *HIT])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(n for n, _ in HIT)])

        return run

    made = [rows.mapInArrow(search(shared(docs.sparkSession, block)), schema) for block in blocks(benchmark, least_words)]
    found = reduce(DataFrame.unionByName, made)
    similarity = 1 - F.col("distance") / F.col("words")
    return found.select("doc_id", "item_id", "distance", similarity.alias("similarity"), "start", "end")


def _clean(held):
    @F.arrow_udf("boolean")
    @tidied
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = []
            for part in slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text", BATCH_BYTES):
                made += [not hits for hits in held.value.find_all([text or "" for text in texts(part.column("text"))])]
            yield pa.array(made, pa.bool_())

    # Not to be moved: put together with filters below it in a plan that isn't stored, it failed as one that can't be evaluated.
    return clean.asNondeterministic()(F.col("text"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    for block in blocks(benchmark, least_words):
        docs = docs.filter(_clean(shared(docs.sparkSession, block)))
    return docs
