"""How the tokens of two tokenizers line up over a corpus: links between overlapping tokens, counted by document bitmaps.

Both tokenizers encode a space and the text. Byte offsets at which tokens of both end cut a text's tokens
into groups; a link is a pair of token occurrences, one of each tokenizer, whose bytes overlap. Workers encode
a unit (a run of characters between single spaces) once as long as they remember it: neither tokenizer joins
characters across such a space, and its ends are ends of tokens of both, so a text's groups and links are
those of its units one after the other. Vocabularies for which that isn't so have their texts encoded whole.

Every pair of ids has an inverted list of the documents that hold it linked. Documents are numbered in chunks
of CHUNK_DOCS; in each chunk a pair's list is a compressed bitmap: document numbers, or bits where those are
shorter. How often a document holds the pair is kept in planes: plane ``k`` has the documents in whose number
of links bit ``k`` is set. All planes of a list OR-ed and counted give its documents, and the planes' counts its
links. Chunks share no document, so a pair's counts add up. Scores then return to the documents
through the same lists: each pair's document count meets its planes, chunk by chunk.

Rows: a text that is null or empty, or that one of the tokenizers doesn't give back byte by byte, has no
tokens: zeros, and an empty digest. Texts are encoded whole; rows that repeat a doc_id, or have none, are documents of
their own. Other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import byte_characters
from ledgerloom.llm.common import slices, small, stored, texts, tidied

#: A chunk ends with so many documents, or with the document that brings it to so many links.
CHUNK_DOCS, CHUNK_LINKS = 2048, 1_500_000
BITMAP = CHUNK_DOCS // 8
BATCH_BYTES = 2 << 20
#: Bytes of units, about, that a worker remembers.
UNITS_KEPT = 240 << 20
#: Rows of pairs that are broadcast at most.
BROADCAST_ROWS = 1 << 18
SPACE = "\u2581"
#: A single space between characters that neither tokenizer takes for white space.
SOLID = r"[^\s\u2581\u180e\u200b-\u200d\u2060\ufeff]"
CUT = re.compile(f"(?<={SOLID}) (?={SOLID})")
#: Fixed value: how byte-level vocabularies with a regular expression of their own split texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIGN = re.compile(r"<0x([0-9A-F]{2})>")
#: Tokens of both, groups, the groups as text, and the linked pairs as int64 ``a << 32 | b``.
Aligned = tuple[int, int, int, str, bytes]
NOTHING: Aligned = (0, 0, 0, "", b"")


class Pairing:
    """Two tokenizers, and what is remembered of their units."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: bytes([k]) for k, c in enumerate(byte_characters())}
        shown = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(shown.values()))
        for token, own in shown.items():
            self.bytes_a[own] = b"".join(back.get(c, c.encode()) for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(SIGN.fullmatch(p)[1], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)
        ]
        self.said = [(_said(table, ","), _said(table, end)) for table, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))]
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        #: Whether encoding a unit doesn't depend on the units around it.
        parts = json.loads(self.a.to_str())
        plain = parts["normalizer"] is None and parts["pre_tokenizer"]["type"] == "ByteLevel"
        #: Byte-level vocabularies with all bytes, and without a normaliser, give every text back.
        self.lossless = plain and all(c in shown for c in back)
        self.quick = _ranked(parts, shown, back) if plain and parts["pre_tokenizer"]["use_regex"] else None
        self.by_unit = plain and not any(re.search(f"{SOLID}{SPACE}", p) for p in pieces)
        #: Units met lately, and those met before them.
        self.known: dict[str, Aligned | None] = {}
        self.former: dict[str, Aligned | None] = {}
        self.held = 0

    def _encoded(self, units: list[str]) -> list[Aligned | None]:
        """Each unit aligned, without its space; nothing where the tokens' bytes aren't those of the unit."""
        wanted = [b" " + unit.encode() for unit in units]
        made_a = self._encoded_by_a([" " + u for u in units])
        made_b = self.b.encode(units, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = [b"".join(map(of_b, b)) == x for x, b in zip(wanted, made_b, strict=True)]
        if not self.lossless:
            same = [ok and b"".join(map(of_a, a)) == x for ok, x, a in zip(same, wanted, made_a, strict=True)]
        if all(same):
            return self._align(made_a, made_b)
        fit = iter(self._align(*([x for x, ok in zip(made, same, strict=True) if ok] for made in (made_a, made_b))))
        return [next(fit) if ok else None for ok in same]

    def _encoded_by_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A; those of ASCII texts from the ranks, where A is such a vocabulary, as that is several times faster."""
        if self.quick is None:
            return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        others = iter(self.a.encode_batch_fast([x for x in texts if not x.isascii()], add_special_tokens=False))
        return [self.quick(x) if x.isascii() else next(others).ids for x in texts]

    def _align(self, made_a: list[list[int]], made_b: list[list[int]]) -> list[Aligned]:
        """The groups and links of every unit, whose tokens of both kinds have the same bytes.

        All units lie one after the other, so that their tokens' ends count on from unit to unit.
        """
        counts = [np.fromiter(map(len, made), np.int64, len(made)) for made in (made_a, made_b)]
        ids = [np.fromiter(chain.from_iterable(made), np.int64, int(n.sum())) for made, n in zip((made_a, made_b), counts, strict=True)]
        ends = [np.cumsum(sizes[own]) for sizes, own in zip(self.sizes, ids, strict=True)]
        # Between two neighbouring ends there is one token of each kind: a link.
        marks = np.union1d(*ends)
        which = [np.searchsorted(own, marks) for own in ends]
        links = (ids[0][which[0]] << 32 | ids[1][which[1]]).tobytes()
        lasts = [np.cumsum(n) for n in counts]
        link_ends = (8 * np.searchsorted(marks, ends[0][lasts[0] - 1], side="right")).tolist() if len(marks) else []
        closing = [np.isin(own, other, assume_unique=True) for own, other in (ends, ends[::-1])]
        group = [np.cumsum(closes) - closes for closes in closing]
        said = np.concatenate([np.where(closes, end[own], comma[own]) for closes, own, (comma, end) in zip(closing, ids, self.said, strict=True)])
        said = said[np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")].tolist()
        n_groups = np.diff(np.concatenate([[0], np.cumsum(closing[0])[lasts[0] - 1]])).tolist() if len(marks) else []
        made, token, link = [], 0, 0
        for n_a, n_b, groups, link_end in zip(counts[0].tolist(), counts[1].tolist(), n_groups, link_ends, strict=True):
            made.append((n_a, n_b, groups, "".join(said[token : token + n_a + n_b])[:-1], links[link:link_end]))
            token, link = token + n_a + n_b, link_end
        return made

    def _learn(self, units: set[str]) -> None:
        """Have all ``units`` among the known ones."""
        if self.held > UNITS_KEPT // 2:
            self.known, self.former, self.held = {}, self.known, 0
        missing = []
        for unit in units:
            if unit not in self.known:
                if unit in self.former:
                    self._keep(unit, self.former[unit])
                else:
                    missing.append(unit)
        if missing:
            for unit, made in zip(missing, self._encoded(missing), strict=True):
                self._keep(unit, made)

    def _keep(self, unit: str, made: Aligned | None) -> None:
        self.known[unit] = made
        self.held += 300 + len(unit) + (len(made[3]) + len(made[4]) if made else 0)

    def aligned(self, batch: list[str | None]) -> Iterator[Aligned]:
        """Each text aligned."""
        split = [(CUT.split(text) if self.by_unit else [text]) if text else [] for text in batch]
        self._learn(set(chain.from_iterable(split)))
        for text, units in zip(batch, split, strict=True):
            parts = list(map(self.known.__getitem__, units))
            if None in parts:
                # Bytes that one unit lacks might be another's; the whole text decides.
                made = self._encoded([text])[0] or NOTHING
            elif parts:
                n_a, n_b, n_groups, groups, links = zip(*parts, strict=True)
                made = (sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links))
            else:
                made = NOTHING
            yield made


def _ranked(parts: dict, shown: dict[str, int], back: dict[str, bytes]) -> Callable[[str], list[int]] | None:
    """An encoder by ranks that gives the ids of A on ASCII; none if A's ids don't follow the order of its merges."""
    merges = [m if isinstance(m, list) else m.split(" ") for m in parts["model"]["merges"]]
    made = [shown.get("".join(merge), -1) for merge in merges]
    tokens = {token: own for token, own in shown.items() if all(c in back for c in token)}
    if any(x < 0 for x in made) or made != sorted(set(made)) or len(merges) + 256 > len(tokens):
        return None
    import tiktoken

    ranks = {b"".join(map(back.__getitem__, token)): own for token, own in tokens.items()}
    for token in parts["added_tokens"]:
        ranks.pop(token["content"].encode(), None)
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _said(table: list[bytes], end: str) -> np.ndarray:
    """Each id as text, with what follows it."""
    return np.array([f"{own}{end}" for own in range(len(table))], object)


@lru_cache(maxsize=1)
def pairing(a_path: str, b_path: str) -> Pairing:
    return Pairing(a_path, b_path)


# Bitmaps -------------------------------------------------------------------------------


def packed(slots: np.ndarray) -> bytes:
    """The compressed bitmap of document numbers below CHUNK_DOCS, in order."""
    if 2 * len(slots) < BITMAP:
        return slots.astype("<u2").tobytes()
    bits = np.zeros(CHUNK_DOCS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(bitmap: bytes) -> np.ndarray:
    """The document numbers of a compressed bitmap."""
    if len(bitmap) < BITMAP:
        return np.frombuffer(bitmap, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def merged(bitmaps: list[bytes]) -> bytes:
    """The bitmap of the documents of any of ``bitmaps``."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    bits = np.zeros(CHUNK_DOCS, bool)
    for bitmap in bitmaps:
        bits[unpacked(bitmap)] = True
    return packed(np.flatnonzero(bits))


def popcount(bitmap: bytes) -> int:
    if len(bitmap) < BITMAP:
        return len(bitmap) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, np.uint64)).sum())


def posting_lists(links: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """``pair, planes`` of a chunk of documents with their links."""
    codes = np.frombuffer(b"".join(links), np.int64)
    slots = np.repeat(np.arange(len(links)), [len(x) // 8 for x in links])
    pairs, which = np.unique(codes, return_inverse=True)
    held, times = np.unique(which * CHUNK_DOCS + slots, return_counts=True)
    which, slots = held // CHUNK_DOCS, held % CHUNK_DOCS
    starts = np.searchsorted(which, np.arange(len(pairs) + 1)).tolist()
    most = np.maximum.reduceat(times, starts[:-1]).tolist() if len(pairs) else []
    short = slots.astype("<u2").tobytes()
    for k, (pair, top) in enumerate(zip(pairs.tolist(), most, strict=True)):
        start, end = starts[k], starts[k + 1]
        if top == 1 and 2 * (end - start) < BITMAP:
            yield pair, [short[2 * start : 2 * end]]
        else:
            own, counts = slots[start:end], times[start:end]
            yield pair, [packed(own[(counts >> plane) & 1 == 1]) for plane in range(int(top).bit_length())]


# Spark ---------------------------------------------------------------------------------

FIELDS = [
    ("chunk", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()),
    ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()), ("links", pa.int64()), ("planes", pa.list_(pa.binary())),
]
SCHEMA = (
    "chunk long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "a int, b int, docs long, links long, planes array<binary>"
)
N_DOC = 9


def _record(columns: dict[str, list]) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * rows), t) for n, t in FIELDS], [n for n, _ in FIELDS])


def _lists_of(chunk: int, links: list[bytes]) -> Iterator[pa.RecordBatch]:
    names = ("chunk", "a", "b", "docs", "links", "planes")
    rows: list[tuple] = []
    for pair, planes in posting_lists(links):
        n_links = sum(popcount(plane) << k for k, plane in enumerate(planes))
        rows.append((chunk, pair >> 32, pair & 0xFFFFFFFF, popcount(merged(planes)), n_links, planes))
        if len(rows) == 20_000:
            yield _record(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
            rows = []
    if rows:
        yield _record(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def _indexed(a_path: str, b_path: str, keep_groups: bool) -> Callable:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pairing(a_path, b_path)
        gc.disable()  # what is remembered has no cycles, and looking for some takes a fifth of the time
        chunk = TaskContext.get().partitionId() << 32
        links: list[bytes] = []
        held = 0
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                rows: list[tuple] = []
                for doc_id, made in zip(batch.column(0).to_pylist(), own.aligned(texts(batch.column(1))), strict=True):
                    n_a, n_b, n_groups, groups, pairs = made
                    digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                    rows.append((chunk, len(links), doc_id, n_a, n_b, n_groups, len(pairs) // 8, digest, groups if keep_groups else None))
                    links.append(pairs)
                    held += len(pairs) // 8
                    if len(links) == CHUNK_DOCS or held >= CHUNK_LINKS:
                        yield from _lists_of(chunk, links)
                        chunk, links, held = chunk + 1, [], 0
                yield _record({n: list(x) for (n, _), x in zip(FIELDS[:N_DOC], zip(*rows, strict=True), strict=True)})
        if links:
            yield from _lists_of(chunk, links)
        gc.enable()

    return run


@dataclass(frozen=True)
class Alignment:
    """A corpus aligned.

    ``docs``: a row for each document with its place (``chunk, slot``), counts and groups; ``postings``: the planes
    of every pair in every chunk; ``pairs``: ``a, b, docs, links, best`` of every pair, where ``best`` tells the pairs
    with most documents of their ``a``.
    """

    docs: DataFrame
    postings: DataFrame
    pairs: DataFrame


def alignment(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> Alignment:
    """Align the texts of ``docs``; ``groups`` of the documents are kept as text only if asked for."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    made = stored(rows.mapInArrow(_indexed(a_path, b_path, keep_groups), SCHEMA), "crosstoken")
    postings = made.filter("slot IS NULL").select("chunk", "a", "b", "docs", "links", "planes")
    pairs = postings.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    pairs = stored(pairs, "crosstoken-pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    pairs = pairs.join(most, "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))
    own = made.filter("slot IS NOT NULL").select(*[n for n, _ in FIELDS[:N_DOC]])
    return Alignment(own, postings, stored(pairs, "crosstoken-scores"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each document of rows of ``chunk, planes, docs, best``, in order of chunks."""
    chunk, sums = None, np.zeros((2, CHUNK_DOCS), np.int64)

    def finished() -> pa.RecordBatch:
        slots = np.flatnonzero(sums[1])
        columns = [np.full(len(slots), chunk or 0, np.int64), slots.astype(np.int32), sums[0][slots], sums[1][slots]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["chunk", "slot", "n_best", "count_sum"])

    for batch in batches:
        chunks = batch.column(0).to_numpy()
        starts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist()] if len(chunks) else []
        for start, end in zip(starts, [*starts[1:], len(chunks)], strict=True):
            if chunks[start] != chunk:
                if chunk is not None:
                    yield finished()
                chunk, sums = int(chunks[start]), np.zeros((2, CHUNK_DOCS), np.int64)
            docs = batch.column(2).to_numpy()[start:end]
            best = batch.column(3).to_numpy(zero_copy_only=False)[start:end].astype(np.int64)
            planes = batch.column(1).slice(start, end - start).to_pylist()
            for plane in range(max(map(len, planes))):
                rows = [k for k, own in enumerate(planes) if len(own) > plane]
                slots = [unpacked(planes[k][plane]) for k in rows]
                times = np.repeat(rows, list(map(len, slots)))
                at = np.concatenate(slots)
                np.add.at(sums[0], at, best[times] << plane)
                np.add.at(sums[1], at, docs[times] << plane)
    if chunk is not None:
        yield finished()


def scores(made: Alignment) -> DataFrame:
    """``chunk, slot, n_best, count_sum`` of every document with links: links that are best, and the sum of their pairs' documents."""
    counts = small(made.pairs.select("a", "b", F.col("docs").alias("n"), "best"), BROADCAST_ROWS)
    rows = made.postings.select("chunk", "a", "b", "planes").join(counts, ["a", "b"]).select("chunk", "planes", "n", "best")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk")
    return rows.mapInArrow(_returned, "chunk long, slot int, n_best long, count_sum long")


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    made = alignment(docs, a_path, b_path)
    own = made.docs.join(scores(made), ["chunk", "slot"], "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
