"""Byte-level BPE encoding and decoding of a text column with the tokenizers library.

Texts arrive in Arrow batches. Each is split by the vocabulary's pattern; pieces are encoded by the
library once per worker as long as they stay in its table of known pieces, which is emptied when it
has grown to KNOWN_BYTES (that changes speed only). The library works on characters that stand for
bytes, so decoding turns every id back into its characters' bytes, joins them, and only then decodes
UTF-8: characters that are split between ids come together again.

Offsets are code points of the text, end exclusive. Ids that split a character all have that
character's offsets.

Rows: a null text counts as empty and has no ids; texts of any length are encoded whole. Other
columns are not read; rows that repeat a doc_id are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, texts, tidied

#: Bytes of memory, about, of the pieces that a worker remembers, and characters of those that it remembers.
KNOWN_BYTES, PIECE_CHARS = 40 << 20, 64
#: What a remembered piece takes besides its characters and ids.
ENTRY_BYTES = 200
BATCH_BYTES = 2 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, by rank: its two parts once lower ranks have merged."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(pairwise(parts))]
            low, i = min(found)
            if low >= rank:
                raise ValueError(f"token {token!r} can't be made by merges of lower rank")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        merges.append((parts[0], parts[1]))
    return merges


class Codec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer, decoders, models, pre_tokenizers

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        shown = byte_characters()

        def show(token: bytes) -> str:
            return "".join(map(shown.__getitem__, token))

        vocab = {show(token): rank for token, rank in ranks.items()}
        merges = [(show(a), show(b)) for a, b in merges_of(ranks)]
        self.library = Tokenizer(models.BPE(vocab, merges, cache_capacity=0))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library.decoder = decoders.ByteLevel()
        self.find = regex.compile(pattern).findall
        # The byte table reversed: what the library shows for an id, back in bytes.
        back = {c: bytes([b]) for b, c in enumerate(shown)}
        self.bytes_of = {rank: b"".join(map(back.__getitem__, token)) for token, rank in vocab.items()}
        self.digits_of = {rank: str(rank) for rank in ranks.values()}
        #: Pieces with their ids, as the bytes of an int32 array.
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of ``pieces``; the short ones are remembered."""
        new = list(pieces)
        made = self.library.encode_batch_fast(new, add_special_tokens=False)
        found = {piece: np.array(x.ids, np.int32).tobytes() for piece, x in zip(new, made, strict=True)}
        short = {p: i for p, i in found.items() if len(p) <= PIECE_CHARS}
        size = sum(ENTRY_BYTES + len(p) + len(i) for p, i in short.items())
        if self.known_bytes + size > KNOWN_BYTES:
            self.known, self.known_bytes = {}, 0
        if size <= KNOWN_BYTES:
            self.known.update(short)
            self.known_bytes += size
        return found

    def encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        split = [self.find(text) for text in batch]
        known = self.known  # also if the table is begun anew meanwhile
        missing = {piece for pieces in split for piece in pieces if piece not in known}
        ids_of = _Both(known, self._learn(missing)) if missing else known
        for pieces in split:
            yield np.frombuffer(b"".join(map(ids_of.__getitem__, pieces)), np.int32)

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the code points of ``text`` where each starts and ends."""
        pieces = self.find(text)
        ids, starts, ends = [], [], []
        for piece, at in zip(pieces, accumulate(map(len, pieces), initial=0)):
            made = self.library.encode(piece, add_special_tokens=False)
            ids += made.ids
            starts += [at + s for s, _ in made.offsets]
            ends += [at + e for _, e in made.offsets]
        return ids, starts, ends

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


class _Both(dict):
    """A dict that asks another one for what it lacks."""

    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key: str) -> bytes:
        return self.first[key]


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    return Codec(ranks_path, pattern)


def _mapped(make: Callable[[Codec, list[str]], list[pa.Array]], names: list[str], path: str, pattern: str):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                made = make(own, [x or "" for x in texts(batch.column("text"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names)

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row, with ``starts, ends`` of every id if ``offsets``."""

    def plain(own: Codec, batch: list[str]) -> list[pa.Array]:
        return [pa.array(list(own.encode(batch)), pa.list_(pa.int32()))]

    def placed(own: Codec, batch: list[str]) -> list[pa.Array]:
        made = [own.encode_with_offsets(text) for text in batch]
        return [pa.array([x[k] for x in made], pa.list_(pa.int32())) for k in range(3)]

    names = ["doc_id", "ids", *(["starts", "ends"] if offsets else [])]
    schema = ", ".join(["doc_id long", *(f"{x} array<int>" for x in names[1:])])
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_mapped(placed if offsets else plain, names, ranks_path, pattern), schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            made = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the bytes they decode to.

    Both directions run where the text is, so ids as many as the corpus's tokens are never moved.
    """

    def digests(own: Codec, batch: list[str]) -> list[pa.Array]:
        counts, of_ids, of_bytes = [], [], []
        for ids in map(np.ndarray.tolist, own.encode(batch)):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(own.digits_of.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_mapped(digests, names, ranks_path, pattern), schema)
