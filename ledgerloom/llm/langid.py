"""Language identification with interpolated Kneser-Ney character models.

A text is lower-cased, everything but letters becomes one space, and its character 4-grams are looked
up in each language's model; the language with the lowest cross-entropy per character wins. Counts
of 4-grams are taken over every training row and whole text. All lower orders follow from the
distinct 4-grams, as Kneser-Ney wants: the weight of a shorter gram is the number of characters it
follows, not how often it occurs. Each language keeps, per order, the sorted hashes of its grams with
their counts, and of its contexts with their totals; a lookup is a binary search. Grams are hashed
to ``HASH_BITS`` bits, which bounds a model at 2^HASH_BITS entries per order and language however
large the corpus is; grams that share a hash share their counts.

Rejection is calibrated on all rows of the training set: a text is rejected if its cross-entropy lies
further above the language's median than 99.9 % of them at its length, with some room to spare. Fewer than
FEW_ROWS rows of a language don't show that: the wider of its own limits and of those of all languages
together hold for it, and the higher of both medians.

Rows: a text that is null or has no letter gets ``und`` with score 0 and is rejected, as is every
text if no row has a language. Rows without a doc_id are not learned from. Repeated rows are learned
from as often as they occur. Long texts are counted and scored in blocks. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared, slices, stored, texts, tidied

ORDER = 4
HASH_BITS = 20
#: Rows of a language from which on its rejection limits are its own alone.
FEW_ROWS = 1000
#: Characters beyond which a longer text doesn't make the score surer.
SURE_CHARS = 60
#: Bytes of texts that are taken from a batch at a time, and 4-grams that are held at a time, about.
BATCH_BYTES, BLOCK_CHARS = 1 << 20, 1 << 18
CACHE_BITS = 18
SPACE, SYMBOLS = 32, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """For each character of the basic plane its lower case if it is a letter, else a space."""
    made = np.full(SYMBOLS, SPACE, np.uint64)
    for code in range(SYMBOLS):
        if chr(code).isalpha():
            low = chr(code).lower()
            made[code] = ord(low) if len(low) == 1 and ord(low) < SYMBOLS else code
    return made


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """The 4-grams of a text as numbers of four 16-bit characters, a block of the text at a time; none if it has no letter."""
    line, inside = np.full(ORDER - 1, SPACE, np.uint64), False
    seen = False
    for start in range(0, len(text), BLOCK_CHARS):
        codes = np.frombuffer(text[start : start + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        high = codes >= SYMBOLS
        symbols = _letters()[np.where(high, SPACE, codes)]
        # Letters outside the basic plane are folded into its private area.
        for at in np.flatnonzero(high):
            if chr(codes[at]).isalpha():
                symbols[at] = 0xE000 + int(codes[at]) % 0x1900
        letters = symbols != SPACE
        seen = seen or bool(letters.any())
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # one space after a letter
        keep[0] |= inside
        inside = letters[-1]
        line = np.concatenate([line[1 - ORDER :], symbols[keep]])
        yield _joined(line)
    if seen:
        yield _joined(np.append(line[1 - ORDER :], np.uint64(SPACE)))


def _joined(line: np.ndarray) -> np.ndarray:
    size = len(line) - ORDER + 1
    made = np.zeros(size, np.uint64)
    for k in range(ORDER):
        made = (made << np.uint64(16)) | line[k : size + k]
    return made


def grams(text: str) -> np.ndarray:
    """All 4-grams of a text."""
    return np.concatenate([np.empty(0, np.uint64), *gram_blocks(text)])


def _pieces(batch: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The blocks of all texts, some BLOCK_CHARS 4-grams together, with the place of each block's text."""
    owners, blocks, held = [], [], 0
    for owner, text in enumerate(batch):
        for block in gram_blocks(text):
            if not len(block):
                continue
            if held + len(block) > BLOCK_CHARS and blocks:
                yield owners, blocks
                owners, blocks, held = [], [], 0
            owners.append(owner)
            blocks.append(block)
            held += len(block)
    if blocks:
        yield owners, blocks


@tidied
def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            langs = batch.column("lang").to_pylist()
            for owners, blocks in _pieces([x or "" for x in texts(batch.column("text"))]):
                of: dict[str, list[np.ndarray]] = {}
                for owner, block in zip(owners, blocks, strict=True):
                    of.setdefault(langs[owner], []).append(block)
                for lang, made in of.items():
                    keys, counts = np.unique(np.concatenate(made), return_counts=True)
                    columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram * MIX) >> np.uint64(64 - HASH_BITS)


@dataclass
class Order:
    """One order of one language: sorted hashes of grams and contexts with what belongs to them."""

    slots: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    discount: float = field(init=False)

    def __post_init__(self) -> None:
        once, twice = (self.counts == 1).sum(), (self.counts == 2).sum()
        self.discount = float(once / (once + 2 * twice)) if once and twice else 0.5

    def interpolate(self, grams_: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of each gram's last character after the others, ``lower`` being that of the order below."""
        n = _find(self.slots, _slot(grams_), self.counts)
        context = _slot(grams_ >> np.uint64(16))
        total, kinds = _find(self.contexts, context, self.totals), _find(self.contexts, context, self.kinds)
        seen = np.maximum(total, 1)
        mixed = (np.maximum(n - self.discount, 0) + self.discount * kinds * lower) / seen
        return np.where(total > 0, mixed, lower)


def _find(slots: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(slots):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(slots, wanted), len(slots) - 1)
    return np.where(slots[at] == wanted, values[at], 0.0)


@dataclass
class Model:
    languages: list[str]
    orders: dict[str, list[Order]]
    limits: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Minus the logarithm of each 4-gram's probability, a column per language."""
        made = np.empty((len(wanted), len(self.languages)), np.float32)
        for column, language in enumerate(self.languages):
            p = np.full(len(wanted), 1 / SYMBOLS)
            for n, order in enumerate(self.orders[language], 1):
                p = order.interpolate(wanted & np.uint64((1 << 16 * n) - 1), p)
            made[:, column] = -np.log(p)
        return made


class Scorer:
    """Scores with a model; what was looked up lately is kept at a place given by its hash."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.rows = np.zeros((1 << CACHE_BITS, len(model.languages)), np.float32)

    def entropies(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its 4-grams, and the mean of their bits in each language."""
        sizes = np.zeros(len(batch), np.int64)
        sums = np.zeros((len(batch), len(self.model.languages)))
        for owners, blocks in _pieces(batch):
            lengths = np.array([len(x) for x in blocks])
            rows = self._bits(np.concatenate(blocks))
            starts = np.cumsum(lengths) - lengths
            np.add.at(sizes, owners, lengths)
            for column in range(rows.shape[1]):
                np.add.at(sums[:, column], owners, np.add.reduceat(rows[:, column], starts, dtype=np.float64))
        return sizes, sums / np.maximum(sizes, 1)[:, None]

    def _bits(self, wanted: np.ndarray) -> np.ndarray:
        at = (wanted * MIX) >> np.uint64(64 - CACHE_BITS)
        rows = self.rows[at]
        missed = self.keys[at] != wanted
        if missed.any():
            new, back = np.unique(wanted[missed], return_inverse=True)
            found = self.model.bits(new)
            rows[missed] = found[back]
            places = (new * MIX) >> np.uint64(64 - CACHE_BITS)
            _, last = np.unique(places[::-1], return_index=True)  # one gram for each place
            last = len(places) - 1 - last
            self.keys[places[last]] = new[last]
            self.rows[places[last]] = found[last]
        return rows

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, rejection, number of 4-grams and cross-entropy of each text."""
        sizes, means = self.entropies(batch)
        if not self.model.languages:
            none = np.zeros(len(batch))
            return [UNDETERMINED] * len(batch), none, none == 0, sizes, none
        best = means.argmin(axis=1)
        lowest = means[np.arange(len(batch)), best]
        sure = np.minimum(sizes, SURE_CHARS)[:, None]
        score = np.where(sizes > 0, 1 / np.exp(-sure * (means - lowest[:, None])).sum(axis=1), 0.0)
        names = [self.model.languages[b] if n else UNDETERMINED for b, n in zip(best, sizes, strict=True)]
        limits = np.array([self.model.limits.get(x, (0.0, np.inf, 0.0)) for x in self.model.languages])[best]
        room = limits[:, 1] + limits[:, 2] / np.sqrt(np.maximum(sizes, 1))
        rejected = (sizes == 0) | (lowest - limits[:, 0] > room)
        return names, score, rejected, sizes, lowest


def _order_counts(counted: DataFrame) -> DataFrame:
    """``lang, n, kind, slot, a, b``: counts of grams, and totals and kinds of contexts, of every order."""
    made, level = [], counted
    for n in range(ORDER, 0, -1):
        context = F.shiftrightunsigned("gram", 16)
        contexts = level.groupBy("lang", context.alias("gram")).agg(
            F.sum("n").alias("a"), F.count(F.lit(1)).alias("b")
        )
        made.append(level.select("lang", F.lit(n).alias("n"), F.lit("gram").alias("kind"), "gram", F.col("n").alias("a"), F.lit(0).alias("b")))
        made.append(contexts.select("lang", F.lit(n).alias("n"), F.lit("context").alias("kind"), "gram", "a", "b"))
        shorter = F.col("gram").bitwiseAND((1 << 16 * (n - 1)) - 1)
        level = level.groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    return rows


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
        yield batch.set_column(batch.schema.get_field_index("gram"), "gram", pa.array(_slot(keys).view(np.int64)))


def train(rows: DataFrame) -> Model:
    """The model of the rows' languages: ``rows`` has lang and text, and no null lang."""
    counted = rows.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long")
    counted = stored(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    folded = _order_counts(counted).mapInArrow(_fold, "lang string, n int, kind string, gram long, a long, b long")
    # At most 2^HASH_BITS rows for each language, order and kind.
    folded = folded.groupBy("lang", "n", "kind", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = {k: v.sort_values("gram") for k, v in folded.toPandas().groupby(["lang", "n", "kind"])}
    languages = sorted({k[0] for k in parts})
    return Model(languages, {x: [_order(parts, x, n) for n in range(1, ORDER + 1)] for x in languages})


def _order(parts: dict, language: str, n: int) -> Order:
    grams_, contexts = parts[language, n, "gram"], parts[language, n, "context"]
    slots = [x["gram"].to_numpy().astype(np.uint64) for x in (grams_, contexts)]
    return Order(slots[0], grams_["a"].to_numpy(float), slots[1], contexts["a"].to_numpy(float), contexts["b"].to_numpy(float))


def _predictions(model: Model):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                names, score, rejected, sizes, lowest = scorer.predict([x or "" for x in texts(batch.column("text"))])
                made = [pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(sizes, pa.int64()), pa.array(lowest)]
                kept = [x for x in batch.schema.names if x != "text"]
                columns = [batch.column(x) for x in kept] + made
                yield pa.RecordBatch.from_arrays(columns, kept + ["lang_pred", "score", "rejected", "chars", "entropy"])

    return run


def predict(rows: DataFrame, model) -> DataFrame:
    """``rows`` (a text and a few narrow columns) with lang_pred, score, rejected, chars and entropy for text.

    ``model`` is a broadcast Model.
    """
    narrow = [f"`{name}` {kind}" for name, kind in rows.dtypes if name != "text"]
    schema = ", ".join([*narrow, "lang_pred string, score double, rejected boolean, chars long, entropy double"])
    return rows.mapInArrow(_predictions(model), schema)


def calibrate(rows: DataFrame, model: Model) -> None:
    """Sets the rejection limits: a median, and how far above it a text may lie in any case and by its length."""
    spark = rows.sparkSession
    scored = predict(rows.select("lang", "text"), shared(spark, model))
    scored = stored(scored.filter("lang = lang_pred").select("lang", "chars", "entropy"), "entropies")
    medians = scored.groupBy("lang").agg(F.percentile_approx("entropy", 0.5, 10_000).alias("median"))
    off = scored.join(F.broadcast(medians), "lang").withColumn("off", F.expr("entropy - median"))
    limits = [
        F.percentile_approx(F.expr("if(chars >= 500, off, NULL)"), 0.999, 10_000).alias("far"),
        F.percentile_approx(F.expr("off * sqrt(chars)"), 0.999, 10_000).alias("by_length"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("chars") >= 500).alias("n_long"),
    ]
    together = off.agg(F.percentile_approx("entropy", 0.5, 10_000).alias("median"), *limits).first()
    if not together["n"]:
        return
    own = {row["lang"]: row for row in off.groupBy("lang", "median").agg(*limits).collect()}  # one row per language
    for language in model.languages:
        row = own.get(language, together)
        few, few_long = row["n"] < FEW_ROWS, row["n_long"] < FEW_ROWS
        median = max(row["median"], together["median"]) if few else row["median"]
        far = max(row["far"] or 0.0, (together["far"] or 0.0) if few_long else 0.0, 0.1)
        by_length = max(row["by_length"], together["by_length"] if few else 0.0, 0.0)
        model.limits[language] = (median, 1.5 * far, 1.5 * by_length)


def learns(docs: DataFrame) -> Column:
    """True for rows that may be learned from: crc32 of the doc_id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model with its rejection limits, from the rows of ``docs`` that may be learned from."""
    rows = docs.filter(learns(docs) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    model = train(rows)
    calibrate(rows, model)
    return model


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row of ``docs``."""
    model = shared(docs.sparkSession, fit(docs))
    rows = docs.select(F.col("doc_id").cast("long"), (~learns(docs)).alias("held_out"), "text")
    return predict(rows, model).drop("chars", "entropy")


def only_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected."""
    model = shared(docs.sparkSession, fit(docs))

    @F.arrow_udf("boolean")
    @tidied
    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model.value)
        for batch in batches:
            made = []
            for part in slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text", BATCH_BYTES):
                made.append(~scorer.predict([x or "" for x in texts(part.column("text"))])[2])
            yield pa.array(np.concatenate(made) if made else [], pa.bool_())

    return docs.filter(accepted(F.col("text")))
