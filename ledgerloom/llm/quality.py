"""A quality classifier: a generalised additive model with pairwise interactions.

Features are counts over whole texts. Each is cut into BINS bins by quantiles of the sample, and the
model is a lookup table per feature, and per chosen pair of features a table of PAIR_BINS by PAIR_BINS. Training
goes round the features again and again; each time a shallow tree of three leaves is fitted to the
gradient over the feature's bins and added, damped, to the feature's table. With the tables fixed, the pairs
whose best four-leaf tree lowers the loss most are boosted in the same way. A score is the logistic of the
intercept and one entry of each table: additions of whole columns at a time.

The model is fitted on at most SAMPLE labelled rows, chosen by a hash of the doc_id, about as many of
them as the table has if there are fewer. Everything else covers all rows. The sample's features,
a few numbers a row, are all that reaches the driver.

Rows: a null text counts as empty, and empty texts get a score like all others. Without labelled rows, or
with one label only, the score is the share of label 1, 0.5 if unknown. Rows without a doc_id are not
learned from. Of a doc_id with several labels the more frequent counts, 1 on ties. Columns other than
doc_id and text, and doc_id and quality, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, texts

SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 50, 6
RATE, SMOOTH = 0.1, 2.0
BATCH_BYTES = 8 << 20

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "quote", "mark", "other")
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, QUOTE, MARK, OTHER = range(len(CLASSES))
FEATURES = (
    "log_chars", "upper", "digits", "spaces", "stops", "quotes", "marks", "others", "log_words", "word_length",
    "distinct_words", "commonest_word", "marked_words", "log_lines", "line_length", "distinct_lines", "opening_lines",
)


@cache
def _classes() -> np.ndarray:
    """The class of each character of the basic plane."""
    made = np.full(1 << 16, OTHER, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c == "\n":
            made[code] = LINE
        elif c.isspace():
            made[code] = SPACE
        elif c.isalpha():
            made[code] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            made[code] = DIGIT
        elif c in ".,;:!?":
            made[code] = STOP
        elif c in "'\"()-":
            made[code] = QUOTE
        elif code < 128:
            made[code] = MARK
    return made


def features(text: str) -> list[float]:
    """The numbers a text is judged by; shares are 0 where there is nothing to share."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_classes()[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))
    chars, letters = max(1, len(codes)), max(1, kinds[LOWER] + kinds[UPPER])
    words = text.split()
    count = max(1, len(words))
    counted: dict[str, int] = {}
    for word in words:
        counted[word] = counted.get(word, 0) + 1
    marked = sum(n for word, n in counted.items() if not word[-1].isalnum() and word[-1] not in ".,;:!?'\")")
    lines = [line for line in text.split("\n") if line.strip()]
    n_lines = max(1, len(lines))
    return [
        np.log1p(len(codes)), kinds[UPPER] / letters, kinds[DIGIT] / chars, kinds[SPACE] / chars, kinds[STOP] / count,
        kinds[QUOTE] / count, kinds[MARK] / count, kinds[OTHER] / chars, np.log1p(len(words)), letters / count,
        len(counted) / count**0.8, max(counted.values(), default=0) / count, marked / count, np.log1p(len(lines)),
        np.log1p(len(codes) / n_lines), len(set(lines)) / n_lines, sum(line.lstrip()[0].isupper() for line in lines) / n_lines,
    ]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    made = [features(text or "") for text in texts(batch.column("text"))]
    return np.array(made, np.float64).reshape(len(made), len(FEATURES))


def _bin(column: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, column, side="right")


def _quantiles(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _three_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step for each bin: a tree that cuts the bins in three where it helps most."""
    before_g, before_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    i, j = np.triu_indices(len(before_g))
    total = (
        _gain(before_g[i], before_h[i])
        + _gain(before_g[j] - before_g[i], before_h[j] - before_h[i])
        + _gain(before_g[-1] - before_g[j], before_h[-1] - before_h[j])
    )
    best = int(total.argmax())
    step = np.empty(len(g))
    for part in (slice(0, i[best]), slice(i[best], j[best]), slice(j[best], None)):
        step[part] = g[part].sum() / (h[part].sum() + SMOOTH)
    return step


def _four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The step for each cell of a pair of features: one cut of either, where they help most; and how much that is."""
    parts = []
    for x in (g, h):
        low = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        low[1:, 1:] = x.cumsum(0).cumsum(1)
        rows, columns = low[:, -1:], low[-1:, :]
        parts.append((low, rows - low, columns - low, low[-1, -1] - rows - columns + low))
    total = sum(_gain(a, b) for a, b in zip(*parts, strict=True))
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    step = np.zeros(g.shape)
    for rows in (slice(0, i), slice(i, None)):
        for columns in (slice(0, j), slice(j, None)):
            step[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + SMOOTH)
    return step, float(total.max() - _gain(g.sum(), h.sum()))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[_bin(x[:, k], edges)]
        for (a, b), table in self.pairs.items():
            total += table[_bin(x[:, a], self.pair_edges[a]), _bin(x[:, b], self.pair_edges[b])]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of the rows ``x`` and their labels ``y``, 0 or 1."""
    if not len(y) or y.min() == y.max():
        return Model(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    share = y.mean()
    model = Model(np.log(share / (1 - share)))
    model.edges = [_quantiles(c, BINS) for c in x.T]
    model.pair_edges = [_quantiles(c, PAIR_BINS) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [_bin(c, e) for c, e in zip(x.T, model.edges, strict=True)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for own, table in zip(bins, model.tables, strict=True):
            g, h = (np.bincount(own, v, len(table)) for v in slopes())
            step = RATE * _three_leaves(g, h)
            table += step
            total += step[own]
    coarse = [_bin(c, e) for c, e in zip(x.T, model.pair_edges, strict=True)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def cells(a: int, b: int) -> list[np.ndarray]:
        at, shape = coarse[a] * sizes[b] + coarse[b], (sizes[a], sizes[b])
        return [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in slopes()]

    found = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_four_leaves(*cells(*p))[1])
    model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in found[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            step = RATE * _four_leaves(*cells(a, b))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def learns(doc_id: Column) -> Column:
    """True for rows whose label may be learned from: crc32 of the doc_id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            x = _matrix(batch)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), kind)], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of at most SAMPLE labelled rows of ``docs`` that may be learned from."""
    marked = labels.select(F.col("doc_id").cast("long"), "quality").filter("quality IN (0, 1)").filter(learns(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    count = marked.count()
    # A share of the hashes' range, a little larger than needed; the limit sees to the rest.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    marked = marked.filter(place < int(min(1.0, 1.1 * SAMPLE / max(count, 1)) * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(marked, "doc_id")
    seen = rows.select("quality", "text").mapInArrow(_sample_features, "quality int, x array<double>")
    seen = seen.orderBy(F.xxhash64("x"), "quality").limit(SAMPLE).toPandas()
    x = np.array(seen["x"].tolist(), np.float64).reshape(len(seen), len(FEATURES))
    return fit(x, seen["quality"].to_numpy(np.float64))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                made = model.value.score(_matrix(batch))
                columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(made), pa.array((made >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (~learns(doc_id)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
