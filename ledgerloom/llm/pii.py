"""Personal data: base patterns with code point spans, and terms that reveal what the patterns found.

Base spans come from four patterns, leftmost and without overlap within a kind; matches that fail a kind's
check (parts of an ip, digits and check digit of a card, digits of a phone number) are dropped. The
patterns are written so that no part of a match is given back, and a match starts at the beginning
of its run of characters or where the last match ended: the same matches, in linear time.

Information-theoretic sanitisation then asks which words give a protected entity away. For every entity
(the text of an email address, ip, card or phone number) and every word within WINDOW words of one of its
mentions, documents are counted: n(e) with the entity, n(t) with the word anywhere, n(t, e) with the word
near the entity. The word discloses ``PMI(t; e) / IC(e)`` of the entity: the share of the information in
its occurrence that the word's occurrence carries, 1 if the word never occurs without it. Words of fewer than
MIN_SUPPORT documents with the entity are not judged, as one meeting proves nothing. Near mentions of the
entity, words that disclose REMOVE or more become spans of kind ``remove``, those from GENERALISE on of kind
``generalise``. Words inside base spans are not judged.

All of it is DataFrame code. Texts are read twice and never move; what is grouped and joined are
mentions, words near them, and the document counts of these words. Counts are over all documents.

Rows: a null text counts as empty. Every row is a document, also where rows repeat a doc_id or all of
another row; equal rows get equal results. A null doc_id is a value like any other.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
MIN_SUPPORT = 2
REMOVE, GENERALISE = 0.9, 0.6
#: A list of words is broadcast only if it was counted as no longer than this.
BROADCAST_WORDS = 200_000

#: Marks around matches. Where a text has the mark itself, another control character takes its place;
#: neither is part of any pattern.
MARK, OTHER = "\x01", "\x02"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: What separates the words that are judged.
NO_WORD = r"[^\p{L}\p{N}]+"

SPAN = "struct<start: int, kind: int, end: int, value: string>"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the pattern's matches: what is no match and what is, in turn."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), f"({pattern})", f"{MARK}$1{MARK}")
    return F.split(marked, MARK)


def _placed(pieces: Column, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Every second piece that is valid, with its place in the text, counted in code points."""

    def step(state: Column, piece: Column) -> Column:
        start = state["at"]
        end = start + F.length(piece)
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece.alias("value"))
        spans = F.when(state["hit"] & valid(piece), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), (~state["hit"]).alias("hit"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", ""), r"\.")
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def spans_of(text: Column, kind: str) -> Column:
    """The kind's spans in a text: an array of start, kind (its place in KINDS), end and value."""
    none = F.array().cast(f"array<{SPAN}>")
    found = _placed(_pieces(text, PATTERNS[kind]), KINDS.index(kind), partial(_valid, kind))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text`` and an array of spans for each kind."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({kind: spans_of(F.col("text"), kind) for kind in KINDS})


def _words(text: Column, start: Column) -> Column:
    """``word, start, end`` of the words of ``text``, which stands at ``start``."""
    placed = _placed(_pieces(text, r"[\p{L}\p{N}]++"), 0, lambda word: F.lit(True))
    return F.transform(
        placed,
        lambda s: F.struct(F.lower(s["value"]).alias("word"), (start + s["start"]).alias("start"), (start + s["end"]).alias("end")),
    )


def mentions(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, near`` of rows with base spans: ``entity, word, start, end`` of words near mentions."""
    # WINDOW words either way are looked for in so many characters that longer ones are no words to judge.
    room = 40 * WINDOW
    text, spans = F.col("text"), F.col("spans")

    def around(span: Column) -> Column:
        left_at = F.greatest(span["start"] - room, F.lit(0))
        left = _words(F.substr(text, left_at + 1, span["start"] - left_at), left_at)
        right = _words(F.substr(text, span["end"] + 1, F.lit(room)), span["end"])
        words = F.concat(F.slice(F.reverse(left), 1, WINDOW), F.slice(right, 1, WINDOW))
        outside = F.filter(words, lambda w: ~F.exists(spans, lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))
        return F.transform(outside, lambda w: F.struct(span["value"].alias("entity"), w["word"], w["start"], w["end"]))

    rows = found.select("doc_id", "text_hash", "text", F.concat(*KINDS).alias("spans")).filter(F.size("spans") > 0)
    return rows.select("doc_id", "text_hash", F.flatten(F.transform("spans", around)).alias("near"))


def _document_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``word, docs``: how many documents have each of ``words`` anywhere."""
    said = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), NO_WORD))
    rows = docs.select(F.explode(said).alias("word"))
    few = words.count() <= BROADCAST_WORDS
    if few:
        rows = rows.join(F.broadcast(words), "word", "left_semi")
    # Summed up where the documents are; a word moves once for each task.
    counted = rows.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    return counted if few else counted.join(words, "word", "left_semi")


def disclosures(docs: DataFrame, near: DataFrame) -> DataFrame:
    """``entity, word, disclosure`` of the words that share MIN_SUPPORT documents with an entity or more."""
    total = docs.count()
    pairs = F.array_distinct(F.transform("near", lambda w: F.struct(w["entity"].alias("entity"), w["word"].alias("word"))))
    met = near.select(F.explode(pairs).alias("pair")).groupBy("pair.entity", "pair.word")
    both = stored(met.agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= MIN_SUPPORT), "pii-pairs")
    entities = near.select(F.explode(F.array_distinct(F.col("near")["entity"])).alias("entity"))
    entities = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"))
    words = stored(_document_counts(docs, both.select("word").distinct()), "pii-words")
    rows = both.join(words, "word").join(entities, "entity")
    pmi = F.log2(F.lit(float(total)) * F.col("both") / (F.col("docs") * F.col("entity_docs")))
    information = F.log2(F.lit(float(total)) / F.col("entity_docs"))
    # An entity of every document has nothing to disclose.
    return rows.select("entity", "word", F.when(information > 0, pmi / information).otherwise(0.0).alias("disclosure"))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash``, the base spans by kind, and ``added``: the spans of revealing words."""
    found = base_spans(docs)
    near = stored(mentions(found), "pii-mentions")
    risky = disclosures(docs, near).filter(F.col("disclosure") >= GENERALISE)
    kind = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    words = near.select("doc_id", "text_hash", F.explode("near").alias("w")).select("doc_id", "text_hash", "w.*")
    added = words.join(risky, ["entity", "word"]).groupBy("doc_id", "text_hash", "start", "end").agg(F.max(kind).alias("kind"))
    added = added.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("added")
    )
    same = found["doc_id"].eqNullSafe(added["_id"]) & (found["text_hash"] == added["_hash"])
    return found.join(added, same, "left").drop("_id", "_hash")


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of structs of start, kind (a number) , end and name, in this order, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts by kind, a digest of the base spans, and all spans, of every row."""
    rows = find(docs).drop("text")
    names = F.array(*map(F.lit, KINDS))

    def plain(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(names, s["kind"]).alias("name"))

    def more(s: Column) -> Column:
        order = F.when(s["kind"] == "generalise", len(KINDS)).otherwise(len(KINDS) + 1)
        return F.struct(s["start"].alias("start"), order.alias("kind"), s["end"].alias("end"), s["kind"].alias("name"))

    base = F.transform(F.concat(*KINDS), plain)
    extra = F.coalesce(F.transform("added", more), F.array().cast("array<struct<start: int, kind: int, end: int, name: string>>"))
    return rows.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, extra)).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: base spans stand as their kind in brackets, revealing words as ``[...]`` or not at all.

    Where spans overlap, the one that starts first counts, of those the one listed first.
    """
    rows = find(docs)
    names = F.array(*(F.lit(f"[{kind}]") for kind in KINDS))
    base = F.transform(F.concat(*KINDS), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(names, s["kind"]).alias("by")))
    extra = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), F.when(s["kind"] == "generalise", "[...]").otherwise("").alias("by")))
    spans = F.array_sort(F.concat(base, F.coalesce(extra, F.array().cast("array<struct<start: int, kind: int, end: int, by: string>>"))))
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        said = F.concat(state["parts"], F.array(F.substr(text, state["at"] + 1, s["start"] - state["at"]), s["by"]))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), said.alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(spans, start, step, lambda state: F.concat(F.array_join(state["parts"], ""), F.substr(text, state["at"] + 1, F.length(text))))
    return rows.select("doc_id", clean.alias("text"))
