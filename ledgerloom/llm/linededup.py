"""Line dedup with a log-template tree: recurring line templates lose all but their first document.

A line's path through the tree is its number of tokens and its first DEPTH tokens; tokens with a digit
are variable and stand as ``<*>``, unless a line has no others. In scripts without spaces each character is a token. Below the path lies a leaf. Lines of a leaf that agree in every token
are one template. Where a leaf holds several, it gets one general template: the commonest token
of every position, over the leaf's distinct lines (the larger string on ties). Lines that agree with
it in SIMILARITY of their tokens or more belong to it, the other positions being variable fields; the
rest keep templates of their own. Unlike a tree that is fed line by line, the result doesn't depend on
any order.

A template recurs if MIN_DOCS documents or more (distinct doc_ids) have a line of it. Its lines are dropped
from all documents but the one of the smallest doc_id, so nothing that was said is lost altogether.
Blank lines have no tokens and stay.

Rows: a null text stays null and has no lines; an empty text is one empty line. Rows without a doc_id
count for no document and lose lines that recur in others. Rows that repeat a doc_id count as one
document; equal rows get equal results. Repeated lines within one document are no recurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget_stored, stored, stored_count

DEPTH = 3
MIN_TOKENS = 1
MIN_DOCS = 2
SIMILARITY = 0.8
VARIABLE = "<*>"
#: White space within a line; all of it separates tokens.
WHITE = r"[ \t\r\x0b\x0c]"
OTHER_WHITE = r"[\t\r\x0b\x0c]"
#: The blocks of scripts that put no spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han), as
#: first and last code points; and a character of any of them, for Java and for RE2.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
SIGN = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in UNSPACED) + "]"
ONLY_VARIABLE = r"^<\*>( <\*>)*$"
#: A line that is nothing else once its tokens with digits are masked.
ALL_VARIABLE = r"^(?:(?:<\*>(?= |$)|[^ 0-9]*+[0-9][^ ]*+)(?: |$))++$"
#: A text without digits, white space but spaces and line ends, or characters of those scripts: tested in one run over it.
PLAIN = r"^[\n -/:-\x{dff}\x{2000}-\x{2fff}]*\z"
#: Leaves of several templates are broadcast only if counted as no more than this, 8 bytes each.
BROADCAST_LEAVES = 1_000_000


def masked(line: Column) -> Column:
    """The line's tokens joined by one space each, those with a digit as ``<*>`` if there are others."""
    plain = F.trim(F.when(F.contains(line, F.lit("  ")) | line.rlike(OTHER_WHITE), F.regexp_replace(line, f"{WHITE}+", " ")).otherwise(line))
    # A token is entered at its start only, and its parts give nothing back: linear in the line.
    variable = F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", VARIABLE)
    return F.when(line.rlike("[0-9]") & ~plain.rlike(ALL_VARIABLE), variable).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """A row for every line with tokens; ``text_hash`` tells rows of one doc_id apart."""
    # Masked before they become rows, so that no later step does it again. Most texts have nothing to mask.
    text = F.col("text")
    spaced = F.when(text.rlike(SIGN), F.regexp_replace(text, f"({SIGN})", " $1 ")).otherwise(text)
    plain = text.rlike(PLAIN) & ~F.contains(text, F.lit("  "))
    lines = F.when(plain, F.transform(F.split(text, "\n"), lambda line: F.trim(line))).otherwise(F.transform(F.split(spaced, "\n"), masked))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines).alias("pos", "masked"))
    # Told without counting, as the optimizer counts once more for a filter on the count.
    rows = rows.filter(F.substring_index("masked", " ", MIN_TOKENS - 1) != F.col("masked"))
    rows = rows.withColumn("tokens", F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "))) + 1)
    leaf = F.xxhash64("tokens", F.substring_index("masked", " ", DEPTH))
    return rows.withColumns({"leaf": leaf, "line_id": F.xxhash64("tokens", "masked")})


def _general(lines: DataFrame) -> DataFrame:
    """``leaf, line_id`` of the lines that belong to their leaf's general template."""
    distinct = lines.groupBy("leaf", "line_id").agg(F.lit(1).alias("_"))
    mixed = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("leaf")
    mixed = stored(mixed, "mixed-leaves")
    few = mixed.count() <= BROADCAST_LEAVES
    texts = lines.select("leaf", "line_id", "masked").join(F.broadcast(mixed) if few else mixed, "leaf")
    texts = stored(texts.groupBy("leaf", "line_id").agg(F.min("masked").alias("masked")), "leaves")
    tokens = texts.select("leaf", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    common = tokens.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    common = common.groupBy("leaf", "at").agg(F.max(F.struct("n", "token"))["token"].alias("token"))
    template = common.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "token")))["token"].alias("template"))
    agree = F.zip_with(F.split("masked", " "), "template", lambda a, b: F.when(a == b, 1).otherwise(0))
    share = F.aggregate(agree, F.lit(0), lambda s, x: s + x) / F.size("template")
    return texts.join(template, "leaf").filter(share >= SIMILARITY).select("leaf", "line_id")


def parsed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pos, template``: the template of every line with tokens."""
    # Stored with their texts, so that documents are read and masked once.
    lines = stored(_lines(docs).select("doc_id", "text_hash", "pos", "leaf", "line_id", "masked"), "lines", compression="zstd")
    general = _general(lines).withColumn("general", F.lit(True))
    template = F.when(F.col("general"), F.xxhash64(F.lit("leaf"), "leaf")).otherwise(F.col("line_id"))
    return lines.join(general, ["leaf", "line_id"], "left").select("doc_id", "text_hash", "pos", template.alias("template"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and with ``n_lines`` and ``n_dropped``."""
    since = stored_count()
    lines = stored(parsed(docs), "templates")
    # The texts of all lines are no longer needed.
    forget_stored(docs.sparkSession, since)
    recurring = lines.groupBy("template").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first"))
    # Stored, so that the join deals lines anew and adaptive execution can split those of a hot template.
    recurring = stored(recurring.filter(F.col("docs") >= MIN_DOCS).select("template", "first"), "recurring")
    later = lines.join(recurring, "template").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    dropped = later.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).agg(
        F.collect_set("pos").alias("_dropped")
    )
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(dropped, rows["doc_id"].eqNullSafe(dropped["_doc_id"]) & (rows["_hash"] == dropped["_text_hash"]), "left")
    all_lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "_dropped")
    # The lines are bound once; within the inner function they'd be split anew for each line.
    left = F.transform(F.array(all_lines), lambda lines: F.transform(kept, lambda i: F.get(lines, i)))
    text = F.array_join(F.get(left, F.lit(0)), "\n")
    return rows.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long"),
            "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"),
            "text": F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(text),
        }
    ).drop("_hash", "_doc_id", "_text_hash", "_dropped")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row of ``docs``, ``text`` without the dropped lines."""
    return drop_recurring(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def without_recurring(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars counted anew; rows go that had lines and lost all of them."""
    columns = docs.columns
    made = drop_recurring(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")))
    left = made.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[now.get(c, F.col("_row")[c]).alias(c) for c in columns])


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, hash(text) AS text_hash, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), plain AS (
  SELECT doc_id, text_hash, pos, trim(regexp_replace(translate(regexp_replace(line, '({SIGN})', ' \\1 ', 'g'), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' {{2,}}', ' ', 'g'), ' ') AS line
  FROM lines
), tokenised AS (
  SELECT doc_id, text_hash, pos, CASE WHEN line = '' THEN [] WHEN regexp_matches(variable, '{ONLY_VARIABLE}') THEN string_split(line, ' ')
    ELSE string_split(variable, ' ') END AS tokens
  FROM (SELECT *, regexp_replace(line, '[^ ]*[0-9][^ ]*', '{VARIABLE}', 'g') AS variable FROM plain)
), parsed AS (
  SELECT *, len(tokens) AS n, tokens[1:{DEPTH}] AS path FROM tokenised WHERE len(tokens) >= {MIN_TOKENS}
), distinct_lines AS (
  SELECT DISTINCT n, path, tokens FROM parsed
), mixed AS (
  SELECT n, path FROM distinct_lines GROUP BY n, path HAVING count(*) > 1
), cells AS (
  SELECT n, path, place, token, count(*) AS c
  FROM (SELECT n, path, unnest(range(n)) AS place, unnest(tokens) AS token FROM distinct_lines JOIN mixed USING (n, path))
  GROUP BY n, path, place, token
), common AS (
  SELECT n, path, place, token FROM cells
  QUALIFY row_number() OVER (PARTITION BY n, path, place ORDER BY c DESC, token DESC) = 1
), general AS (
  SELECT n, path, list(token ORDER BY place) AS template FROM common GROUP BY n, path
), templated AS (
  SELECT doc_id, text_hash, pos, CASE WHEN template IS NOT NULL AND
      list_sum(list_transform(range(1, p.n + 1), lambda i: (tokens[i] = template[i])::INT)) / p.n::DOUBLE >= {SIMILARITY}
    THEN {{'n': p.n, 'tokens': p.path, 'general': true}} ELSE {{'n': p.n, 'tokens': tokens, 'general': false}} END AS template
  FROM parsed p LEFT JOIN general g ON p.n = g.n AND p.path = g.path
), recurring AS (
  SELECT template, min(doc_id) AS first FROM templated GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), dropped AS (
  SELECT DISTINCT doc_id, text_hash, pos FROM templated JOIN recurring USING (template) WHERE doc_id IS DISTINCT FROM first
), rebuilt AS (
  SELECT l.doc_id, l.text_hash, count(d.pos) AS n_dropped,
    string_agg(CASE WHEN d.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text
  FROM (SELECT DISTINCT * FROM lines) l
  LEFT JOIN dropped d ON l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.text_hash = d.text_hash AND l.pos = d.pos
  GROUP BY l.doc_id, l.text_hash
)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN 0 ELSE len(string_split(o.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(r.n_dropped, 0)::BIGINT AS n_dropped,
  CASE WHEN o.text IS NOT NULL THEN coalesce(r.text, '') END AS text
FROM documents o LEFT JOIN rebuilt r ON o.doc_id IS NOT DISTINCT FROM r.doc_id AND hash(o.text) = r.text_hash
"""
