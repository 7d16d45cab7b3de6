"""Operators against brute force, and their behaviour on awkward rows."""

import base64
import gzip
import hashlib
import random
import re
import subprocess
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe, chat, common, decontaminate, fingerprint, langid, linededup, pii, quality, queries, simhash, warc

RANKS = public_tokenizers.path(queries.RANKS)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id long"
LONG = "word " * 60_000
PROSE = "The river ran down to the old mill, and nobody had asked it to. It was late in the year."
ROWS = [
    (1, PROSE, "en"), (2, PROSE, "en"), (2, PROSE, "en"), (3, PROSE + " So it went.", None), (4, "", "en"), (5, None, None),
    (6, LONG, "de"), (7, "café \U0001f600 12 漢", "fr"), (None, "no id here at all", "en"), (8, "x", None), (9, "\x01\x02 \t\r\n\n", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", None, "f", 0) for i, t, lang in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = queries.queries()[name](spark, sf_dir)
    columns = ", ".join(sorted(result.columns))
    wanted = duck.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, result.select(*sorted(result.columns)).collect()))) == sorted(map(repr, wanted))


def test_every_operator_takes_an_empty_table(spark, none):
    empty_labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = [
        linededup.dedup_lines(none), linededup.without_recurring(none), simhash.near_duplicates(none), simhash.one_of_each(none),
        fingerprint.fingerprints(none), bpe.round_trip(none, RANKS, public_tokenizers.PATTERN), langid.identify(none),
        langid.only_identified(none), decontaminate.leaks(none, items), decontaminate.without_leaks(none, items),
        pii.report(none), pii.sanitise(none), quality.score(none, empty_labels), warc.archive_and_read(pages),
        chat.read_back(chat.format_conversations(turns)),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_line_dedup(spark):
    texts = ["Call 55 now for free\nown words one", "Call 7a now for free\nown words two", "Call 9 now for free\nmine alone here"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, None), (8, ""), (None, texts[0])]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got} == {
        (0, 2, 0, texts[0]), (1, 2, 1, "own words two"), (2, 2, 1, "mine alone here"), (7, 0, 0, None), (8, 1, 0, ""),
        (None, 2, 1, "own words one"),
    }


def test_general_templates_take_lines_that_differ_in_few_fields(spark):
    base = "the old ship sailed from {} port to the far end of the sea".format
    rows = [(k, base(town)) for k, town in enumerate(["Rome", "Oslo", "Cork", "Nice"])] + [(9, "the old ship was never seen in any port of the whole sea")]
    got = by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k]["n_dropped"] for k in (0, 1, 2, 3, 9)] == [0, 1, 1, 1, 0]


def test_line_dedup_keeps_columns_and_awkward_rows(docs):
    kept = linededup.without_recurring(docs)
    assert kept.columns == docs.columns
    assert by_id(kept)[4]["text"] == "" and by_id(kept)[5]["text"] is None


def simhash_brute(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(prints):
    root = {f: f for f in prints}
    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_simhash(spark, docs, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (real, docs.select("doc_id", "text")):
        rows = [(r.doc_id, simhash_brute(r.text)) for r in df.collect()]
        root = groups_brute({f for _, f in rows})
        first = {}
        for i, f in rows:
            if i is not None:
                first[root[f]] = min(first.get(root[f], i), i)
        wanted = sorted((repr(i), f"{f:016x}", first.get(root[f])) for i, f in rows)
        assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == wanted


def test_links_of_close_fingerprints(spark):
    random.seed(5)
    seeds = [random.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3))) for s in seeds for _ in range(25)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    made = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long")))
    got = {}
    for r in made.collect():
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    wanted = {}
    for f, root in groups_brute(prints).items():
        wanted.setdefault(root, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in wanted.values() if len(g) > 1)


def test_one_of_each_group_stays(docs):
    kept = [r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect()]
    root = groups_brute({simhash_brute(t) for i, t, _ in ROWS if i is not None})
    first = {}
    for i, t, _ in ROWS:
        if i is not None:
            group = root[simhash_brute(t)]
            first[group] = min(first.get(group, i), i)
    assert sorted(map(repr, kept)) == sorted(map(repr, [*first.values(), None]))
    assert 1 in kept and kept.count(2) == 0


def test_fingerprints_of_neighbours(docs):
    rows = [(i, t or "") for i, t, _ in ROWS]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    got = fingerprint.fingerprints(docs).collect()
    wanted = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        wanted.append((repr(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(wanted)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[2] != prints[3] and prints[4] == prints[5]


def test_span_hashes_across_blocks(monkeypatch):
    fingerprint._powers.cache_clear()
    monkeypatch.setattr(fingerprint, "BLOCK", 64)
    random.seed(1)
    text = "".join(random.choice("abé\U0001f600") for _ in range(500))
    own, other = fingerprint.Hashed(text), fingerprint.Hashed("zz" + text[100:300] + "q")
    assert fingerprint.common_extension(own, 100, other, 2) == 200
    assert own.span(150, 190) == other.span(52, 92) != own.span(151, 191)
    in_blocks = str(own.fingerprint)
    fingerprint._powers.cache_clear()
    monkeypatch.undo()
    assert str(fingerprint.Hashed(text).fingerprint) == in_blocks


def reference_tokens():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs):
    wanted = reference_tokens()
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    texts = sorted((repr(i), t or "") for i, t, _ in ROWS)
    got = sorted((repr(r.doc_id), r.ids, r.starts, r.ends) for r in encoded.collect())
    assert [(i, ids) for i, ids, _, _ in got] == [(i, wanted.encode_ordinary(t)) for i, t in texts]
    for (_, text), (_, ids, starts, ends) in zip(texts, got, strict=True):
        assert not ids or (starts[0], ends[-1]) == (0, len(text))
        assert all(s < e for s, e in zip(starts, ends, strict=True))
    decoded = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((repr(r.doc_id), r.text) for r in decoded) == texts


def test_bpe_of_odd_texts():
    own, wanted = bpe.codec(RANKS, public_tokenizers.PATTERN), reference_tokens()
    random.seed(2)
    signs = "aé漢\U0001f600 \n\t\r  　\x85\x1c​'sT0٣½<|endoftext|>̀﻿\x00"
    for _ in range(2000):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 14)))
        ids = next(own.encode([text])).tolist()
        assert ids == wanted.encode_ordinary(text) and own.decode(ids) == text


def test_warc_awkward_pages(spark):
    rows = [(1, "http://a/\r\nb", "x"), (2, None, "x"), (3, "u", None), (None, "u", "x"), (None, "u", "alone"), (2, None, "x"), (4, "u", "y" * 300_000)]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((repr(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted(
        [("1", 1, "revisit", 2), ("2", 1, "response", None), ("2", 1, "response", None), ("3", 0, "response", None),
         ("None", 1, "revisit", 2), ("None", 5, "response", None), ("4", 300_000, "response", None)]
    )


def test_warc_digests_are_verified():
    good = warc.record(1, "u", b"payload", 7, hashlib.sha1(b"payload").digest(), None)
    assert [x.payload_bytes for x in warc.read_records(iter([good[:9], good[9:] + b"\0" + good]))] == [7, 7]
    bad = warc.record(1, "u", b"payload", 7, hashlib.sha1(b"other").digest(), None)
    for broken in (bad, good[:-12]):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(iter([broken])))


def test_chat_escapes_and_spans():
    random.seed(3)
    for _ in range(500):
        turns = [chat.Turn("".join(random.choice("ab\\\n<|n") for _ in range(3)), "".join(random.choice("<|\\im_end>x\n") for _ in range(9))) for _ in range(3)]
        output, found, rewrites = chat.spans(chat.chat_ml, turns)
        assert chat.parse_chat_ml(output) == turns and not rewrites
        assert [chat.unescape(output[s.text_start : s.text_end]) for s in found] == [t.text for t in turns]


def test_a_template_that_rewrites_history_is_told():
    def only_last_system(turns):
        return "".join(f"[{t.role}]{t.text};" for k, t in enumerate(turns) if k >= len(turns) - 2)

    turns = [chat.Turn("user", t) for t in ("a1", "b2", "c3")]
    assert chat.spans(only_last_system, turns)[2] and not chat.spans(only_last_system, turns[:2])[2]


def test_decontamination_recall_and_precision(spark):
    random.seed(4)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    say = lambda n: random.choices(vocabulary, k=n)
    items = [(k, say(random.randint(8, 60))) for k in range(80)] + [(100, say(3)), (101, None)]
    rows, wanted = [], set()
    for k, words in items[:80]:
        changed = list(words)
        for _ in range(decontaminate.edits_allowed(len(words))):
            changed[random.randrange(len(changed))] = random.choice(vocabulary)
        rows.append((k, " ".join(say(200) + changed + say(200)).upper()))
        wanted.add((k, k))
    rows += [(500 + k, " ".join(say(400))) for k in range(40)] + [(900, None), (901, ""), (902, " ".join(items[100 - 20][1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w) if w else None) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got <= wanted and len(got) >= 0.95 * len(wanted)
    assert {r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()} == {i for i, _ in rows} - {d for d, _ in got}


def test_nearest_passage_is_exact():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    random.seed(6)
    for _ in range(60):
        a, b = [np.array(random.choices(range(1, 5), k=k), np.uint64) for k in (6, 14)]
        distance, start, end = decontaminate.nearest_passage(a, b)
        assert distance == min(brute(a, b[i:j]) for i in range(15) for j in range(i, 15)) == brute(a, b[start:end])


def test_language_id_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_awkward_rows(docs):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {4, 5, 9} and all(r.rejected and r.score == 0 for r in got if r.doc_id in und)
    assert langid.only_identified(docs).columns == docs.columns


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_language_blocks_change_nothing(monkeypatch, size):
    random.seed(size)
    made = ["".join(random.choices("ab C1 .é\n\U00010400漢", k=random.randrange(40))) for _ in range(500)]
    whole = [langid.grams(x).tolist() for x in made]
    monkeypatch.setattr(langid, "BLOCK_CHARS", size)
    assert [langid.grams(x).tolist() for x in made] == whole
    together = {}
    for owners, blocks in langid._pieces(made):
        for owner, block in zip(owners, blocks, strict=True):
            together.setdefault(owner, []).extend(block.tolist())
    assert together == {i: x for i, x in enumerate(whole) if x}


def test_kneser_ney_sums_to_one(spark):
    model = langid.train(spark.createDataFrame([("en", "abab abba baab abc"), ("de", "xyx")], "lang string, text string"))
    column = model.languages.index("en")
    seen = [ord(c) for c in " abc"]
    for history in ("aba", "  a", "zzz"):
        head = sum(ord(c) << 16 * (3 - k) for k, c in enumerate(history))
        # Of few characters, as some of many would share a hash with one that was seen.
        p = np.exp(-model.bits(np.array([head | c for c in range(512)], np.uint64))[:, column].astype(float))
        assert 0.5 < p[seen].sum() <= p.sum() < 1.001


def test_quality_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = [r for r in quality.score(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_quality_learns_interactions():
    random = np.random.default_rng(0)
    x = random.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0) ^ (x[:, 5] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (2, 5) in model.pairs and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert quality.fit(x[:0], y[:0]).score(x[:1])[0] == 0.5


PII = [
    "mail a.b@c.de, x_y@z.com_q@r.org. or 10.0.0.255 and 10.0.0.256, 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112; +44 (0)20 7946 0958, +1-2",
    "\x01a@b.c\x01 \U0001f600 a@b.c 000.001.2.3 12 34", "", None, "9" * 5000 + "@" + "a." * 3000,
]


def pii_brute(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    found = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            checks = (
                lambda: True, lambda: all(int(x) <= 255 for x in m[0].split(".")),
                lambda: 14 <= len(digits) <= 19 and luhn(digits), lambda: 10 <= len(digits) <= 15,
            )
            if checks[kind]():
                found.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_pii_base_spans(spark):
    rows = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = by_id(pii.report(rows))
    for i, text in enumerate(PII):
        assert got[i]["spans"] == pii_brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(pii_brute(text).encode()).hexdigest()


def test_pii_terms_that_reveal(spark):
    rows = [(k, "Ask Zorblax about it at z@corp.example today") for k in range(3)]
    rows += [(10 + k, "ask about it today and about the weather") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = by_id(pii.report(frame))
    assert "remove:4:11" in spans[0]["spans"] and spans[10]["spans"] == ""
    clean = by_id(pii.sanitise(frame))
    assert clean[0]["text"].startswith("Ask  about it ") and "[email]" in clean[0]["text"] and clean[10]["text"] == rows[3][1]


def test_pii_runs_no_python_on_executors(spark, docs):
    plan = pii.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
    texts = {r.doc_id: r.text for r in kept.collect()}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert 0.7 * docs.count() < len(got) < docs.count()
    prints = [simhash_brute(t) for t in texts.values()]
    assert len(set(groups_brute(set(prints)).values())) >= 0.99 * len(texts)


def test_one_of_each_keeps_groups_that_share_a_doc_id(spark):
    a, b = "the quick brown fox jumps over the lazy dog " * 5, "completely other words stand in this text here " * 5
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (2, b, "x"), (2, b, "w"), (3, "alone in the third one of them all", "v"), (3, "alone in the third one of them all", "u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _ in range(2):
        got = sorted((r.doc_id, r.text, r.source) for r in simhash.one_of_each(frame).collect())
        assert got == sorted([(1, a, "x"), (1, b, "x"), (3, "alone in the third one of them all", "u")])


def test_short_items_and_scripts_without_spaces_are_found(spark):
    items = [(1, "漢字仮名交じり文"), (2, "one two three four"), (3, "one two"), (4, "漢字仮名交じ")]
    index = decontaminate.index(items)
    assert [(h[0], h[1], h[3], h[4]) for h in index.find("これは漢字仮名交じり文です one two three four")] == [(1, 0, 3, 11), (2, 0, 14, 32), (4, 0, 3, 9)]
    assert [h[:2] for h in index.find("漢字仮字交じり文 one two three")] == [(1, 1), (4, 1)]
    assert [h[0] for h in decontaminate.index(items, 1).find("one two three")] == [3]


def test_leaks_are_those_of_every_passage(spark):
    random.seed(8)
    say = lambda n: random.choices("abcdefghijklmnopqrstuvwxyz", k=n)
    items = [(k, say(random.choice([4, 9, 12, 15]))) for k in range(12)]
    texts = []
    for k in range(60):
        own = list(items[k % 12][1])
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(own) + 1)
            own[at : at + random.randint(0, 1)] = say(random.randint(0, 1))
        texts.append(say(random.randint(0, 12)) + own + say(random.randint(0, 12)))

    def brute(item, words):
        return decontaminate.nearest_passage(np.array(list(map(ord, item))), np.array(list(map(ord, words))))[0]

    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(
        spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    wanted = {(d, i): n for d, t in enumerate(texts) for i, w in items if (n := brute(w, t)) <= decontaminate.edits_allowed(len(w))}
    assert set(got) <= set(wanted) and all(got[k] == wanted[k] for k in got)
    assert len(got) >= 0.97 * len(wanted) > 40


def test_lines_of_two_documents_short_ones_and_scripts_without_spaces_recur(spark):
    passage = "a passage of sixteen words that stands in exactly two of the documents and in no more"
    han = "漢字仮名交じり文"
    rows = [(1, f"{passage}\nown a\n12 34\nLes."), (2, f"own b\n{passage}\n{han}\n56 78"), (3, f"{han}\nLes.\nown c\n\n12 34"), (4, f" {han}\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame).collect()}
    assert got == {1: rows[0][1], 2: f"own b\n{han}\n56 78", 3: "own c\n", 4: ""}
    duck = duckdb.connect()
    duck.register("documents", frame.toArrow())
    assert {r[0]: r[1] for r in duck.execute(f"SELECT doc_id, text FROM ({linededup.ORACLE})").fetchall()} == got


def test_lines_are_parsed_once_and_their_texts_removed(spark, docs, monkeypatch):
    seen, since = [], common.stored_count()
    monkeypatch.setattr(linededup, "_lines", lambda docs, lines=linededup._lines: seen.append(docs) or lines(docs))
    assert linededup.dedup_lines(docs).count() == docs.count()
    assert len(seen) == 1
    left = [folder.rsplit("/", 1)[-1].rsplit("-", 1)[0] for folder in common._stored[since:]]
    assert left == ["templates", "recurring"]


def test_lines_of_plain_texts_are_masked_like_any_other(spark):
    plain = ["one line said here", " one line said here ", "the 1st of them", "x", "", " ", "é—“ok” ’tis", " 0 1 2", "end "]
    rows = [(k, "\n".join(plain[k:] + plain[:k])) for k in range(len(plain))]
    rows += [(100 + k, f"{line}\n{line}") for k, line in enumerate(plain)] + [(200 + k, f"{line}\n9 x\n漢\ta  b") for k, line in enumerate(plain)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.when(F.col("text").rlike(linededup.SIGN), F.regexp_replace("text", f"({linededup.SIGN})", " $1 ")).otherwise(F.col("text"))
    wanted = frame.select("doc_id", F.posexplode(F.transform(F.split(text, "\n"), linededup.masked)).alias("pos", "masked")).filter("masked != ''")
    wanted = wanted.withColumn("tokens", F.size(F.split("masked", " ")))
    got = linededup._lines(frame).select(*wanted.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    duck = duckdb.connect()
    duck.register("documents", frame.toArrow())
    assert dict(duck.execute(f"SELECT doc_id, text FROM ({linededup.ORACLE})").fetchall()) == {
        r.doc_id: r.text for r in linededup.dedup_lines(frame).collect()
    }


def test_names_that_clash_with_columns_of_the_operators(spark):
    names = ["_hash", "_dropped", "kinds", "_row", "leaf", "fp", "text_hash", "rows", "root", "held_out"]
    rows = [(1, "one line\nsaid here twice", *names), (2, "said here twice\nanother line of it", *names), (None, None, *names)]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    for made in (linededup.without_recurring(frame), simhash.one_of_each(frame), langid.only_identified(frame.withColumn("lang", F.lit("en")))):
        rows = made.collect()
        assert rows and all(r[n] == n for r in rows for n in names)


def test_archives_are_plain_gzip(spark, tmp_path, monkeypatch):
    rows = [(k, f"http://a/{k}", "x" * k) for k in range(40)] + [(50, "big", "y" * (17 << 20)), (51, "null", None), (-7, "u", "z")]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 20)
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), str(tmp_path / "warc"))
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) > 2
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    for f in files:
        assert subprocess.run(["gzip", "-t"], input=f.read_bytes(), capture_output=True).stderr == b""
    got = {r.page_id: r.payload_bytes for r in warc.read(spark, str(tmp_path / "warc")).collect()}
    assert got == {i: len(t or "") for i, _, t in rows}


def test_records_of_other_writers():
    def member(head, block):
        return gzip.compress(f"WARC/1.0\r\n{head}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    info = member("warc-type: warcinfo\r\nWARC-RECORD-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields", b"software: x\r\n")
    plain = member("WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http;msgtype=response", b"HTTP/1.1 200 OK\r\nserver: s\r\n\r\nbody")
    asked = member("WARC-Type: request\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: application/http", b"GET / HTTP/1.1\r\n\r\n")
    got = list(warc.read_records(iter([info + plain, asked])))
    assert [(x.headers["warc-type"], x.payload_bytes) for x in got] == [("warcinfo", 13), ("response", 4), ("request", 0)]
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    bad = [b"no gzip at all", gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"), member("WARC-Type: response\r\nnonsense", b""), plain[:-9], gzip.compress(b"WARC/1.0\r\nWARC-Type: x"),
           member("WARC-Type: response\r\nWARC-Record-ID: 1", b"HTTP/1.1 200\r\nContent-Length: many\r\n\r\n"), gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\nWARC-Record-ID: 1\r\nContent-Length: -3\r\n\r\n")]
    for broken in bad:
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(iter([broken])))


def test_chat_takes_time_in_proportion_to_turns():
    def took(n):
        turns = [chat.Turn("user", f"<|im_end|> {k} " + "some text " * 20) for k in range(n)]
        start = time.process_time()
        output, found, rewrites = chat.spans(chat.chat_ml, turns)
        assert len(found) == n and not rewrites and output[found[-1].text_start :].startswith(chat.escape(turns[-1].text))
        return time.process_time() - start

    took(2000)
    assert took(8000) < 10 * min(took(2000) for _ in range(3)) + 0.2


def test_appending_templates_have_the_spans_of_any_other():
    turns = [chat.Turn(r, t) for r, t in (("user", "a<|b"), ("assistant", ""), ("user", "x"), ("\n", "y\\"))]
    numbered = chat.Appending(lambda turn, k: f"{k}{turn.role}:{turn.text};")
    for template in (chat.chat_ml, numbered):
        assert chat.spans(template, turns) == chat.spans(lambda turns, own=template: own(turns), turns)
    liar = chat.Appending(lambda turn, k: turn.text + ";")
    liar_calls = type("Liar", (chat.Appending,), {"__call__": lambda self, turns: "".join(t.text + ";" for t in turns[-2:])})
    assert chat.spans(liar_calls(liar.piece), turns)[2]


@pytest.mark.parametrize("n", [1, 5, chat.BLOCK])
def test_every_prefix_of_an_appending_template_is_rendered(n):
    rendered = []

    class Noted(chat.Appending):
        def __call__(self, turns):
            rendered.append(list(turns))
            return super().__call__(turns)

    turns = [chat.Turn("assistant", f"<|text {k}") for k in range(n)]
    output = chat.spans(Noted(chat.chat_ml.piece), turns)[0]
    assert all(turns[:k] in rendered for k in range(1, n + 1)) and output == chat.chat_ml(turns)


def test_blocks_of_turns_have_the_spans_of_whole_prefixes():
    turns = [chat.Turn("user", f"a<|{k}") for k in range(2 * chat.BLOCK + 3)]
    numbered = chat.Appending(lambda turn, k: f"{k}{turn.role}:{turn.text};")
    for template in (chat.chat_ml, numbered):
        assert chat.spans(template, turns) == chat.spans(lambda turns, own=template: own(turns), turns)
    last = type("Last", (chat.Appending,), {"__call__": lambda self, turns: super(type(self), self).__call__(turns[-chat.BLOCK :])})
    assert chat.spans(last(numbered.piece), turns)[2]


def test_awkward_conversations(spark):
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, None, None, None), (1, 2, "user", "z"), (1, 2, "user", "z"), (1, 2, "assistant", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.read_back(chat.format_conversations(turns)).collect()
    assert sorted((repr(r.conv_id), r.n_turns, r.loss_chars) for r in made) == [("1", 4, 1), ("None", 1, 0), ("None", 1, 1)]
    said = "\n\nassistant\nc\nuser\nz\nuser\nz\n"
    assert hashlib.sha256(said.encode()).hexdigest() in {r.turns_sha256 for r in made}


@pytest.mark.parametrize("name", [7, None])
def test_crowded_doc_ids_are_spread(spark, name):
    random.seed(1)
    rows = [(k, "".join(random.choices("abc ", k=20))) for k in range(-40, 40)] + [(name, "".join(random.choices("abc ", k=30)) + str(k)) for k in range(720)]
    random.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        made = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        got = sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in made.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(sizes) >= 8 and max(sizes) <= 200
    # Those that share a doc_id are in order of the hashes that Spark gives their texts.
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    wanted = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        wanted.append((repr(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert got == sorted(wanted)


def test_likeness_is_that_of_the_spans():
    random.seed(2)
    for _ in range(60):
        a = "".join(random.choices("ab", k=random.choice([0, 5, 25, 70])))
        b = a if random.random() < 0.2 else a[: len(a) // 2] + "".join(random.choices("ab", k=random.choice([0, 10, 40])))
        spans = [{x[i : i + fingerprint.WIDTH] for i in range(max(1, len(x) - fingerprint.WIDTH + 1))} if x else set() for x in (a, b)]
        wanted = 1.0 if a == b else 2 * len(spans[0] & spans[1]) / max(1, len(spans[0]) + len(spans[1]))
        got = fingerprint.Hashed(a).fingerprint.likeness(fingerprint.Hashed(b).fingerprint)
        # Exact for texts of few spans.
        exact = len(spans[0] | spans[1]) <= fingerprint.SKETCH
        assert abs(got - wanted) < (1e-9 if exact else 0.3), (a, b, got, wanted)
