"""The alignment, the collocations and the n-gram join against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from ledgerloom.llm import collocations, crosstoken, graph, jaccard

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
DOCS = "doc_id long, text string, lang string"
ODD = ["", None, " ", "  a  b ", "a \n b", "▁x", "x▁ y", "<|endoftext|> hi <s> <unk>", "a\x1c b", "漢字 かな　x", "é ​ z \xa0 q",
       "\x00\x01 \x7f", "don't  stop 's", "x\n\n y  \t z ", "word " * 4000, "word " * 4000]


# Alignment -----------------------------------------------------------------------------


def aligned_brute(own, text):
    """Ids of both, ends of their tokens, and the groups' text, from the libraries' whole encodings."""
    if not text:
        return None
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    spelt = [[table[i] for i in ids] for table, ids in ((own.bytes_a, a), (own.bytes_b, b))]
    if any(b"".join(x) != b" " + text.encode() for x in spelt):
        return None
    ends = [list(itertools.accumulate(map(len, x))) for x in spelt]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = []
    for low, high in zip([0, *cuts], cuts, strict=False):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, end, strict=True) if low < e <= high) for ids, end in zip((a, b), ends, strict=True)))
    links = []
    for i, (x, end_a) in enumerate(zip(a, ends[0], strict=True)):
        start_a = ends[0][i - 1] if i else 0
        for j, (y, end_b) in enumerate(zip(b, ends[1], strict=True)):
            start_b = ends[1][j - 1] if j else 0
            if start_a < end_b and start_b < end_a:
                links.append((x, y))
    return len(a), len(b), ";".join(groups), len(cuts), links


@pytest.fixture(scope="module")
def own():
    return crosstoken.Pairing(*PATHS)


def test_alignment(spark, own, sf_dir):
    some = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if len(r.text) < 1500][:60]
    texts = [t for t in ODD if not t or len(t) < 5000] + some + some[:5]
    rows = [(None if k == 3 else k // 2, t, None) for k, t in enumerate(texts)]
    brute = [aligned_brute(own, t) for t in texts]
    docs_of = Counter(pair for made in brute if made for pair in set(made[4]))
    top = defaultdict(int)
    for (a, _), n in docs_of.items():
        top[a] = max(top[a], n)
    wanted = []
    for (doc_id, _, _), made in zip(rows, brute, strict=True):
        if made is None:
            wanted.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, n_groups, links = made
        best = sum(docs_of[p] == top[p[0]] for p in links)
        wanted.append((doc_id, n_a, n_b, n_groups, len(links), best, sum(docs_of[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [tuple(r) for r in crosstoken.report(frame, *PATHS).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    made = crosstoken.alignment(frame, *PATHS, keep_groups=True)
    links_of = Counter(pair for own_ in brute if own_ for pair in own_[4])
    assert {(r.a, r.b): (r.docs, r.links) for r in made.pairs.collect()} == {p: (docs_of[p], n) for p, n in links_of.items()}
    assert sorted(r.groups for r in made.docs.collect()) == sorted(own_[2] if own_ else "" for own_ in brute)


def test_chunks_change_nothing(spark, monkeypatch):
    rows = [(k, f"some words {k % 7} and {'more ' * (k % 5)}of them", None) for k in range(90)]
    frame = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, crosstoken.report(frame.coalesce(1), *PATHS).collect()))
    assert sorted(map(tuple, crosstoken.report(frame.repartition(7), *PATHS).collect())) == whole
    assert crosstoken.report(frame.limit(0), *PATHS).count() == 0


def test_bitmaps():
    random.seed(1)
    for size in (0, 1, 90, 127, 128, 129, 2048):
        slots = np.array(sorted(random.sample(range(crosstoken.CHUNK_DOCS), size)), np.int64)
        bitmap = crosstoken.packed(slots)
        assert crosstoken.unpacked(bitmap).tolist() == slots.tolist() and crosstoken.popcount(bitmap) == size
        other = np.array(sorted(random.sample(range(crosstoken.CHUNK_DOCS), 50)), np.int64)
        both = crosstoken.merged([bitmap, crosstoken.packed(other)])
        assert crosstoken.unpacked(both).tolist() == sorted({*slots.tolist(), *other.tolist()})


def test_ascii_units_have_the_ids_of_the_library(own):
    random.seed(3)
    signs = "".join(map(chr, range(128))) + "ab '\n\t1.sdmtlvre<|endoftext|>" * 4
    for _ in range(5000):
        text = " " + "".join(random.choices(signs, k=random.randint(1, 14)))
        assert own.quick(text) == own.a.encode(text, add_special_tokens=False).ids


# Collocations --------------------------------------------------------------------------


def phrases_brute(rows):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts


def collocations_brute(rows, least, reported):
    made = []
    for lang, counts in phrases_brute(rows).items():
        frequent = {p: n for p, n in counts.items() if n >= least and len(p) > 1}
        found = []
        for p, a in frequent.items():
            inside = [n for q, n in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= 80 * a for n in inside):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        n = sum(v for p, v in counts.items() if len(p) == 1)
        made += [(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:reported])]
    return sorted(made)


def corpus(seed, docs=300):
    random.seed(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "ÀB", "漢字", "\x00z", "x\x1fy"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(k, "".join(w + random.choice([" ", " ", "\t", ", ", ".", "\n"]) for w in random.choices(words, weights, k=random.randint(0, 30))), random.choice(["en", "en", None, "und"])) for k in range(docs)]
    # Phrases of rare words, all in documents of a few: the sample misses some of them.
    rows += [(1000 + k, "rare one two three four five " * 6, "en") for k in range(3)] + [(2000 + k, f"only{k} here{k} now{k} " * 12, "de") for k in range(12)]
    return [*rows, (None, None, None), (1, "", "fr"), (1, "ONE two", "fr"), *rows[:20]]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    got = collocations.collocations(frame, reported=50, least=8)
    assert sorted(map(tuple, got.collect())) == collocations_brute(rows, 8, 50)


def test_frequent_phrases_don_t_depend_on_slices_or_the_sample(spark, monkeypatch):
    rows = corpus(3, 120)
    frame = spark.createDataFrame(rows, DOCS).repartition(2)
    wanted = {(lang, p): n for lang, counts in phrases_brute(rows).items() for p, n in counts.items() if n >= 8}
    assert {(r.lang, tuple(r.said)): r.n for r in collocations.frequent_phrases(frame, 8).filter("words > 0").collect()} == wanted
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_slices_cut_long_texts_at_ends_of_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 20)
    text = b"one two three. four five six seven eight nine ten, eleven\ntwelve"
    blocks = list(collocations._blocks(text))
    assert b"".join(blocks) == text and len(blocks) > 1 and all(b[-1:] in collocations.ENDS for b in map(bytes, blocks[:-1]))


# N-gram join ---------------------------------------------------------------------------


def jaccard_brute(rows):
    sets = []
    for _, text, _ in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
        sets.append({b" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or ({b" ".join(words)} if words else set()))
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 90 * len(sets[i] | sets[j]):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(((d, len(s), least.get(g)) for (d, _, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def near_copies(seed):
    random.seed(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = random.choices(words, k=random.choice([9, 12, 14, 30, 60, 150, 400]))
        for _ in range(15):
            own = list(base)
            for _ in range(random.randint(0, len(base) // 25 + 1)):
                at = random.randrange(len(own))
                own[at : at + random.randint(0, 2)] = random.choices(words, k=random.randint(0, 2))
            rows.append((len(rows) // 2 * 3, " ".join(own).upper(), None))
    random.shuffle(rows)
    return [*rows, *rows[:10], (None, rows[0][1], None), (None, "not like others at all", None), (7, None, None), (8, "", None), (9, " \n\t", None),
            (10, "two words", None), (11, "TWO\twords", None), (12, "é É", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = near_copies(seed)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == jaccard_brute(rows)


def test_crowds_are_joined_by_further_leaders(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEETINGS", 0)
    rows = near_copies(3)
    assert sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str) == jaccard_brute(rows)
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_sets_that_reach_the_similarity_share_a_key():
    random = np.random.default_rng(1)
    for size in (9, 10, 11, 13, 20, 40, 100, 300, 1000):
        for _ in range(60):
            a = random.integers(0, 1 << 63, size).astype(np.uint64)
            b = a[random.integers(0, size // 10 + 1) :]
            more = int(len(b) / 0.9 - size + 1e-9)
            b = np.concatenate([b, random.integers(0, 1 << 63, max(0, more)).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            assert len(np.intersect1d(a, b)) * 100 >= 90 * len(np.union1d(a, b))
            if len(a) != len(b) or (a != b).any():
                assert len(np.intersect1d(jaccard.join_keys(a), jaccard.join_keys(b)))
                apart = int(np.bitwise_count(jaccard.sketch(a, 8, 99) ^ jaccard.sketch(b, 8, 99)).sum())
                assert apart <= len(np.setxor1d(a, b))


def test_components_of_forests_of_several_tasks(spark, monkeypatch):
    random.seed(4)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(330)]
    frame = spark.createDataFrame(links, "a long, b long")
    root = list(range(400))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    linked = {n for a, b in links if a != b for n in (a, b)}
    for most in (1 << 17, 40):
        monkeypatch.setattr(graph, "LINKS", most)
        assert {r.node: r.root for r in graph.components(frame).collect()} == {n: root[n] for n in linked}


@pytest.mark.parametrize("module, call", [(collocations, collocations.collocations), (jaccard, jaccard.near_duplicates)])
def test_sql(spark, sf_dir, module, call):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = call(docs)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    wanted = duck.execute(f"SELECT {', '.join(made.columns)} FROM ({module.ORACLE})").fetchall()
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, wanted))
