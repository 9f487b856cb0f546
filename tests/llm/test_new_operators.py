"""Quality rules, ranked search and spelling variants against plain Python, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import lexical, queries, repetition, spelling
from plantpulse.llm.common import table

SCHEMA = "doc_id long, text string, lang string, score long, k long, n long, rank string"
TEXT = "One two three four five six seven eight."
ODD = [
    (1, None, "en", 1, 1, 1, "x"),
    (2, "", "en", None, 2, 2, None),
    (3, TEXT * 9, None, 3, 3, 3, "x"),
    (3, TEXT * 9, None, 3, 3, 3, "x"),
    (None, TEXT * 9, "en", 1, None, 1, "x"),
    (5, "word wordy " * 30_000, "en", 1, 5, 1, "x"),
    (6, " \n\t \x0b", "en", 1, 6, 1, "x"),
    (7, "Straße élan élans ÉLAN 日本語 𝒳 text\nStraße élan\nStraße élan\n\n", "de", 1, 7, 1, "x"),
    (9007199254740993, "wordy# %% two three", "de", 1, 7, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return table(spark, tiny, "documents")


def rows_of(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


# --- Quality rules ---

SPACE = " \t\n\x0b\x0c\r"


def plain_measures(text: str) -> dict:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    lines = (text or "").split("\n")
    again = ["".join(c for c in line if c not in SPACE) for i, line in enumerate(lines) if line in lines[:i]] if len(lines) < 3000 else []
    out |= {"n_dup_lines": sum(map(bool, again)), "dup_line_chars": sum(map(len, again))}
    for n in (3, *repetition.LIMITS):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, seen, hit = Counter(windows), set(), set()
        for i, w in enumerate(windows):
            if w in seen if n > 3 else times[w] > 1:
                hit.update(range(i, i + n))
            seen.add(w)
        if n == 3:
            out["n_repeat_words"] = len(hit)
        else:
            out[f"repeat_chars_{n}"] = sum(len(words[i]) for i in hit)
    return out


def test_measures_of_random_texts():
    words, rng = repetition.Words(), random.Random(7)
    for _ in range(300):
        size, letters = rng.choice([0, 1, 2, 3, 9, 40, 200]), rng.choice(["ab", "abcé", "abc日𝒳#"])
        text = "".join(rng.choice(["a b ", "\n", "\t", " "]) if rng.random() < 0.3 else rng.choice(letters) for _ in range(size))
        text += rng.choice(["", text, "\n" + text])
        assert repetition.measures(text, words) == plain_measures(text)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(repetition, "_B", np.uint64(0))  # every window has the same hash
    words = repetition.Words()
    for text in ("a b c d e f g h", "a b c a b c a b c d a b c x", "q w e r t y " * 6):
        assert repetition.measures(text, words) == plain_measures(text)


def test_quality_rules_on_tables(docs, odd, empty):
    for given in (docs, odd):
        texts = [(r["doc_id"], r["text"]) for r in given.select("doc_id", "text").collect()]
        expected = Counter()
        for k, t in texts:
            m = plain_measures(t)
            failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
            over = any(100 * m[f"repeat_chars_{n}"] > p * m["word_chars"] for n, p in repetition.LIMITS.items())
            over |= 100 * m["dup_line_chars"] > 20 * m["word_chars"] or 100 * m["n_symbols"] > 10 * m["n_words"]
            expected[tuple(sorted((m | {"doc_id": k, "base_failed": failed, "kept": not failed and not over}).items()))] += 1
        assert rows_of(repetition.judge_repetition(given)) == expected
    assert repetition.judge_repetition(empty).count() == 0
    assert rows_of(repetition.judge_repetition(odd.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))).total() == len(ODD)


# --- Ranked search ---


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, top=20):
    """docs: (key, text) rows; items: (id, text)."""
    of = [(k, Counter(plain_terms(t))) for k, t in docs]
    N, L = sum(1 for _, c in of if c), sum(c.total() for _, c in of)
    df = Counter(t for _, c in of for t in c)
    asked = defaultdict(Counter)
    for i, t in dict.fromkeys(items):
        asked[i].update(plain_terms(t))
    out = Counter()
    for i, q in asked.items():
        scored = []
        for k, c in of:
            m = 75 + (25 * c.total() * N) // L if L else 0
            s = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in q.items() if c[t])
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        for rank, (s, _, _, k) in enumerate(sorted(scored)[:top], 1):
            out[tuple(sorted({"item_id": i, "rank": rank, "doc_id": k, "score": -s}.items()))] += 1
    return out


ITEMS = [(1, "one two THREE wordy wordy"), (1, "one two THREE wordy wordy"), (1, "text"), (2, "élan straße 日本語"), (3, None), (4, ""), (None, "eight"), (5, "absent")]


def test_ranked_search_on_tables(spark, tiny, docs, odd, empty):
    benchmark = table(spark, tiny, "benchmark")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(lexical.rank_documents(docs, benchmark)) == plain_ranking(given, items)
    asked = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, term string")
    given = [r[:2] for r in ODD]
    for top in (1, 3, 20):
        assert rows_of(lexical.rank_documents(odd, asked, top)) == plain_ranking(given, ITEMS, top)
    assert lexical.rank_documents(empty, asked).count() == 0
    assert lexical.rank_documents(odd, asked.limit(0)).count() == 0
    assert lexical.rank_documents(odd, asked.where("item_id >= 3")).columns == ["item_id", "rank", "doc_id", "score"]


def test_items_in_several_blocks(spark, docs, tiny, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    some = table(spark, tiny, "benchmark").limit(6)
    items = [(r["item_id"], r["text"]) for r in some.collect()]
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(lexical.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"))) == plain_ranking(given, items)


def test_first_scores_to_beat_lose_nothing(spark, docs, tiny, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_DOCS", 20)
    benchmark = table(spark, tiny, "benchmark")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(lexical.rank_documents(docs, benchmark)) == plain_ranking(given, items)


@pytest.mark.parametrize("leaf, deepest", [(1, 64), (2, 3), (5, 1), (32, 64)])
def test_tree_finds_the_best(monkeypatch, leaf, deepest):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "DEEPEST", deepest)
    rng, width = random.Random(leaf), 12
    rows = []
    for _ in range(150):
        terms = sorted(rng.sample(range(width), rng.randint(1, 8)))
        rows.append((terms, [rng.randint(1, 4) for _ in terms], rng.randint(75, 130)))
    rows += rows[:60]  # equal documents
    rows += [(list(range(d)), [1] * d, 80) for d in range(1, width + 1)]  # each a beginning of the next
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    place = np.array(rng.sample(range(len(rows)), len(rows)))
    tree = lexical.DocumentTree(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), offsets, np.array([r[2] for r in rows]), place, width)
    asked = [sorted(rng.sample(range(width), 4)) for _ in range(10)]
    weights = [[rng.randint(0, 9) for _ in a] for a in asked]
    items = lexical.Items(np.arange(0, 41, 4), np.concatenate(asked), np.concatenate(weights))
    best = lexical.Best(np.zeros(10, np.int64), 7)
    found = defaultdict(list)
    for item, group, score in tree.search(items, best):
        found[item] += [(-score, place[i]) for i in tree.rows[tree.begin[group] : tree.begin[group + 1]]]
    for item in range(10):
        of = dict(zip(asked[item], weights[item]))
        all_scores = sorted((-sum(of.get(t, 0) * int(lexical.gain(f, m)) for t, f in zip(terms, tfs)), place[i]) for i, (terms, tfs, m) in enumerate(rows))
        assert sorted(found[item])[:7] == [r for r in all_scores if r[0] < 0][:7]


# --- Spelling variants ---


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def random_words(seed: int, count: int, low: int = 1, high: int = 9, letters: str = "abé") -> list[str]:
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(6))
def test_composition_accepts_each_near_pair_once(seed):
    words = random_words(seed, 150, seed % 2, 3 + seed)
    found = Counter(map(tuple, np.sort(spelling.Acceptor(words).near(), axis=1).tolist()))
    assert found == Counter((i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j]))


@pytest.mark.parametrize("limit", [1, 4, 50, 10_000])
def test_near_pairs_whatever_the_split(spark, limit):
    words = random_words(3, 260, 6, 9) + ["common" * 5 + w for w in random_words(4, 40, 1, 4)]
    given = spark.createDataFrame([(w, 7) for w in words], "word string, n long")
    pairs = Counter(tuple(r) for r in spelling.near_pairs(given, limit).collect())
    assert pairs == Counter((a, b) for a in words for b in words if a < b and near(a, b))


def plain_variants(rows, one_in):
    times = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            times[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    n = {w: c for w, c in times.items() if len(w) >= 6 and c >= 5}
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return Counter((w, form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize("limit, one_in", [(20_000, 199), (20, 5)])
def test_spelling_variants(spark, odd, empty, limit, one_in):
    rng = random.Random(5)
    words = random_words(9, 60, 6, 8, "abeé")
    rows = [(i, " ".join(rng.choices(words, [1 + 300 // (1 + j) for j in range(len(words))], k=200)).title()) for i in range(40)]
    rows += [r[:2] for r in ODD]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    found = spelling.group_variants(given, limit=limit, misspelt_one_in=one_in)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(tuple(r) for r in found.collect()) == plain_variants(rows, one_in)
    assert Counter(tuple(r) for r in spelling.group_variants(odd).collect()) == plain_variants([r[:2] for r in ODD], 199)
    assert spelling.group_variants(empty).count() == 0


def test_new_queries_have_sql():
    assert {"op11_quality_rules", "op12_ranked_search", "op13_spelling_variants"} <= queries.QUERIES.keys() & queries.SQL.keys()
