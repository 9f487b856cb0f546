"""The text operators against plain Python, on the smallest tables and on small frames with odd rows."""

import bisect
import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantpulse.llm import chat, decontamination, fingerprints, jaccard, licenses, matching, packing, quality, queries, token_counts, toxicity, urls
from plantpulse.llm.common import table

SCHEMA = "doc_id long, text string, lang string, node string, k long"
ODD = [
    (1, None, "en", "x", 1),
    (2, "", "en", None, 2),
    (3, "One two three four five six seven.", None, "x", 3),
    (3, "One two three four five six seven.", None, "x", 3),
    (None, "one two three four five six seven.", "en", "x", None),
    (5, "word " * 30_000, "en", "x", 5),
    (6, " \n\t ", "en", "x", 6),
    (7, "Straße é 日本語 𝒳 text", "de", "x", 7),
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


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# --- Token counts ---


def test_token_counts(spark, docs, texts, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.count_tokens(docs, path).collect():
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(model.encode(text)))
    got = Counter((r["doc_id"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, path).collect())
    assert got == Counter((k, len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for k, t, *_ in ODD)
    assert token_counts.count_tokens(empty, path).collect() == []


def test_token_units_with_spaces_marks_and_specials():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.Counter(path, {"a": 1}, token_counts.separable(path))
    given = ["", " ", "a", "a  b", " a", "a ", "a▁b c", "<s> </s> a", "x\ny z", "日本 語", "a b " * 50 + "end", "z" * 200 + " a"]
    assert counter.counts(given) == [len(model.encode(t)) for t in given]


# --- Packing ---


def _one_by_one(lengths, capacity):
    bins, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(bins, length)
        remaining = bins.pop(at) if at < len(bins) else capacity
        opened += remaining == capacity
        bisect.insort(bins, remaining - length)
    return opened, sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_equals_one_by_one(seed):
    chance = random.Random(seed)
    capacity = chance.choice([10, 64, 100, 1024])
    lengths = [chance.randint(1, capacity) for _ in range(chance.choice([1, 5, 50, 400]))]
    used, seen = Counter(), Counter()
    for p in packing.best_fit(Counter(lengths), capacity):
        for i in range(p.until - p.since):
            bin_, offset = p.bin + i // p.each, p.offset + i % p.each * p.length
            assert used[bin_] == offset
            used[bin_] += p.length
            seen[p.length] += 1
    assert seen == Counter(lengths)
    assert _one_by_one(lengths, capacity) == (len(used), sorted(capacity - n for n in used.values()))


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ["", "a", " a", "a ", "a  b", "a \n b", "x <|endoftext|> y", "\n\n a", "é à  b", " ", " \n", "don't I'll  go", "a　 b", "x\x1c y", *(t or "" for _, t, *_ in ODD)]:
        assert list(array("I", encoder.encode(text))) == tokenizer.encode(text, add_special_tokens=False).ids


def _check_packed(rows, texts, path):
    from tokenizers import Tokenizer

    tokenizer, places, of = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        of[r["doc_id"]].append(r)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(of) == set(texts)
    for k, own in of.items():
        ids, at = array("I", tokenizer.encode(texts[k], add_special_tokens=False).ids + [2]), 0
        for i, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at)
            assert i == 0 or r["length"] == 1024
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing(docs, texts, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    _check_packed(packing.pack_documents(docs, path).collect(), texts, path)
    assert packing.pack_documents(empty, path).collect() == []
    rows = packing.pack_documents(odd, path).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(k for k, *_ in ODD)
    assert [(r["length"], r["start"]) for r in rows if r["doc_id"] == 1] == [(1, 0)]


# --- Decontamination ---


def _brute_hits(texts, items):
    windows = defaultdict(set)
    for k, text in items:
        found = matching.words(text)
        size = min(10, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            windows[tuple(found[i : i + size])].add(str(k))
    out = {}
    for k, text in texts.items():
        found, hit, own = matching.words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(found) - size + 1):
                if tuple(found[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    own |= windows[tuple(found[i : i + size])]
        out[k] = (len(found), len(hit), sorted(own))
    return out


ITEMS = [(1, "The QUICK brown fox jumps over the lazy dog and runs away"), (2, "Short item"), (3, None), (4, ""), (10, "short ITEM"), (5, "...")]
DIRTY = {
    1: "x the quick, brown fox jumps over the lazy dog and-runs away. y",
    2: "a short item here and there with more words, SHORT; item",
    3: None,
    4: "clean text",
    5: "the quick brown fox jumps over the lazy dog and walks",
    6: "short item",
    7: "the quick brown fox jumps over the lazy short item dog and runs some more words to keep the text long enough",
}


def test_decontamination_against_brute_force(spark, tiny, docs, texts):
    bench = table(spark, tiny, "benchmark")
    expected = _brute_hits(texts, [(r["item_id"], r["text"]) for r in bench.collect()])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.report(docs, bench).collect()}
    assert got == expected


def test_decontamination_of_short_and_nested_items(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    given = spark.createDataFrame(list(DIRTY.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.report(given, bench).collect()}
    assert got == _brute_hits(DIRTY, ITEMS)
    assert decontamination.report(odd, bench).count() == len(ODD)
    assert decontamination.report(empty, bench).count() == 0
    assert decontamination.report(given, bench.limit(0)).where("contaminated").count() == 0


def test_removal_leaves_no_passage_and_clean_rows(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    given = spark.createDataFrame(list(DIRTY.items()), "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in decontamination.remove(given, bench).collect()}
    assert all(hit == 0 for _, hit, _ in _brute_hits(kept, ITEMS).values())
    assert kept[3] is None and kept[4] == "clean text" and 6 not in kept and 1 not in kept
    assert kept[2] == "a here and there with more words"
    left = decontamination.remove(odd, bench)
    assert left.columns == odd.columns and left.count() == len(ODD)


# --- N-gram join ---


def _shingles(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(matching.LOWER)) if w]
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def _brute_components(texts):
    sets = {k: _shingles(t) for k, t in texts.items()}
    parent, index = {k: k for k in sets}, defaultdict(list)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in sorted(sets):
        common = Counter(o for s in sets[k] for o in index[s])
        for s in sets[k]:
            index[s].append(k)
        for o, i in common.items():
            if 100 * i >= 80 * (len(sets[k]) + len(sets[o]) - i):
                a, b = sorted((find(k), find(o)))
                parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_components_against_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs).collect()}
    assert got == _brute_components(texts)


def test_components_of_near_copies_and_thresholds(spark):
    chance, made = random.Random(3), {}
    for group in range(6):
        base = [f"w{chance.randint(0, 5000)}" for _ in range(chance.choice([9, 24, 60, 200]))]
        for i in range(14):
            own = list(base)
            for _ in range(chance.randint(0, 3)):
                own[chance.randrange(len(own))] = f"v{chance.randint(0, 9)}"
            made[100 * group + i] = " ".join(own)
    common = " ".join(f"c{i}" for i in range(40))
    made |= {1000 + i: f"{common} " + " ".join(f"u{i}x{j}" for j in range(30 + i)) for i in range(12)}
    given = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(given).collect()}
    assert got == _brute_components(made)


def test_hot_blocks_are_dealt_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    chance, common, made = random.Random(7), " ".join(f"c{i}" for i in range(40)), {}
    for i in range(150):  # mostly shared text; every third is a near copy of the one before
        own = made[i - 1].split()[40:] if i % 3 == 2 else [f"u{i}x{j}" for j in range(chance.randint(15, 60))]
        made[i] = f"{common} {' '.join(own)}" + (" end" if i % 3 == 2 else "")
    given = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(given).collect()}
    assert got == _brute_components(made)
    sizes = [20 + 5 * (i % 30) for i in range(300)]
    rows = [(1 if i < 290 else 2, i, i, n, b"") for i, n in enumerate(sizes)]
    members = spark.createDataFrame(rows, "shingle long, node long, root long, n long, point binary")
    dealt = jaccard.dealt(members, spark.createDataFrame([(1,)], "shingle long"))
    assert dealt.where("shingle = 1").groupBy("task").count().agg(F.max("count")).first()[0] < 100 and dealt.where("shingle = 2").count() == 10
    want = {(i, j) for s in (range(290), range(290, 300)) for i, j in itertools.combinations(s, 2) if 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])}
    assert {tuple(r) for r in jaccard.tree_pairs(dealt).collect()} == want


def test_repeated_rows_are_one_node(spark, monkeypatch):
    seen, blocks = [], jaccard.blocks
    monkeypatch.setattr(jaccard, "blocks", lambda nodes: seen.append(nodes.groupBy("node").count().agg(F.max("count"), F.count("*")).first()) or blocks(nodes))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "q r s t u v"), (None, "q r s t u v"), (5, "k l m n o")]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert tuple(seen[0]) == (1, 3)
    assert sorted(map(str, ((r[0], r[2]) for r in got))) == sorted(map(str, [(1, 1), (1, 1), (2, 1), (None, None), (None, None), (5, 5)]))


def test_tree_search_finds_what_the_bound_allows():
    chance = np.random.default_rng(5)
    points = np.concatenate([chance.poisson(1, (150, jaccard.GROUPS)), np.repeat(chance.poisson(1, (3, jaccard.GROUPS)), 20, axis=0)]).astype(np.uint8)
    points[150:] += (chance.random((60, jaccard.GROUPS)) < 0.02).astype(np.uint8)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = jaccard.CountTree(points, sizes)
    for i in range(len(points)):
        most = np.minimum(points, points[i]).sum(axis=1, dtype=np.int64)
        near = (most >= jaccard.needed_overlap(sizes[i], sizes)) & (100 * np.minimum(sizes, sizes[i]) >= 80 * np.maximum(sizes, sizes[i]))
        assert sorted(tree.search(points[i], int(sizes[i]))) == np.flatnonzero(near).tolist()


def test_components_of_odd_rows(odd, empty):
    rows = jaccard.join_components(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == 1 and by[2] == 2 and by[6] == 6 and by[3] == 3 and by[None] == 3
    assert jaccard.join_components(empty).collect() == []
    assert jaccard.keep_one(odd).columns == odd.columns


# --- Licences ---


def test_license_phrases_and_expressions(docs, texts, odd):
    def brute(text):
        found = matching.words(text)
        places = [i for p in licenses.BASE_PHRASES for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
        return len(found), len(places), min(places, default=None), max(places, default=None)

    extra = "under the MIT license: cc-by-nc by NC cc by nc; Apache License, Version 2"
    scanner = licenses.Scanner()
    got = scanner.scan(extra)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == brute(extra)
    assert got["base_labels"] == "apache-2,cc-by-nc,mit" and set(got["base_labels"].split(",")) <= set(got["labels"].split(","))
    for r in licenses.scan_licenses(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == brute(texts[r["doc_id"]])
    assert licenses.scan_licenses(odd).count() == len(ODD)


def test_shunting_yard():
    parse = lambda s: licenses.postfix(licenses.tokens(s))
    assert parse("MIT OR Apache-2.0 AND (GPL-2.0-only WITH Classpath-exception-2.0)") == ["mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or"]
    assert licenses.evaluate(parse("(MIT OR ISC) AND BSD-3-Clause")) == {frozenset({"mit", "bsd-3-clause"}), frozenset({"isc", "bsd-3-clause"})}
    for bad in ("", "AND MIT", "MIT OR", "(MIT", "MIT)", "MIT ISC", "()"):
        with pytest.raises(licenses.BadExpression):
            parse(bad)
    got = licenses.Scanner().scan("// SPDX-License-Identifier: (MIT OR Apache-2.0 WITH LLVM-exception) and more prose")
    assert got["labels"] == "apache-2,mit" and got["expressions"] == ["apache-2.0 with llvm-exception or mit"]


# --- Fingerprints ---


def test_fingerprints_and_neighbours(docs, texts, empty):
    keys = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    assert set(got) == set(texts)
    for i, k in enumerate(keys):
        text, following = texts[k], texts[keys[(i + 1) % len(keys)]]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.fingerprint(text), fingerprints.fingerprint(changed))
        assert r["near_next"] == fingerprints.containment(r["fingerprint"], fingerprints.fingerprint(following))
    assert fingerprints.compare_with_next(empty).collect() == []


def test_chunks_shift_with_the_text():
    chance = random.Random(1)
    text = "".join(chance.choice("abcdefgh ij") for _ in range(20_000))
    own = fingerprints.fingerprint(text)
    assert fingerprints.containment(own, fingerprints.fingerprint("new words in front " + text)) > 0.98
    assert fingerprints.containment(own, fingerprints.fingerprint(text[:9000] + text[9100:])) > 0.97
    raw = np.frombuffer(text.encode(), np.uint8)
    sizes = np.diff([0, *fingerprints.chunk_ends(raw)])
    assert sizes.sum() == len(raw) and sizes[:-1].min() >= fingerprints.LEAST and sizes.max() <= fingerprints.MOST
    plain = 0
    for b in raw[:100]:
        plain = ((plain << 1) + int(fingerprints._GEAR[b])) & 0xFFFFFFFF
    assert fingerprints.gear(raw[:100])[-1] == plain
    assert fingerprints.fingerprint("") == "" and fingerprints.containment("", "") == 1.0 and fingerprints.containment("", own) == 0.0


# --- Toxicity and quality ---


def test_folding_and_exceptions():
    assert toxicity.fold("You 1D10T, ѕtuріd!") == " you idiot stupid "
    own = toxicity.Matcher(toxicity.Lexicon({" trash ": 5.0, " stup": 4.0}, 3.0, -4.0))
    assert own.score("what trash you are") > 0.5 > own.score("put it in the trash can please")
    assert own.score("so stup1d") > 0.5 > own.score("") == own.score(None)


def test_learned_scores_hold_out(spark):
    chance, rows, labels = random.Random(2), [], []
    calm = [f"calm{i}" for i in range(300)]
    for k in range(1200):
        toxic = k % 4 == 0
        found = [chance.choice(calm) for _ in range(chance.randint(20, 80))] + (["vilest", "grubby" + chance.choice("abc")] if toxic else [])
        chance.shuffle(found)
        rows.append((k, " ".join(found) if k % 97 else None))
        labels.append((k, 0 if k % 3 else 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, given)
    scored = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score_column(docs, lexicon).alias("s")).collect()}
    wrong = sum((scored[k] >= 0.5) != bool(t) for (k, _, t), (_, text) in zip(labels, rows) if text)
    assert wrong <= 12
    assert toxicity.fit(docs.limit(0), given).entries == {}


def test_ordinal_model(spark, tiny, odd):
    chance, rows, grades = random.Random(4), [], []
    for k in range(900):
        grade = k % 3
        rows.append((k, " ".join(chance.choice(["good", "fine", "nice"]) if chance.random() < grade / 2 else chance.choice(["zzz%%", "qq##"]) for _ in range(40))))
        grades.append((k, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(grades, "doc_id long, grade int"))
    assert np.all(np.diff(model.thresholds) > 0)
    means = defaultdict(list)
    for r in quality.judged(docs, model).collect():
        means[r["doc_id"] % 3].append(r["quality"]["expected"])
        assert r["quality"]["tails"][0] >= r["quality"]["tails"][1]
    assert np.mean(means[0]) + 0.4 < np.mean(means[1]) < np.mean(means[2]) - 0.4
    judged = quality.judged(odd, model)
    assert judged.count() == len(ODD) and judged.columns == [*odd.columns, "quality"]
    assert quality.fit(docs.limit(0), spark.createDataFrame(grades, "doc_id long, grade int")) is None
    assert quality.judged(odd, None).where("quality is not null").count() == 0


def test_ordinal_gradient():
    chance = np.random.default_rng(1)
    rows = [(np.array([0, 2]), chance.random(2), g) for g in (0, 1, 2, 3, 1)]
    theta, weight_of = chance.normal(size=4 + 3) * 0.3, np.array([1.0, 2.0, 0.5, 1.5])
    found = quality.loss_and_gradient(theta, 4, rows, weight_of)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up, low = (quality.loss_and_gradient(theta + s * step, 4, rows, weight_of)[0] for s in (1, -1))
        assert found[1 + i] == pytest.approx((up - low) / 2e-6, abs=1e-4)


# --- URLs ---


def _brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(matching.LOWER)
    fits = [r for r in urls.PATH_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_path_rules(spark):
    given = ["http://WWW.Example.com/en/x?q=/es/", "https://a.example.com/en", "https://example.com", "http://notexample.com/en/", "ftp://x.net/es/?a", "x.net/fr/", None, "", "a://b.net/fr/#/x", "://com/", "http://example.com?x/en/"]
    frame = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    rules = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, pages long")
    for r in urls.judge(frame, rules).collect():
        host, path, rule, verdict = _brute_url(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_mined_rules(spark):
    rows = [(i, f"http://{'bad-site' if i % 5 == 0 else 'site'}{i % 7}.example.org/{'buy' if i % 5 == 0 or i % 3 == 0 else 'read'}/{i}", i % 5 == 0) for i in range(600)]
    pages = spark.createDataFrame([*rows, (600, None, True), (601, "http://x.org/", None)], "page_id long, url string, blocked boolean")
    rules = urls.mine(pages)
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules).collect()}
    assert all((verdicts[i] == "block") == b for i, _, b in rows) and verdicts[600] == "allow"
    items = {r["page_id"]: set(r["t"]) for r in pages.where("url is not null").select("page_id", urls.tokens_of(pages["url"]).alias("t")).collect()}
    for r in rules.collect():
        fit = [k for k, t in items.items() if k < 600 and set(r["tokens"]) <= t]
        assert r["pages"] == len(fit) and r["confidence"] == pytest.approx(sum(k % 5 == 0 for k in fit) / len(fit))
    assert urls.mine(pages.limit(0)).count() == 0


def test_every_copy_of_a_url_is_mined(spark):
    rows = [(f"http://bad{i % 3}.example.org/{i}", True) for i in range(60)] + [(f"http://good.example.org/{i}", False) for i in range(60)]
    one = [("http://often.example.org/buy", True)]
    pages = spark.createDataFrame(rows, "url string, blocked boolean").unionByName(spark.range(210_000).select(F.lit(one[0][0]).alias("url"), F.lit(True).alias("blocked")))
    found = {tuple(r["tokens"]): r["pages"] for r in urls.mine(pages, support=0.00005).collect()}
    assert found[("host=often",)] == 210_000 and all(found[(f"host=bad{i}",)] == 20 for i in range(3))


def test_long_rules_and_pruning(spark):
    words = ["red", "blue", "tall", "thin", "soft"]
    sets = [c for r in range(3, 6) for c in itertools.combinations(words, r)]
    # Only all five words together are blocked: every smaller set fits many other pages.
    rows = [(f"http://a.org/{'/'.join(c)}", len(c) == 5) for c in sets for _ in range(12)]
    found = urls.mine(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert {frozenset(r["tokens"]) for r in found} == {frozenset(f"path={w}" for w in words)}


def test_supersets_do_not_crowd_out_rules(spark):
    # Each of 4 sites gives over 3,000 sets of at most 4 tokens, all of confidence 1; the last rule is less sure than they are.
    rows = [(f"http://bad{i}.example.org/{'/'.join(f'{site}{chr(97 + j)}' for j in range(10))}", True) for i, site in enumerate("qrst") for _ in range(12)]
    rows += [("http://mixed.example.org/", k < 8) for k in range(12)]
    pages = spark.createDataFrame(rows, "url string, blocked boolean")
    found = {tuple(r["tokens"]): r["confidence"] for r in urls.mine(pages).collect()}
    assert found[("host=mixed",)] == pytest.approx(8 / 12) and found[("host=bad0",)] == 1.0


def test_page_labels_come_from_the_pages(spark, tmp_path):
    shown = lambda html: spark.createDataFrame([(html,)], "html string").select(urls.shows_spam(F.col("html"))).first()[0]
    assert shown("<p>Best CASINO</p>") and shown("<p>" + "buy!!! now### " * 9 + "</p>") and shown("<b>again and</b> " * 30)
    assert not shown("<script>casino</script><!-- casino --><p class='casino'>one two three</p>") and not shown("") and shown(None) is None
    rows = [(i, f"http://{'big-win' if i % 10 == 0 else f'site{i % 7}'}.example.org/de/{i}", "<p>" + ("win at the casino" if i % 10 == 0 else f"plain text {i}") + "</p>") for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    verdicts = {r["page_id"]: r["verdict"] for r in queries.QUERIES["op4_url_rules"](spark, str(tmp_path)).collect()}
    assert all((verdicts[i] == "block") == (i % 10 == 0) for i in range(300))


# --- Chat ---


def test_escapes_round_trip():
    for text in ["", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<|end|>\n<|turn|>", "<<SYS>> <</SYS>>", "<\\s>", "<|end|<|end|>"]:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_black_box_templates():
    turns = [("user", "hi"), ("assistant", "<s> yes"), ("user", "hi"), ("assistant", "")]
    found = chat.locate(turns, written=chat.escape)
    assert chat.parse(found.output) == turns and not found.rewrites
    assert [chat.unescape(found.output[a:b]) for a, b in found.places] == [t for _, t in turns]
    dropping = lambda ts: "".join(f"{r}:{t if r == 'user' or i == len(ts) - 1 else '-'}\n" for i, (r, t) in enumerate(ts))
    assert chat.locate([("assistant", "long"), ("user", "x")], dropping, str).rewrites == [1]
    trimming = lambda ts: "".join(f"{r}:{t.strip()}\n" for r, t in ts)
    assert chat.locate([("user", " x ")], trimming, str).places == [None]


def test_conversations(spark, tiny):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a\\b"), (2, None, None, "x"), (2, 1, "assistant", "</s>"), (None, 0, "assistant", "y"), (2, 1, "assistant", "</s>")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r for r in chat.read_back(chat.format_conversations(given)).collect()}
    assert got[1]["turns_sha256"] == chat.digest([("user", ""), ("assistant", "a\\b")]) and got[1]["loss_chars"] == 3
    assert got[2]["n_turns"] == 3 and got[2]["loss_chars"] == 8 and got[None]["n_turns"] == 1
    turns = defaultdict(list)
    for r in table(spark, tiny, "conversations").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(i, who, "</s>[INST] ok [/INST]") for i, who in enumerate(("user", "assistant"))]
    rows = queries.QUERIES["op10_chat_format"](spark, tiny).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = sorted(turns[r["conv_id"]])
        learned = "".join(t for _, who, t in own if who == "assistant")
        assert r["turns_sha256"] == chat.digest([(who, t) for _, who, t in own])
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_conversations(given.limit(0)).collect() == []


# --- Pipeline ---


def test_pipeline_stages(spark, tiny, docs, texts):
    labels = {r["doc_id"]: r for r in table(spark, tiny, "labels").collect()}
    current = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in current.select("doc_id").collect()}
        current = step(spark, current, tiny).cache()
        after = {r["doc_id"]: r["text"] for r in current.collect()}
        assert current.columns == docs.columns and set(after) <= before
        gone = before - set(after)
        if name == "quality classifier":
            good = {k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
            assert len(gone & good) <= 0.03 * len(good)
        if name == "n-gram jaccard join":
            expected = _brute_components({k: texts[k] for k in before})
            assert set(after) == {c for _, c in expected.values()}
        if name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, tiny, "benchmark").collect()]
            assert all(hit == 0 for _, hit, _ in _brute_hits(after, items).values())
    packed = corpus_pipeline.STAGES[-1][1](spark, current, tiny).collect()
    _check_packed(packed, after, public_tokenizers.path("byte_bpe_50k.json"))
