"""Samples with one row a key, and cases that caps on rounds, alternatives or entries would lose."""

from __future__ import annotations

import itertools
import random

from plantpulse.llm import decontamination, licenses, quality, toxicity
from plantpulse.llm.common import free_name, labelled_sample


def test_a_sample_has_one_row_for_each_key(spark):
    docs = spark.createDataFrame([(7, f"text {i % 50}") for i in range(2_000)] + [(8, "other"), (None, "no key"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0), (7, 1), (8, 0), (9, 1), (None, 1), (11, None)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 10)
    assert got.columns == ["doc_id", "text", "toxic"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows) and rows[7]["toxic"] == 1 and rows[7]["text"].startswith("text ")
    assert {r["text"] for r in labelled_sample(docs.repartition(5), labels, "toxic", 10).where("doc_id = 7").collect()} == {rows[7]["text"]}
    assert labelled_sample(docs, labels, "toxic", 1).count() <= 1
    assert labelled_sample(docs.limit(0), labels, "toxic", 10).count() == 0


def test_a_clashing_column_stays(spark):
    docs = spark.createDataFrame([(1, "some text", "own"), (2, None, None)], "doc_id long, text string, Quality string")
    assert free_name(docs, "quality") == "quality_" and free_name(docs, "free") == "free"
    model = quality.Model(quality.np.zeros(quality.BUCKETS, "float32"), quality.np.array([0.0, 1.0]))
    for given in (model, None):
        got = quality.judged(docs, given)
        assert got.columns == [*docs.columns, "quality_"]
        assert {r["Quality"] for r in got.collect()} == {"own", None}


def _postfix(text):
    return licenses.postfix(licenses.tokens(text))


def _alternatives(form):
    """Alternatives that ask for no more than another one does."""
    every = licenses.evaluate(_postfix(form))
    return {a for a in every if not any(b < a for b in every)}


def test_expressions_of_many_alternatives_are_kept():
    text = " AND ".join(f"(A{i} OR B{i})" for i in range(7))
    got = licenses.Scanner().scan(f"SPDX-License-Identifier: {text}")
    assert len(got["expressions"]) == 1 and len(_alternatives(got["expressions"][0])) == 128
    assert _alternatives(got["expressions"][0]) == _alternatives(text)


def test_normal_form_keeps_the_meaning_in_any_order():
    chance = random.Random(3)

    def made(depth):
        if not depth or chance.random() < 0.3:
            return chance.choice("abcde") + (" with x" if chance.random() < 0.2 else "")
        return f"({made(depth - 1)} {chance.choice(['and', 'or'])} {made(depth - 1)})"

    for _ in range(300):
        text = made(4)
        form = licenses.normal_form(_postfix(text))
        assert _alternatives(form) == _alternatives(text) and licenses.normal_form(_postfix(form)) == form
    forms = {licenses.normal_form(_postfix(" and ".join(p))) for p in itertools.permutations(["(a or b)", "c", "(d or (e and f))"])}
    assert len(forms) == 1
    deep = "".join(f"(n{i} {'or' if i % 2 else 'and'} " for i in range(3_000)) + "z" + ")" * 3_000
    assert licenses.normal_form(_postfix(deep)).count("n") >= 3_000


def test_the_longest_expression_at_the_start():
    assert licenses.expression_at("MIT or ((((((") == ["mit"]
    assert licenses.expression_at("(a or b) and (c") == ["a", "b", "or"]
    assert licenses.expression_at("MIT and or") == ["mit"]
    assert licenses.expression_at(") a") == licenses.expression_at("(a") == licenses.expression_at("") == []
    items = ["a", "b", "and", "or", "with", "(", ")"]
    for n in range(1, 6):
        for found in itertools.product(items, repeat=n):
            best = 0
            for stop in range(1, n + 1):
                try:
                    licenses.postfix(found[:stop])
                    best = stop
                except licenses.BadExpression:
                    continue
            assert licenses._complete(list(found)) == best


def test_no_expressions_in_an_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels string")).count() == 0


def test_passages_that_appear_by_cutting_are_cut(spark):
    passage = "p q r s t u v w x y".split()
    bench = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    text = " ".join(passage)
    for _ in range(3):
        text = f"{' '.join(passage[:4])} {text} {' '.join(passage[4:])}"
    clean = " ".join(f"own{i}" for i in range(200))
    given = spark.createDataFrame([(1, f"{clean} {text} end"), (2, clean), (3, None)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in decontamination.remove(given, bench).collect()}
    assert left == {1: f"{clean} end", 2: clean, 3: None}


def test_rare_words_and_exceptions_are_learned(spark):
    chance, rows, labels = random.Random(5), [], []
    calm = [f"calm{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    for k in range(3_000):
        toxic = k % 2 == 0
        found = [chance.choice(calm) for _ in range(60)]
        found[30] = "vilest" if toxic else "grubby spade" if k % 40 == 1 else found[30]
        if toxic and k % 20:
            found[10] = "grubby"
        if toxic and k % 64 == 0:
            found[50] = "zqrare"
        rows.append((k, " ".join(found)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {" vilest ", " grubby ", " zqrare "} <= set(lexicon.entries)
    assert not any(c in p for p in lexicon.entries for c in calm)
    assert "grubby spade" in lexicon.exceptions and lexicon.power in toxicity.POWERS
    own = toxicity.Matcher(lexicon)
    line = toxicity.fold("the grubby spade and the vilest grubby thing")
    held = lexicon.entries[" vilest "] + lexicon.entries[" grubby "]
    assert 0 < own.weight(line) <= 2 * held and own.weight(toxicity.fold("the grubby spade")) == 0.0
    odd = spark.createDataFrame([(1, ""), (1, None), (None, "x " * 50_000), (None, "x " * 50_000)], "doc_id long, text string")
    scored = [r["s"] for r in odd.select(toxicity.score_column(odd, lexicon).alias("s")).collect()]
    assert len(scored) == 4 and all(s < 0.5 for s in scored)
    assert docs.limit(0).select(toxicity.score_column(docs, lexicon).alias("s")).count() == 0
