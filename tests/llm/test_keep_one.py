"""One document of each component, row by row, and links in groups that are not one star."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plantpulse.llm import jaccard


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def plain_components(rows):
    """Component number of every row (None without shingles), by brute force."""
    sets = [sets_of(t) for _, t in rows]
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                at[top(i)] = top(j)
    return [top(i) if s else None for i, s in enumerate(sets)]


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


T, OTHER = " ".join(words(1, 60)), " ".join(words(2, 60))


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([(7, T), (8, T), (8, OTHER)], [(7, T), (8, OTHER)]),
        ([(1, T), (1, T), (2, T)], [(1, T)]),
        ([(5, T), (None, T), (None, T)], [(5, T)]),
        ([(None, T), (None, T), (None, OTHER)], [(None, OTHER), (None, T)]),
        ([(3, None), (3, None), (4, ""), (5, T)], [(3, None), (3, None), (4, ""), (5, T)]),
        ([(2, T + " tail"), (1, T), (3, T.upper())], [(1, T)]),
        ([(9007199254740993, T), (9007199254740992, OTHER), (None, OTHER)], [(9007199254740992, OTHER), (9007199254740993, T)]),
    ],
)
def test_rows_are_told_by_key_and_text(spark, rows, kept):
    given = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, k string, count long")
    found = jaccard.keep_one(given)
    assert found.columns == given.columns
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter(kept)


def family(seed, size, edits):
    """Near copies of a text, each a walk of edits away from one before, so that many are only linked through others."""
    rng, out = random.Random(seed), [words(seed, 80)]
    for _ in range(size):
        own = list(rng.choice(out))
        for _ in range(rng.randint(1, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        out.append(own)
    return [" ".join(w) for w in out]


def test_families_that_are_no_star(spark):
    rows = [(i, t) for i, t in enumerate([*family(3, 70, 2), *family(4, 40, 1), *family(5, 30, 4)])]
    of = plain_components(rows)
    smallest = {}
    for (k, _), c in zip(rows, of):
        smallest[c] = min(smallest.get(c, k), k)
    given = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(given).collect()}
    assert found == {k: smallest[c] for (k, _), c in zip(rows, of)}
    assert sorted(r["doc_id"] for r in jaccard.keep_one(given).collect()) == sorted(smallest.values())


def test_pair_leaves_in_one_block_only(spark):
    """Nodes that share many blocks give their pair once, whatever part of the list they carry."""
    import numpy as np

    point = bytes(np.full(jaccard.GROUPS, 1, np.uint8).tobytes())
    rows = [(s, node, node, 256, point, -1, 0, s, list(range(10))) for s in range(10) for node in (1, 2, 3)]
    rows += [(s, node, node, 256, point, -1, 0, s, [b for b in range(20, 23)]) for s in range(20, 23) for node in (4, 5, 6)]
    schema = "shingle long, node long, root long, n long, point binary, task long, side int, block long, blocks array<long>"
    seen = jaccard.tree_pairs(spark.createDataFrame(rows, schema))
    assert Counter(tuple(r) for r in seen.collect()) == Counter([(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6)])


def test_counts_beyond_their_range_bound_nothing():
    import numpy as np

    p = np.zeros(jaccard.GROUPS, np.uint8)
    q = p.copy()
    p[0], q[0] = jaccard._OPEN, 12
    assert jaccard.shared_counts(p, q) == 12
    q[0] = jaccard._OPEN
    assert jaccard.shared_counts(p, q) == np.iinfo(np.int64).max


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 1000])
def test_blocks_whatever_the_batches(spark, rows):
    rng = random.Random(9)
    given = [(node, [rng.randrange(60) if rng.random() < 0.7 else 100 + node for _ in range(6)]) for node in range(120)]
    given = [(node, sorted({*prefix, *([7] if node < 40 else [])})) for node, prefix in given]
    of = {}
    for node, prefix in given:
        for s in prefix:
            of.setdefault(s, []).append(node)
    want = Counter((s, v, nodes[0], len(nodes) > 2) for s, nodes in of.items() if len(nodes) > 1 for v in nodes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        found = jaccard.blocks(spark.createDataFrame(given, "node long, prefix array<long>"))
        assert Counter(tuple(r) for r in found.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
