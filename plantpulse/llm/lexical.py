"""Ranked lexical search: the best documents for each item, by branch and bound in frequency-ordered trees of documents.

A document is restricted to the terms that items ask for and ordered by how many documents hold a term, most first, so that
documents share paths of a trie (an FP-tree of documents). Every subtree keeps, for each term below it, the largest term
frequency and, for all, the least length factor m; a score grows with the one and falls with the other, so together they
bound the scores below. A search goes down depth first and carries the items for which the bound reaches their last place;
where few documents are left, they are scored exactly in whole numbers. Trees are built in the tasks, of a bounded number
of documents each; a task passes on its best of each item, and the best of these are the result.
"""

from __future__ import annotations

import heapq
import math
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .common import bounded_batches

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Documents and vector entries of one tree, about; documents that are scored without a further split; levels before halving.
TREE_DOCS, TREE_ENTRIES, LEAF, DEEPEST = 16_384, 2_000_000, 32, 64
# Pairs of item and term that are searched at once; more items go in several blocks, each against all documents.
BLOCK_TERMS = 500_000
# Documents whose own ranking gives every item a score to beat before the search of all documents begins.
FIRST_DOCS = 20_000

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _KEPT else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """Terms of a text as UTF-8: separators are ASCII, so bytes can be mapped and split; only A-Z is lower-cased."""
    return text.encode("utf-8").translate(_TABLE).split()


def gain(tf, m):
    """What one occurrence of a term in an item adds for each unit of its weight; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Items(NamedTuple):
    """Items as rows of (term, weight): ``starts`` of each row in ``terms`` and ``weights`` (item repeats included)."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, weights and starts of the given rows, laid end to end."""
        begin, size = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.terms[at], self.weights[at], ends - size


class Best:
    """The scores to reach: of every item the ``top`` best scores so far, never below its ``least``."""

    def __init__(self, least: np.ndarray, top: int):
        self.top, self.least, self.heaps = top, np.maximum(least, 1), [[] for _ in least]

    def add(self, item: int, score: int, times: int) -> None:
        own = self.heaps[item]
        for _ in range(min(times, self.top)):
            if len(own) < self.top:
                heapq.heappush(own, score)
            elif score > own[0]:
                heapq.heapreplace(own, score)
            else:
                break
        if len(own) == self.top:
            self.least[item] = max(self.least[item], own[0])


class DocumentTree:
    """Trie of documents over (``terms``, ``tfs``) cut at ``offsets``; equal documents are one, with members in the order of ``place``."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, offsets: np.ndarray, m: np.ndarray, place: np.ndarray, width: int):
        self.width = width
        own = np.repeat(np.arange(len(m)), np.diff(offsets))
        order = np.lexsort([terms, own])
        terms, tfs = terms[order], tfs[order]
        # Big-endian numbers compare like their bytes, so bytes order the paths.
        paths, counts = terms.astype(">u4").tobytes(), tfs.astype(">u4").tobytes()
        cut = [(paths[4 * a : 4 * b], counts[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        ms, places = m.tolist(), place.tolist()
        rows = sorted(range(len(m)), key=lambda i: (*cut[i], ms[i], places[i]))
        new = [j for j, i in enumerate(rows) if not j or cut[i] != cut[rows[j - 1]] or ms[i] != ms[rows[j - 1]]]
        self.rows, self.begin = np.array(rows), np.array([*new, len(rows)])
        lead = self.rows[self.begin[:-1]]  # the first member of each group of equal documents
        self.m, self.low, self.high = m[lead], offsets[lead], offsets[lead + 1]
        self.terms, self.tfs = terms, tfs
        self._split()

    def _shared(self) -> np.ndarray:
        """How many terms each document's path shares with the one before it; -1 for the first."""
        size, shared = self.high - self.low, np.zeros(len(self.m), np.int64)
        live, depth = np.arange(1, len(self.m)), 0
        while len(live):
            live = live[(size[live] > depth) & (size[live - 1] > depth)]
            live = live[self.terms[self.low[live] + depth] == self.terms[self.low[live - 1] + depth]]
            shared[live] += 1
            depth += 1
        shared[:1] = -1
        return shared

    def _split(self) -> None:
        """``nodes``: (first, last, children) with children behind their parent; few small siblings are one leaf."""
        shared = self._shared()
        self.nodes: list[list] = [[0, len(self.m), []]]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            first, last, children = self.nodes[node]
            if last - first <= LEAF:
                continue
            inner = shared[first + 1 : last]
            cuts = first + 1 + np.flatnonzero(inner == inner.min()) if depth < DEEPEST else np.array([(first + last) // 2])
            start = first
            for a, b in zip([first, *cuts.tolist()], [*cuts.tolist(), last]):
                if b - start > LEAF and a > start:
                    children.append(self._node(start, a, todo, depth))
                    start = a
                if b - start > LEAF:
                    children.append(self._node(start, b, todo, depth))
                    start = b
            if start < last:
                children.append(self._node(start, last, todo, depth))
        self.tops: list[tuple] = [()] * len(self.nodes)
        for i in range(len(self.nodes) - 1, -1, -1):
            first, last, children = self.nodes[i]
            if children:
                terms, tfs = (np.concatenate([self.tops[c][j] for c in children]) for j in (0, 1))
            else:
                at = np.concatenate([np.arange(a, b) for a, b in zip(self.low[first:last], self.high[first:last])])
                terms, tfs = self.terms[at], self.tfs[at]
            order = np.argsort(terms, kind="stable")
            terms, tfs = terms[order], tfs[order]
            new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
            self.tops[i] = terms[new], np.maximum.reduceat(tfs, new), int(self.m[first:last].min())

    def _node(self, first: int, last: int, todo: list, depth: int) -> int:
        self.nodes.append([first, last, []])
        todo.append((len(self.nodes) - 1, depth + 1))
        return len(self.nodes) - 1

    def search(self, items: Items, best: Best) -> list[tuple[int, int, int]]:
        """(item, group of equal documents, score) of all that may be among an item's best."""
        found: list[tuple[int, int, int]] = []
        scratch = np.zeros(self.width, np.int64)
        todo = [(0, np.arange(len(items.starts) - 1))]
        while todo:
            node, live = todo.pop()
            top_terms, top_tfs, least_m = self.tops[node]
            terms, weights, starts = items.of(live)
            scratch[top_terms] = gain(top_tfs, least_m)
            bound = np.add.reduceat(weights * scratch[terms], starts)
            scratch[top_terms] = 0
            live = live[bound >= best.least[live]]
            if not len(live):
                continue
            first, last, children = self.nodes[node]
            if children:
                todo.extend((c, live) for c in children)
            else:
                self._score(first, last, top_terms, live, items, best, found)
        return found

    def _score(self, first: int, last: int, own_terms: np.ndarray, live: np.ndarray, items: Items, best: Best, found: list) -> None:
        terms, weights, starts = items.of(live)
        at = np.searchsorted(own_terms, terms)
        at[at == len(own_terms)] = 0
        at = np.where(own_terms[at] == terms, at, len(own_terms))  # the last column stands for terms that are in no document here
        grid = np.zeros((last - first, len(own_terms) + 1), np.int64)
        for i in range(first, last):
            span = slice(self.low[i], self.high[i])
            grid[i - first, np.searchsorted(own_terms, self.terms[span])] = gain(self.tfs[span], self.m[i])
        scores = np.add.reduceat(grid[:, at] * weights, starts, axis=1)
        for row, column in zip(*np.nonzero(scores >= best.least[live])):
            item, score = int(live[column]), int(scores[row, column])
            if score >= best.least[item]:
                best.add(item, score, int(self.begin[first + row + 1] - self.begin[first + row]))
                found.append((item, first + int(row), score))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(k, n, terms, tfs) per row: its number of terms, and its counts of the terms in ``vocabulary`` by their numbers."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches):
        get = known.value.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for t in batch.column(1).to_pylist():
                all_terms = terms_of(t)
                ids = np.fromiter(map(get, all_terms, repeat(-1)), np.int32, len(all_terms))
                own, count = np.unique(ids[ids >= 0], return_counts=True)
                n.append(len(all_terms))
                terms.append(own)
                tfs.append(count)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "terms", "tfs"])

    given = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    kind = given.schema["k"].dataType.simpleString()
    return given.mapInArrow(counted, f"k {kind}, n long, terms array<int>, tfs array<long>")


def _sized(batches):
    """Batches gathered up to about the size of a tree."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, TREE_DOCS):
            part = batch.slice(at, TREE_DOCS)
            held.append(part)
            docs, entries = docs + part.num_rows, entries + len(pc.list_flatten(part.column("terms")))
            if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield pa.Table.from_batches(held)
                held, docs, entries = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def task_best(found: DataFrame, items: Items, number: np.ndarray, documents: int, length: int, least: np.ndarray, top: int) -> DataFrame:
    """(item, k, score): for each item the ``top`` best documents of every task over vectors; ``number`` orders the terms.

    ``least`` are scores that the result has to reach; they leave out nothing that could be among the best.
    """
    sent = found.sparkSession.sparkContext.broadcast((items, number, least))

    def ranked(batches):
        own_items, own_number, own_least = sent.value
        best, kept = Best(own_least, top), {}
        for chunk in _sized(batches):
            key = chunk.column("k").combine_chunks()
            place = np.empty(len(key), np.int64)
            place[pc.sort_indices(key, null_placement="at_end").to_numpy()] = np.arange(len(key))
            lists = chunk.column("terms").combine_chunks()
            terms = own_number[pc.list_flatten(lists).to_numpy()]
            tfs = pc.list_flatten(chunk.column("tfs").combine_chunks()).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            m = 75 + (25 * chunk.column("n").to_numpy() * documents) // length
            tree = DocumentTree(terms, tfs, offsets, m, place, len(own_number))
            hits: dict[int, list] = {}
            for item, group, score in tree.search(own_items, best):
                if score >= best.least[item]:
                    members = tree.rows[tree.begin[group] : tree.begin[group + 1]][:top]
                    hits.setdefault(item, []).extend((-score, place[i], i) for i in members.tolist())
            for item, rows in hits.items():
                rows.sort()
                named = [(score, key[i].as_py()) for score, _, i in rows[:top]]
                both = kept.get(item, []) + [(score, k is None, k) for score, k in named]
                both.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
                kept[item] = both[:top]
        rows = [(item, k, -score) for item, own in kept.items() for score, _, k in own]
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int32(), key.type if rows else pa.null(), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item", "k", "score"])

    kind = found.schema["k"].dataType.simpleString()
    return found.where(F.size("terms") > 0).mapInArrow(ranked, f"item int, k {kind}, score long")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each item with their ``rank``; equal scores by ascending key, null keys last."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("k"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item, rank, key, score): the ``top`` documents of each item with a score above 0, ranked from 1.

    Null and empty texts have no terms: such documents count for nothing and such items give no rows. Every row of ``docs`` is
    a document, repeated ones too; equal scores are in the order of the key, null keys last. Repeated rows of ``items`` count
    once, and different texts of one item id are one item. Other columns are not read. Documents are read once for each
    block of at most about ``BLOCK_TERMS`` pairs of item and term, and equal documents are scored once in a tree.
    """
    lower = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col(item).alias("id"), lower.alias("t")).distinct()
    asked = asked.select("id", F.explode(F.regexp_extract_all("t", F.lit(TERM), F.lit(0))).alias("term")).groupBy("id", "term").count()
    asked = stage(asked, "asked")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    parts = [_block(docs, asked.where(F.col("block") == b).drop("block"), top, key, text) for b in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select(F.col("id").alias(item), "rank", F.col("k").alias(key), "score")


def _block(docs: DataFrame, asked: DataFrame, top: int, key: str, text: str) -> DataFrame:
    """``rank_documents`` for the items of one block."""
    spark = docs.sparkSession
    pairs = asked.toArrow()  # at most about BLOCK_TERMS rows
    asking, terms, counts = (pairs.column(c).to_pylist() for c in ("id", "term", "count"))
    terms = [t.encode("utf-8") for t in terms]
    words = sorted(set(terms))
    vocabulary = {t: i for i, t in enumerate(words)}
    found = stage(vectors(docs, vocabulary, key, text), "vectors")
    documents, length, filled = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
    held = np.zeros(len(words), np.int64)
    for row in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each asked term at most
        held[row["term"]] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    number = np.empty(len(words), np.int64)
    number[np.argsort(-held, kind="stable")] = np.arange(len(words))

    ids = list(dict.fromkeys(asking))
    kind = asked.schema["id"].dataType.simpleString()
    named = spark.createDataFrame(list(enumerate(ids)), f"item int, id {kind}")
    if not filled:
        return named.join(spark.createDataFrame([], f"item int, k {found.schema['k'].dataType.simpleString()}, score long, rank int"), "item")
    row_of, at, counts = {v: i for i, v in enumerate(ids)}, np.array([vocabulary[t] for t in terms]), np.array(counts, np.int64)
    row = np.array([row_of[v] for v in asking])
    order = np.argsort(row, kind="stable")
    at, counts = at[order], counts[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(row))])
    given = Items(starts, number[at], weight[at] * counts)

    least = np.zeros(len(ids), np.int64)
    if filled > 2 * FIRST_DOCS:
        # Any documents give valid scores to beat: the last place can only rise.
        some = found.where(F.pmod(F.xxhash64("k", "n"), F.lit(max(1, filled // FIRST_DOCS))) == 0)
        last = _first(task_best(some, given, number, documents, length, least, top), top).where(F.col("rank") == top)
        for r in last.collect():  # one row for each item at most
            least[r["item"]] = r["score"]
    best = _first(task_best(found, given, number, documents, length, least, top), top)
    return best.join(F.broadcast(named), "item")
