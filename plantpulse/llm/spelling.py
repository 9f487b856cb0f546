"""Spelling variants by finite-state composition: words one edit apart, the form each belongs to, and the root of its forms.

A minimised acceptor holds the words; composing it with a transducer of exactly one insertion, deletion or replacement and
with itself again accepts the pairs of near words. Until the edit both sides are in one state, after it they go on with
equal characters; where they meet in one state, all that follows is accepted at once. Paths lead to a word's number, so
no string is built. The edit is placed at the first difference, so each pair is accepted once.

The composition is split by its initial state: words that share their first characters start from the state behind them, with
the edit still to come; pairs that differ within these characters share all that follows, and start from the words that end
alike. A state with too many words is split again the same way, so no task holds more than a bounded acceptor.
"""

from __future__ import annotations

from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import BROADCAST_LIMIT, checked, wide_batches

RUN = r"[a-zÀ-ÿ]+"  # on text whose A-Z are lower-cased
LEAST_LENGTH, LEAST_TIMES = 6, 5
# A form is at least so many times as frequent; one run in so many loses a character.
RATIO, MISSPELT_ONE_IN = 5, 199
# Characters of a word that lead to an initial state; words of one acceptor before it is split again.
STEP, GROUP_WORDS = 3, 20_000

_WHOLE = (1 << 64) - 1


class Acceptor:
    """Minimal acyclic automaton of sorted distinct strings; a path's offsets add up to the number of its string.

    Per state: ``final``, ``arcs`` (label, state, offset), ``count`` of strings, and ``lengths``, a mask of their lengths by 64.
    """

    def __init__(self, strings: list[str]):
        self.final, self.arcs, self.count, self.lengths = [], [], [], []
        self._known: dict[tuple, int] = {}
        open_states: list[tuple[list, list]] = [([False], [])]  # along the last string: final, arcs as (label, state)
        for before, s in pairwise(["", *strings]):
            same = 0
            for a, b in zip(before, s):
                if a != b:
                    break
                same += 1
            self._close(open_states, before, same)
            open_states.extend(([False], []) for _ in range(len(s) - same))
            open_states[-1][0][0] = True
        self._close(open_states, strings[-1] if strings else "", 0)
        self.start = self._state(*open_states[0])

    def _close(self, open_states: list, string: str, depth: int) -> None:
        while len(open_states) > depth + 1:
            state = self._state(*open_states.pop())
            open_states[-1][1].append((string[len(open_states) - 1], state))

    def _state(self, final: list, arcs: list) -> int:
        name = (final[0], *arcs)
        if name not in self._known:
            self._known[name] = len(self.final)
            offset, mask, laid = int(final[0]), int(final[0]), []
            for label, state in arcs:
                laid.append((label, state, offset))
                offset += self.count[state]
                mask |= ((self.lengths[state] << 1) | (self.lengths[state] >> 63)) & _WHOLE
            self.final.append(final[0])
            self.arcs.append(laid)
            self.count.append(offset)
            self.lengths.append(mask)
        return self._known[name]

    def _both(self, p: int, q: int, at_p: int, at_q: int, found: list, but: str = "") -> None:
        """Pairs of numbers of each string that ``p`` and ``q`` both accept, but those that begin with ``but``."""
        todo = [(p, q, at_p, at_q)]
        while todo:
            p, q, at_p, at_q = todo.pop()
            if not self.lengths[p] & self.lengths[q]:
                continue
            if p == q and not but:
                found.extend((at_p + i, at_q + i) for i in range(self.count[p]))
                continue
            if self.final[p] and self.final[q]:
                found.append((at_p, at_q))
            others = {label: (state, offset) for label, state, offset in self.arcs[q]}
            for label, state, offset in self.arcs[p]:
                if label != but and label in others:
                    other, own = others[label]
                    todo.append((state, other, at_p + offset, at_q + own))
            but = ""  # holds for the first character only

    def edits(self, p: int) -> np.ndarray:
        """Pairs of numbers below ``p`` whose first difference is at ``p``."""
        found: list[tuple[int, int]] = []
        arcs = self.arcs[p]
        for i, (label, state, offset) in enumerate(arcs):
            for _, other, own in arcs[i + 1 :]:
                self._both(state, other, offset, own, found)
            self._both(p, state, 0, offset, found, label)
        return np.array(found, np.int64).reshape(-1, 2)

    def near(self) -> np.ndarray:
        """All pairs of numbers of strings that differ by exactly one inserted, deleted or replaced character."""
        of: list[np.ndarray | None] = [None] * len(self.final)
        found, todo = [np.empty((0, 2), np.int64)], [(self.start, 0)]
        while todo:
            state, at = todo.pop()
            if self.count[state] < 2:
                continue
            if of[state] is None:
                of[state] = self.edits(state)
            if len(of[state]):
                found.append(of[state] + at)
            todo.extend((s, at + offset) for _, s, offset in self.arcs[state])
        return np.concatenate(found)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", misspelt_one_in: int = MISSPELT_ONE_IN) -> DataFrame:
    """(word, n): the words of at least 6 characters that occur at least 5 times in all texts, counted whole.

    A run whose digest with its document's key is divisible by ``misspelt_one_in`` loses one character first. Shorter runs
    cannot give such a word and are left out before counting; counts are summed in the tasks before the shuffle.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH).withColumn("h", F.crc32(F.encode(F.concat("k", F.lit(":"), "run"), "UTF-8")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % misspelt_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def initial_states(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """(kind, p, s, head, long, n): every word, p + head + s, in the groups that hold all its near words between them.

    Kind 0 joins words with the same beginning p and the same end s whose first difference is in the next ``STEP`` characters; a word
    stands there once by its own length and once (``long``) as one that is a character longer. Kind 1 joins words that begin with
    p alike and differ later. Beginnings of more than ``limit`` words are split by their next characters, from the first that differ.
    """
    rows = None
    now = words.select("word", "n", F.lit("").alias("p"))
    while True:
        now = now.withColumn("at", F.length("p"))
        own = now.selectExpr("0 AS kind", "p", f"substring(word, at + {STEP + 1}) AS s", f"substring(word, at + 1, {STEP}) AS head", "false AS long", "n")
        longer = now.selectExpr("0 AS kind", "p", f"substring(word, at + {STEP + 2}) AS s", f"substring(word, at + 1, {STEP + 1}) AS head", "true AS long", "n")
        now = now.select("word", "n", F.expr(f"substring(word, 1, at + {STEP})").alias("p"))
        sizes = now.groupBy("p").agg(F.count("*").alias("words"), F.min("word").alias("lo"), F.max("word").alias("hi")).where(F.col("words") > limit)
        common = F.expr("size(filter(sequence(1, least(length(lo), length(hi))), i -> substring(lo, 1, i) = substring(hi, 1, i)))")
        hot = checked(stage(sizes.select(F.col("p"), common.alias("deep")), "hot-states"), BROADCAST_LIMIT)
        after = now.join(hot, "p", "left_anti").selectExpr("1 AS kind", "p", "'' AS s", f"substring(word, length(p) + 1) AS head", "false AS long", "n")
        level = own.unionByName(longer).unionByName(after)
        rows = level if rows is None else rows.unionByName(level)
        if not hot.head(1):
            return rows
        now = stage(now.join(hot, "p").select("word", "n", F.expr("substring(word, 1, deep)").alias("p")), "hot-words")


def _near_in(kind: int, heads: list[str], long: np.ndarray) -> np.ndarray:
    """Pairs of places in sorted distinct ``heads`` that are near words, each of which no other group has."""
    pairs = Acceptor(heads).near()
    if kind or not len(pairs):
        return pairs
    # Two longer words meet by their own lengths elsewhere; pairs that differ only behind the head belong to kind 1.
    pairs = pairs[~(long[pairs[:, 0]] & long[pairs[:, 1]])]
    later = [len(heads[i]) == STEP and heads[j].startswith(heads[i]) for i, j in pairs.tolist()]
    return pairs[~np.array(later, bool)] if later else pairs


def _groups(batches):
    """(kind, p, s, sorted distinct heads, long, n) of the groups in sorted rows with two words or more."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    for (kind, p, s), members in groupby(rows, key=lambda row: row[:3]):
        heads, long, n = [], [], []
        for _, _, _, head, is_long, times in members:
            if heads and heads[-1] == head:  # a word at its end stands here in both roles
                long[-1] = long[-1] and is_long
            else:
                heads.append(head)
                long.append(is_long)
                n.append(times)
        if len(heads) > 1 and not all(long):
            yield kind, p, s, heads, np.array(long), np.array(n, np.int64)


def _dealt(words: DataFrame, limit: int) -> DataFrame:
    keys = ["kind", "p", "s"]
    return initial_states(words, limit).repartition(*keys).sortWithinPartitions(*keys, "head").select(*keys, "head", "long", "n")


def near_pairs(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """(a, b), a < b: all pairs of near words of ``words`` (word, n), each once."""

    def paired(batches):
        for kind, p, s, heads, long, _ in _groups(batches):
            pairs = _near_in(kind, heads, long).tolist()
            for at in range(0, len(pairs), 10_000):
                both = [sorted((p + heads[i] + s, p + heads[j] + s)) for i, j in pairs[at : at + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*both)], names=["a", "b"])

    return _dealt(words, limit).mapInArrow(paired, "a string, b string")


def near_counts(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best): the number of near words and the most frequent one as (minus its n, word), ties to the smaller word.

    Pairs are summed up in their group, so no more rows leave a task than came in.
    """
    kind_of = pa.struct([("minus_n", pa.int64()), ("word", pa.string())])

    def counted(batches):
        out: list[tuple] = []
        for kind, p, s, heads, long, n in _groups(batches):
            pairs = _near_in(kind, heads, long)
            if not len(pairs):
                continue
            own, other = np.concatenate([pairs, pairs[:, ::-1]]).T
            # Heads are sorted and share what is around them but for pairs of other lengths, so words decide ties by themselves.
            whole = {i: p + heads[i] + s for i in np.unique(own).tolist()}
            order = np.lexsort([-n[other], own])
            own, other = own[order], other[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ends = np.append(first[1:], len(own))
            for a, b in zip(first.tolist(), ends.tolist()):
                most = n[other[a]]
                tied = min(whole[i] for i in other[a:b][n[other[a:b]] == most].tolist())
                out.append((whole[int(own[a])], b - a, {"minus_n": -int(most), "word": tied}))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out):
        word, n, best = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n, pa.int64()), pa.array(best, kind_of)], names=["word", "n_near", "best"])

    found = _dealt(words, limit).mapInArrow(counted, "word string, n_near long, best struct<minus_n: long, word: string>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last by doubling; frequencies rise along them, so there is no circle."""
    now = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = now.join(ahead, now["root"] == ahead["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stage(moved, "forms")
        now = moved.select("word", "root")
        if not moved.where("moved").head(1):
            return now


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, limit: int = GROUP_WORDS, misspelt_one_in: int = MISSPELT_ONE_IN) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per word of ``vocabulary``.

    ``form`` is the near word of the largest n (ties: the smallest word) if it is at least ``ratio`` times as frequent,
    else null; ``root`` is the last form reached, or the word itself. Null and empty texts have no words; a null key counts
    as an empty one in the digest; repeated rows count again; other columns are not read. A very long run is one word.
    """
    words = stage(vocabulary(docs, key, text, misspelt_one_in), "words")
    with wide_batches(docs.sparkSession):
        near = stage(near_counts(words, limit), "near")
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus_n"))
    has = F.col("form_n") >= ratio * F.col("n")
    formed = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "formed")
    roots = roots_of(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
