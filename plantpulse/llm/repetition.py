"""Quality rules by repetition coverage: how many characters of a text lie inside repeated word n-grams and repeated lines.

Words are numbered exactly; windows of several lengths are told by a rolling hash that grows by one word at a time, and
windows of equal hash are compared word by word, so the result does not rest on the hash. A longer window can only be
repeated where a shorter one is, so each length looks at the places the one before left.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Percent of the characters of words that may lie in repeats of windows of so many words; in repeated lines; symbols per 100 words.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT, SYMBOL_LIMIT = 20, 10
# The base rules: fewest words, words of the short window, and the percent of words that may lie in short windows found twice.
LEAST_WORDS, SHORT, SHORT_LIMIT = 50, 3, 50

_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_B = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 300_000


class Words:
    """Numbers of words, equal for equal words of a text; kept in a bounded table of the worker."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(number, code points) of every word of UTF-8 ``raw``; ``bytes.split`` parts at the six ASCII spaces only."""
        found = raw.split()
        if len(self.number) > _CACHE_WORDS:
            self.number.clear()
        number = self.number
        for w in set(found).difference(number):
            number[w] = len(number)
        ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if not raw.isascii():
            later = np.frombuffer(b"".join(found), np.uint8) & 0xC0 == 0x80  # bytes that go on with a character
            behind = np.concatenate([[0], np.cumsum(later)])
            ends = np.cumsum(sizes)
            sizes = sizes - (behind[ends] - behind[ends - sizes])
        return ids, sizes


def repeats(ids: np.ndarray, lengths: Iterable[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each window length: the starts of windows found twice or more, and of those all but each window's first."""
    with np.errstate(over="ignore"):
        word = (ids.astype(np.uint64) + np.uint64(1)) * _B
        word ^= word >> np.uint64(29)
    lengths = sorted(lengths)
    found, at, rolled, size = {}, np.arange(len(ids)), word, 1
    for n in lengths:
        at = at[at <= len(ids) - n]
        if len(at) < 2:  # nothing can be repeated at this length, nor at longer ones
            return found | dict.fromkeys(lengths[len(found) :], (at[:0], at[:0]))
        rolled = rolled[: len(at)]
        with np.errstate(over="ignore"):
            for j in range(size, n):
                rolled = rolled * _B + word[at + j]
        size = n
        order = np.argsort(rolled, kind="stable")
        same = rolled[order[1:]] == rolled[order[:-1]]
        left, right = at[order[:-1][same]], at[order[1:][same]]
        if len(left) and any((ids[left + j] != ids[right + j]).any() for j in range(n)):  # different windows of one hash
            windows = np.stack([ids[at + j] for j in range(n)], axis=1)
            order = np.lexsort([at, *windows.T[::-1]])
            same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        twice = again.copy()
        twice[order[:-1][same]] = True
        found[n] = at[twice], at[again]
        at, rolled = at[twice], rolled[twice]
    return found


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` words lie in a window of ``n`` words that begins at one of ``starts``."""
    if not len(starts):
        return np.zeros(words, bool)
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(text: str, words: Words, limits: dict[int, int] = LIMITS) -> dict[str, int]:
    """All counts of one text: ``repeat_chars_n`` for each length of ``limits`` besides those of the base rules."""
    raw = text.encode("utf-8")
    ids, sizes = words.of(raw)
    out = {"n_words": len(ids), "word_chars": int(sizes.sum()), "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS))}
    seen, again, chars = set(), 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            kept = line.translate(None, _SPACES)
            again += bool(kept)
            chars += len(kept) if kept.isascii() else len(kept.decode("utf-8"))
        else:
            seen.add(line)
    out |= {"n_dup_lines": again, "dup_line_chars": chars}
    found = repeats(ids, {SHORT, *limits})
    out["n_repeat_words"] = int(covered(found[SHORT][0], SHORT, len(ids)).sum())
    for n in limits:
        out[f"repeat_chars_{n}"] = int(sizes[covered(found[n][1], n, len(ids))].sum())
    return out


def judge_repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT, symbol_limit: int = SYMBOL_LIMIT) -> DataFrame:
    """One row per row of ``docs``: key, the counts, ``base_failed`` and ``kept``.

    A text is kept if it has at least 50 words, at most half of its words lie in windows of three words found twice or more,
    and neither windows of any length in ``limits`` nor lines that stood before hold more than their percent of its characters.
    Characters are code points of words; what stands first of a repeated window or line does not count. Null and empty texts
    have no words and fail. Repeated rows and null keys are judged like any other row; other columns are not read. A very
    long text is one row of one task, with a few numbers for each of its words in memory.
    """
    bounded_batches(docs.sparkSession)
    limits = LIMITS if limits is None else limits
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"repeat_chars_{n}" for n in limits)]

    def measured(batches):
        words = Words()
        for batch in batches:
            rows = [measures(t, words, limits) for t in batch.column(1).to_pylist()]
            counts = [pa.array([r[n] for r in rows], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts], names=["k", *names])

    given = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    kind = given.schema["k"].dataType.simpleString()
    counts = given.mapInArrow(measured, ", ".join([f"k {kind}", *(f"{n} long" for n in names)]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > SHORT_LIMIT * F.col("n_words"))
    over = (100 * F.col("dup_line_chars") > line_limit * F.col("word_chars")) | (100 * F.col("n_symbols") > symbol_limit * F.col("n_words"))
    for n, percent in limits.items():
        over = over | (100 * F.col(f"repeat_chars_{n}") > percent * F.col("word_chars"))
    return counts.select(F.col("k").alias(key), *names, failed.alias("base_failed"), (~failed & ~over).alias("kept"))
