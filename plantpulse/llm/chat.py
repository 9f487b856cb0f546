"""Chat formatting by incremental rendering of a black-box template.

A template is any function from turns to text. Its output for the first k turns is compared with that for the first
k - 1: what is added is the k-th turn's span, and a template that changes what it wrote before is told by an output that does
not start with the one before. Where a template's author states how far back it looks, prefixes start anew every ``BLOCK`` turns. Where a turn's text stands inside its span is found by rendering the turn with a probe in place
of its text. The loss mask is made of these places for the assistant's turns.

The library's own template marks turns with control strings and escapes them inside texts reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# --- Fixed values: control strings of the library's template and of common others, none of which may appear in a text. ---
BEGIN, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (BEGIN, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"

# Turns whose prefixes are rendered from one start, where a template's reach is known.
BLOCK = 32

_CONTROL = re.compile("|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# Characters of the private area: no control string, nothing to escape or trim.
_PROBE = "\ue000probe\ue001"


@lru_cache(maxsize=1024)  # a turn is rendered once for every longer prefix of its block
def escape(text: str) -> str:
    """``text`` without control strings: backslashes are doubled, and one goes after the first character of each control."""
    doubled = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], doubled)


def unescape(text: str) -> str:
    """The inverse of ``escape``: a backslash before a backslash is one backslash, before anything else nothing."""
    return _ESCAPED.sub(lambda m: m.group(1), text)


def render(turns: list[Turn]) -> str:
    """The library's template; null roles and texts count as empty."""
    return "".join(f"{BEGIN}{escape(role)}{MIDDLE}{escape(text)}{END}\n" for role, text in turns)


def parse(output: str) -> list[Turn]:
    """The turns that ``render`` wrote."""
    turns = []
    for part in output.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(BEGIN).partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


class Rendered(NamedTuple):
    """``spans`` of the turns and ``places`` of their texts in ``output``; ``rewrites`` lists turns that changed earlier output.

    A place is None where the text's own place cannot be told, because the template rewrites or alters it.
    """

    output: str
    spans: list[tuple[int, int]]
    places: list[tuple[int, int] | None]
    rewrites: list[int]


def locate(turns: list[Turn], template: Template = render, written: Callable[[str], str] = escape, reach: int | None = None) -> Rendered:
    """Render prefixes one turn longer each and compare consecutive outputs; ``written`` is how the template writes a text.

    ``reach`` is how many turns before a turn decide what the template writes for it, as its author states; None is any number.
    With a reach, a long conversation is rendered in blocks of ``BLOCK`` turns behind the turns in reach, so the time grows with
    its turns and not with their square. The parts must make up the one whole output; where they do not, or where a turn
    rewrites, the statement does not hold and whole prefixes are rendered.
    """
    if reach is not None and len(turns) > BLOCK:
        found = _by_blocks(turns, template, written, reach)
        if found is not None:
            return found
    return _by_prefixes(turns, template, written)


def _by_prefixes(turns: list[Turn], template: Template, written: Callable[[str], str], known: int = 0) -> Rendered:
    """What ``locate`` returns, for the turns behind the first ``known`` ones."""
    before, spans, places, rewrites = template(turns[:known]), [], [], []
    for k, (role, text) in enumerate(turns[known:], known):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewrites.append(k)
            common = _common(before, now)
            # What was located in the rewritten part no longer holds.
            places = [p if p and p[1] <= common else None for p in places]
            spans = [(min(a, common), min(b, common)) for a, b in spans]
            before = now[:common]
        start = len(before)
        spans.append((start, len(now)))
        places.append(_place(template, turns[:k], role, text, now, start, written))
        before = now
    return Rendered(before, spans, places, rewrites)


def _by_blocks(turns: list[Turn], template: Template, written: Callable[[str], str], reach: int) -> Rendered | None:
    """What ``locate`` returns for a template of that ``reach``; None where the outputs show that it looks further back or rewrites."""
    parts, spans, places = [template([])], [], []
    at = len(parts[0])
    for first in range(0, len(turns), BLOCK):
        known = min(first, reach)
        found = _by_prefixes(turns[first - known : first + BLOCK], template, written, known)
        if found.rewrites:
            return None
        start = found.spans[0][0]
        spans += [(a - start + at, b - start + at) for a, b in found.spans]
        places += [p and (p[0] - start + at, p[1] - start + at) for p in found.places]
        parts.append(found.output[start:])
        at += len(found.output) - start
    output = template(turns)
    return Rendered(output, spans, places, []) if output == "".join(parts) else None


def _place(template: Template, earlier: list[Turn], role: str, text: str, now: str, start: int, written: Callable[[str], str]) -> tuple[int, int] | None:
    probed = template([*earlier, (role, _PROBE)])
    at = probed.find(_PROBE, start)
    if at < 0:
        return None
    end = len(now) - (len(probed) - at - len(_PROBE))
    return (at, end) if at <= end and now[:at] == probed[:at] and now[at:end] == written(text) else None


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[Turn]]]:
    """(conversation, turns) from batches sorted by conversation and turn; only one conversation is held."""
    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(batch["conv"], batch["role"], batch["text"]):
            conv = None if pd.isna(conv) else conv
            if begun and conv != key:
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role or "", text or ""))
    if begun:
        yield key, turns


def digest(turns: list[Turn]) -> str:
    """Hex digest of role, line break, text, line break of every turn."""
    whole = hashlib.sha256()
    for role, text in turns:
        whole.update(f"{role}\n{text}\n".encode("utf-8"))
    return whole.hexdigest()


RESULT = "conv long, formatted string, starts array<long>, ends array<long>, rewrites array<int>"


def format_conversations(turns: DataFrame, template: Template = render, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reach: int | None = None) -> DataFrame:
    """One row per conversation: ``formatted`` text, the loss mask as ``starts`` and ``ends``, and turns that ``rewrites`` history.

    Turns are dealt by conversation and sorted by turn (then role and text, so ties have one order); null turns come first,
    null texts and roles count as empty, and null conversation keys form one conversation. A task holds one conversation at a
    time, as its output is one row. ``reach`` is that of ``locate``; the library's own template looks at one turn alone. Other columns
    are not read, and an empty table gives no rows. Assistant texts whose place cannot be told are left out of the mask.
    """
    bounded_batches(turns.sparkSession)
    sees = 0 if template is render else reach

    def formatted(batches):
        rows = []
        for key, own in _conversations(batches):
            found = locate(own, template, escape if template is render else str, sees)
            mask = [p for p, (who, _) in zip(found.places, own) if who == LEARNED and p]
            rows.append((key, found.output, [a for a, _ in mask], [b for _, b in mask], found.rewrites))
            if len(rows) == 64:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)

    given = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = given.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInPandas(formatted, RESULT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
    return out.astype({"conv": "Int64"})


def read_back(formatted: DataFrame) -> DataFrame:
    """What the outputs of the library's template say: turns and the text under the loss mask, both unescaped."""

    def read(batches):
        for batch in batches:
            rows = []
            for key, output, starts, ends in zip(batch["conv"], batch["formatted"], batch["starts"], batch["ends"]):
                turns = parse(output)
                learned = "".join(unescape(output[a:b]) for a, b in zip(starts, ends))
                rows.append((key, len(turns), digest(turns), len(learned), hashlib.sha256(learned.encode("utf-8")).hexdigest(), len(output)))
            yield pd.DataFrame(rows, columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv": "Int64"})

    schema = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInPandas(read, schema)
