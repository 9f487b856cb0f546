"""Licence scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser reads expressions.

A text becomes its words joined by single spaces, so a phrase is a substring between spaces and every place
is found in one pass. Identifier tags (``SPDX-License-Identifier:``) are followed by an expression of
identifiers joined by ``and``, ``or`` and ``with``; it is parsed, and its meaning is kept as one form for all ways
to write it in another order. Labels are taken from the phrases found and from every identifier of a well-formed expression.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching
from .common import bounded_batches

# --- Fixed values: the phrases of the contract, in its order. ---
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# --- Notice phrases of well-known licences, by the label they give and how sure they are. ---
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "the mit license": ("mit", 0.8),
    "licensed under the apache license": ("apache", 0.8),
    "apache 2 0 license": ("apache-2", 0.85),
    "gnu general public license": ("gpl", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.85),
    "gnu affero general public license": ("agpl", 0.85),
    "mozilla public license": ("mpl", 0.85),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "eclipse public license": ("epl", 0.85),
    "creative commons attribution": ("cc", 0.7),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by 4 0": ("cc-by", 0.8),
    "public domain dedication": ("cc0", 0.7),
    "all rights reserved": ("proprietary", 0.5),
}
TAG = "spdx license identifier"
BASE_SURE, TAG_SURE = 0.9, 0.98

_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


class BadExpression(ValueError):
    """The text after a tag is no licence expression."""


def tokens(text: str) -> list[str]:
    """Brackets, operators and identifiers at the start of ``text``; what cannot be read ends the expression."""
    found, at = [], 0
    while at < len(text):
        if text[at] in " \t":
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            break
        found.append(m.group().rstrip(".:-") or m.group())
        at = m.end()
    return found


def postfix(items: Iterable[str]) -> list[str]:
    """Shunting yard: ``with`` binds closest, then ``and``, then ``or``; equal operators group to the left."""
    out, held, operand = [], [], False
    for item in items:
        word = item.lower()
        if word in _RANK:
            if not operand:
                raise BadExpression(f"no licence before {item}")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
        elif item == "(":
            if operand:
                raise BadExpression("no operator before (")
            held.append(item)
        elif item == ")":
            if not operand:
                raise BadExpression("no licence before )")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise BadExpression("unmatched )")
            held.pop()
        else:
            if operand:
                raise BadExpression(f"no operator before {item}")
            out.append(word)
            operand = True
    if not operand:
        raise BadExpression("the expression ends in an operator or is empty")
    while held:
        if held[-1] == "(":
            raise BadExpression("unmatched (")
        out.append(held.pop())
    return out


def evaluate(expression: list[str]) -> set[frozenset[str]]:
    """Alternatives of a postfix expression: each is a set of licences that hold together.

    Their number doubles with each ``and`` of two choices; ``normal_form`` says the same in the length of the expression.
    """
    stack: list[set[frozenset[str]]] = []
    for item in expression:
        if item not in _RANK:
            stack.append({frozenset([item])})
            continue
        right, left = stack.pop(), stack.pop()
        if item == "or":
            both = left | right
        elif item == "and":
            both = {a | b for a in left for b in right}
        else:
            if len(right) != 1 or len(left) != 1 or len(min(right)) != 1 or len(min(left)) != 1:
                raise BadExpression("with joins one licence and one exception")
            both = {frozenset([f"{min(min(left))} with {min(min(right))}"])}
        stack.append(both)
    return stack[0]


class _Joined:
    """What one operator joins: names, and groups of the other operator by digest, so equal parts stand once in any order."""

    def __init__(self, operator: str, *parts: str | _Joined):
        self.operator, self.names, self.groups = operator, set(), {}
        for part in parts:
            if isinstance(part, str):
                self.names.add(part)
            else:
                self.groups[part.digest()] = part

    def size(self) -> int:
        return len(self.names) + len(self.groups)

    def take(self, other: _Joined) -> None:
        self.names |= other.names
        self.groups |= other.groups

    def digest(self) -> bytes:
        whole = hashlib.md5(f"{self.operator}\n{chr(10).join(sorted(self.names))}\n".encode())
        for part in sorted(self.groups):
            whole.update(part)
        return whole.digest()


def normal_form(expression: list[str]) -> str:
    """A postfix expression as text: names sorted, then bracketed groups in a fixed order, equal parts once.

    Work and result are in proportion to the expression, whatever its number of alternatives or its depth.
    """
    stack: list[str | _Joined] = []
    for item in expression:
        if item not in _RANK:
            stack.append(item)
            continue
        right, left = stack.pop(), stack.pop()
        if item == "with":
            if not isinstance(left, str) or not isinstance(right, str) or " " in left or " " in right:
                raise BadExpression("with joins one licence and one exception")
            stack.append(f"{left} with {right}")
            continue
        # Parts of the same operator flow together, the shorter into the longer.
        alike = sorted((p for p in (left, right) if isinstance(p, _Joined) and p.operator == item), key=_Joined.size, reverse=True)
        whole = alike[0] if alike else _Joined(item)
        for part in (left, right):
            if part is not whole:
                whole.take(part if part in alike else _Joined(item, part))
        only = [*whole.names, *whole.groups.values()] if whole.size() == 1 else [whole]
        stack.append(only[0])
    out, waiting = [], [stack[0]]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        inner: list[str | _Joined] = []
        for name in sorted(part.names):
            inner += [f" {part.operator} ", name]
        for key in sorted(part.groups):
            inner += [f" {part.operator} ", "(", part.groups[key], ")"]
        waiting += reversed(inner[1:])
    return "".join(out)


def expression_at(text: str) -> list[str]:
    """Postfix form of the longest well-formed expression at the start of ``text``; empty if there is none."""
    items = tokens(text)
    # Prose may follow on the line: an operand directly after an operand ends the expression.
    end, operand = 0, False
    for item in items:
        is_name = item not in "()" and item.lower() not in _RANK
        if operand and (is_name or item == "("):
            # Prose: what a small and, or, with before it joins is prose too.
            if end > 1 and items[end - 2] in _RANK:
                end -= 2
            break
        operand = is_name or item == ")"
        end += 1
    complete = _complete(items[:end])
    return postfix(items[:complete]) if complete else []


def _complete(items: list[str]) -> int:
    """Length of the longest start of ``items`` that is an expression: operands and operators take turns and brackets are closed."""
    best, depth, operand = 0, 0, False
    for at, item in enumerate(items, 1):
        opens, joins = item == "(", item == ")" or item.lower() in _RANK
        if operand != joins or (item == ")" and not depth):
            break
        depth += opens - (item == ")")
        operand = not opens and item.lower() not in _RANK
        if operand and not depth:
            best = at
    return best


def label_of(identifier: str) -> str:
    """The label of an identifier: its exception and the ending of ``-only`` and ``-or-later`` are left off."""
    name = identifier.split(" with ")[0].rstrip("+")
    for ending in ("-only", "-or-later"):
        name = name.removesuffix(ending)
    return {"apache-2.0": "apache-2", "apache-2": "apache-2"}.get(name, name.removesuffix(".0"))


class Scanner:
    """Scans texts with one automaton of base phrases, notice phrases and the identifier tag."""

    def __init__(self):
        patterns: dict[str, list] = {}
        for phrase, label in BASE_PHRASES.items():
            patterns.setdefault(f" {phrase} ", []).append(("base", label, BASE_SURE, len(phrase.split())))
        for phrase, (label, sure) in NOTICE_PHRASES.items():
            patterns.setdefault(f" {phrase} ", []).append(("notice", label, sure, len(phrase.split())))
        patterns[f" {TAG} "] = [("tag", None, TAG_SURE, 3)]
        self.automaton = matching.automaton(patterns)

    def scan(self, text: str | None) -> dict:
        n_words, line = matching.spaced(text)
        base, labels, miss, tagged = [], set(), 1.0, False
        base_labels, expressions = set(), []
        for start, _, values in matching.places(self.automaton, line):
            for kind, label, sure, _ in values:
                if kind == "tag":
                    tagged = True
                    continue
                if kind == "base":
                    base.append(line.count(" ", 0, start + 1) - 1)
                    base_labels.add(label)
                labels.add(label)
                miss = min(miss, 1.0 - sure)
        if tagged:
            for m in _TAG.finditer(text):
                parsed = expression_at(m.group(1))
                names = [x for x in parsed if x not in _RANK]
                if not names:
                    continue
                with suppress(BadExpression):
                    expressions.append(normal_form(parsed))
                labels.update(label_of(x) for i, x in enumerate(parsed) if x not in _RANK and not (i + 1 < len(parsed) and parsed[i + 1] == "with"))
                miss = min(miss, 1.0 - TAG_SURE)
        return {
            "n_words": n_words,
            "n_base": len(base),
            "first_word": min(base, default=None),
            "last_word": max(base, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels | base_labels)),
            "score": 1.0 - miss,
            "expressions": expressions,
        }


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: base places, labels, a score (the surest notice found, else 0) and the expressions in normal form.

    Null and empty texts have no words and no labels. Malformed expressions give no label. Repeated rows and null keys
    are scanned like any other row; other columns are not read, so their names cannot clash.
    """
    bounded_batches(docs.sparkSession)

    def scanned(batches):
        scanner = Scanner()
        for batch in batches:
            rows = pd.DataFrame([scanner.scan(t) for t in batch["t"]], columns=[c.split()[0] for c in RESULT.split(", ")])
            for c in ("first_word", "last_word"):
                rows[c] = rows[c].astype("Int64")
            rows.insert(0, "k", batch["k"].to_numpy())
            yield rows

    given = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    found = given.mapInPandas(scanned, f"k {given.schema['k'].dataType.simpleString()}, {RESULT}")
    return found.withColumnRenamed("k", key)
