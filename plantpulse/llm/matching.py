"""Words as the contracts define them, and matching of word sequences with an Aho-Corasick automaton."""

from __future__ import annotations

import re

import ahocorasick

LOWER = {c: c + 32 for c in range(65, 91)}
# Letters and digits of ASCII, after A-Z are lower-cased, and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# The same on UTF-8: bytes of characters beyond ASCII are all beyond 0x7F, and bytes lower-case A-Z only.
_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def spaced(text: str | None) -> tuple[int, str]:
    """The number of words, and the words with a space before and after each."""
    found = _BYTES.findall(text.encode("utf-8").lower()) if text else []
    return len(found), f" {b' '.join(found).decode('utf-8')} "


def automaton(patterns: dict[str, object]) -> ahocorasick.Automaton:
    """An automaton of the patterns; a match yields (last place, (pattern, value))."""
    built = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        built.add_word(pattern, (pattern, value))
    if patterns:
        built.make_automaton()
    return built


def places(built: ahocorasick.Automaton, text: str) -> list[tuple[int, int, object]]:
    """(start, end, value) of every occurrence in ``text``, overlapping ones included."""
    if not len(built):
        return []
    return [(last + 1 - len(pattern), last + 1, value) for last, (pattern, value) in built.iter(text)]
