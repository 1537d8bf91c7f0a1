"""Spans, patterns made of phrase lists, and windows of text around a place."""

from __future__ import annotations

import re
from typing import NamedTuple

from textloom.rules import lexicon as L


class Span(NamedTuple):
    start: int
    end: int
    type: str
    confidence: float
    reason: str


_MARKS = {"~": "[а-яё]*", " ": r"[ \t]+", "ё": "[её]", "—": "[—–-]"}


def alt(phrases: str) -> str:
    """Alternation of the phrases of a lexicon entry, longest first."""
    items = sorted(set(phrases.split("|")), key=lambda p: (-len(p), p))
    return "(?:" + "|".join("".join(_MARKS.get(c, re.escape(c)) for c in p) for p in items) + ")"


def word(phrases: str) -> str:
    """The phrases as whole words; one that ends in a dot may be followed by anything."""
    dotted = "|".join(p for p in phrases.split("|") if p.endswith("."))
    plain = "|".join(p for p in phrases.split("|") if not p.endswith("."))
    parts = ([rf"{alt(dotted)}"] if dotted else []) + ([rf"{alt(plain)}(?!\w)"] if plain else [])
    return rf"(?<!\w)(?:{'|'.join(parts)})"


def rx(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.IGNORECASE)


class Cues:
    """Kinds of cue words; of those before a place the last one counts."""

    def __init__(self, **kinds: str):
        self.pattern = rx("|".join(f"(?P<{k}>{word(v)})" for k, v in kinds.items()))

    def last(self, window: str) -> re.Match | None:
        found = None
        for found in self.pattern.finditer(window):
            pass
        return found

    def kind(self, window: str) -> str | None:
        found = self.last(window)
        return found.lastgroup if found else None


def before(text: str, start: int, width: int, stops: str = ";\n!?") -> str:
    """At most `width` characters before start, back to the last character of stops."""
    window = text[max(0, start - width) : start]
    return window[max(window.rfind(c) for c in stops) + 1 :]


_BREAK = re.compile(r"[!?;]|\n[ \t]*\n|\.(?=\s|$)")
_LAST_WORD = re.compile(r"(?:^|[^\w-])([\w-]+)$")
_ABBREVIATIONS = frozenset(L.ABBREVIATIONS)


def abbreviated(text: str, dot: int) -> bool:
    """Whether the dot belongs to an abbreviation."""
    last = _LAST_WORD.search(text[max(0, dot - 10) : dot])
    return bool(last) and last[1].lower() in _ABBREVIATIONS


def record(text: str, start: int, width: int, semicolon: bool = False) -> str:
    """At most `width` characters before start, from the last end of a sentence or paragraph (or semicolon)."""
    window, at = text[max(0, start - width) : start], 0
    for b in _BREAK.finditer(window):
        if (b[0] != ";" or semicolon) and not (b[0] == "." and abbreviated(window, b.start())):
            at = b.end()
    return window[at:]


def trimmed(text: str, start: int, end: int, left: str = " \t\r\n", right: str = " \t\r\n.,;:") -> tuple[int, int]:
    while start < end and text[start] in left:
        start += 1
    while end > start and text[end - 1] in right:
        end -= 1
    return start, end


def blocks(*sizes: int, between: str = "[ \t]*") -> str:
    """Pattern of groups of so many digits each."""
    return between.join(f"[0-9]{{{n}}}" for n in sizes)


def digits(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")
