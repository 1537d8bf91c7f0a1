"""Whose a number is: series and numbers of passports and licences by the last owner named before them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from textloom.rules import lexicon as L
from textloom.rules.scan import Cues, Span, abbreviated, alt, blocks, record, rx, word

_OWNERS = Cues(**L.NUMBER_OWNERS)
_KINDS = {"license": "DRIVER_LICENSE", "driver_card": "DRIVER_LICENSE", "passport": "PASSPORT"}
_BREAKS = re.compile(r"[!?;.]|\r?\n(?:[ \t]*\r?\n)*")
_WORDS = re.compile(r"[^\W\d_]+")
_SWITCH = rx(word(L.RECORD_SWITCH))
_FOR_PURPOSE = rx(rf"{word(L.PURPOSE)}[ \t]+(?:[а-яё-]+[ \t]+){{1,5}}$")
_REQUESTED = rx(rf"[ \t]+{alt(L.REQUESTED)}[ \t]+(?:следующие[ \t]+)?(?:данные|реквизиты)[ \t]*[:=—–-][ \t(]*$")
_TO_DEVICE = rx(r"(?<!\w)(?:для|к)[ \t]+(?:цифров[а-яё]*[ \t]+)?тахограф[а-яё]*[ ,:—–-]*$")
_PURPOSE_ONLY = rx(r"[ \t]+(?:для|при)[ \t]+[а-яё \t-]{1,72}$")
_CLAUSE, _INTRODUCTION, _SHOWING = frozenset(L.CLAUSE_WORDS), frozenset(L.FIELD_WORDS), frozenset(L.SHOWING_WORDS)


def _clauses(tail: str) -> list[tuple[str, str]]:
    """The text between an owner and a number as (clause, break that ends it); dots of numbers and abbreviations end none."""
    out, at = [], 0
    for b in _BREAKS.finditer(tail):
        after = tail[b.end() :].lstrip(" \t")
        if b[0] == "." and (abbreviated(tail, b.start()) or (tail[: b.start()][-1:].isdigit() and after[:1].isdigit())):
            continue
        out.append((tail[at : b.start()], b[0]))
        at = b.end()
    return [*out, (tail[at:], "")]


def _only(clause: str, words: frozenset[str]) -> bool:
    return all(w.lower() in words for w in _WORDS.findall(clause))


def _carries(tail: str, labelled: bool, personal: bool) -> bool:
    """Whether the owner still owns what follows its tail: in the same sentence, or in the next one if that only introduces a value."""
    clauses = _clauses(tail)
    if _SWITCH.search(tail):
        return False
    if len(clauses) == 1:
        return True
    first, last, ends = clauses[0][0], clauses[-1][0], [b for _, b in clauses[:-1]]
    if any(b in "!?" or b.count("\n") > 1 for b in ends) or any(c.strip() for c, _ in clauses[1:-1]):
        return False
    shown = last.rstrip()[-1:] in (":", "=", "—", "–", "-") and bool(_WORDS.search(last)) and _only(last, _SHOWING)
    if personal and shown and (_only(first, _CLAUSE) or _PURPOSE_ONLY.fullmatch(first)):
        return True
    return labelled and _only(first, _CLAUSE) and _only(last, _INTRODUCTION)


_OWN_LABEL = rx(rf"{word('серия|серии|серией|сер.|номер|номером|ном.')}[ \t]*[:=—–-]?[ \t]*$|№[ \t]*[:=—–-]?[ \t]*$")


def number_owner(text: str, start: int, labelled: bool = False) -> str | None:
    """PASSPORT, DRIVER_LICENSE or nothing for the number at start; labelled (series and number) ones are passports by default."""
    if labelled:
        label = _OWN_LABEL.search(text, max(0, start - 24), start)
        start = label.start() if label else start
    begin, default = max(0, start - 160), "PASSPORT" if labelled else None
    prior, owner = text[begin:start], None
    for m in _OWNERS.pattern.finditer(prior):
        cut = m.start() == 0 and begin and (text[begin - 1].isalnum() or text[begin - 1] == "_")
        asked = m.lastgroup == "business" and _FOR_PURPOSE.search(prior[: m.start()]) and _REQUESTED.search(prior[m.end() :])
        if not cut and not asked:
            owner = m
    if owner is None:
        return default
    kind = owner.lastgroup
    if kind == "identity" and re.match(r"[ \t]*[:=]", prior[owner.end() :]) and " " not in owner[0]:
        kind = "license"
    if not _carries(prior[owner.end() :], labelled, kind not in ("business", "other_card")):
        return default
    if kind == "driver_card" and _TO_DEVICE.search(prior[max(0, owner.start() - 48) : owner.start()]):
        return None
    return default if kind == "identity" else _KINDS.get(kind)


_RECORDS = Cues(passport="паспорт|паспорта|паспорту|паспортом|паспорте", license=L.LICENSE, other=L.ISSUED_OTHER)
_ISSUE_FIELD = rx(rf"{word('дата выдачи|дата выдачи паспорта')}[ \t]*[:=—-]?[ \t]*$")


def passport_record(text: str, start: int) -> bool:
    """Whether the record before start is that of a passport."""
    prior = record(text, start, 180)
    kind = _RECORDS.kind(prior)
    if kind:
        return kind == "passport"
    return bool(_ISSUE_FIELD.search(prior)) and _RECORDS.kind(text[max(0, start - 180) : start]) != "license"


_BUSINESS_TAIL = rx(rf"[ \t]+{alt(L.BUSINESS_TAIL)}(?!\w)")
_MARK, _APART = r"[ \t]*[:=—–-]?[ \t]*", "[ \t/-]"
_GROUPED = rx(rf"(?<![\w./-])(?P<value>{blocks(4, 6, between=_APART)}|{blocks(2, 2, 6, between=_APART)})(?!\w|[./-][0-9]|[ \t]+[0-9])")


def _either(series: str, number: str, four: str, sign: str = "") -> re.Pattern[str]:
    """A labelled series of four digits or a labelled number of six."""
    return rx(rf"(?:{word(series)}{_MARK}(?P<series>{four})|(?:{word(number)}{sign}){_MARK}(?P<number>{blocks(6)}))(?!\w)")


_PART = _either("серия|серии|серией|сер.", "номер|номером|ном.", blocks(2, 2, between="[ \t]?"), "|№")
_JOIN = rx(r"[ \t,;./—–-]*(?:\r?\n[ \t]*)?(?:и[ \t]+)?")


def _grouped(text: str) -> Iterator[Span]:
    for m in _GROUPED.finditer(text):
        kind = number_owner(text, m.start())
        if kind and not _BUSINESS_TAIL.match(text, m.end()):
            yield Span(*m.span("value"), kind, 0.91, "grouped-personal-document-format")


def _paired(text: str) -> Iterator[Span]:
    parts = list(_PART.finditer(text))
    for a, b in zip(parts, parts[1:]):
        apart = b.start() - a.end() > 48 or a.lastgroup == b.lastgroup or not _JOIN.fullmatch(text[a.end() : b.start()])
        if apart or _BUSINESS_TAIL.match(text, b.end()):
            continue
        kind = number_owner(text, a.start(), labelled=True)
        for m in (a, b) if kind else ():
            yield Span(*m.span(m.lastgroup), kind, 0.94, "paired-personal-document-parts")


_LICENSE = word(L.LICENSE)
_LABEL = rx(rf"(?P<license>{_LICENSE})|(?P<passport>{word('паспорт|паспорта')})")
_HOLDER = rx(rf"(?:[ \t]+{alt(L.DOCUMENT_HOLDERS)}(?!\w)){{0,2}}[ \t]*(?:[:,=—–-][ \t]*)?(?:№[ \t]*)?")
_SIX = rf"[ \t-]+{blocks(6)}"
_VALUE = rx(rf"(?P<value>(?:{blocks(2, 2)}|{blocks(2)}[ \t]+[а-яёa-z]{{2}}){_SIX})(?!\w)")
_SUFFIXED = rx(rf"(?<!\w)(?P<value>{blocks(2, 2)}{_SIX})(?!\w)[ \t]+[—–-][ \t]*{_LICENSE}")
_FIELD = _either("серия|серии", "номер|номером", blocks(2, 2))
_STOP = rx(rf"[.!?;\n]|{word(L.DOCUMENT_STOPS)}")
_NOT_PERSONAL = rx(f"{word(L.NONPERSONAL)}|{word(L.DATE_OTHER.replace('|дата|релиз~|срок~', ''))}")


def _labelled(text: str) -> Iterator[Span]:
    for label in _LABEL.finditer(text):
        kind, limit = ("DRIVER_LICENSE" if label["license"] else "PASSPORT"), min(len(text), label.end() + 180)
        first = re.search("[0-9]", text[label.end() : label.end() + 80])
        about = text[label.end() : label.end() + (first.start() if first else 80)]
        part = _FIELD.search(text, label.end(), limit)
        if part:
            about = about[: part.start() - label.end()]
        if _NOT_PERSONAL.search(about):
            continue
        value = _VALUE.match(text, _HOLDER.match(text, label.end()).end())
        if value and value.end() <= limit:
            yield Span(*value.span("value"), kind, 0.99, "explicit-personal-document-field")
        stop = _STOP.search(text, label.end(), limit)
        for m in _FIELD.finditer(text, label.end(), stop.start() if stop else limit):
            if not (m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_")):
                yield Span(*m.span(m.lastgroup), kind, 0.99, "explicit-personal-document-part")
    for m in _SUFFIXED.finditer(text):
        yield Span(*m.span("value"), "DRIVER_LICENSE", 0.99, "explicit-license-suffix")


def document_spans(text: str, lower: str) -> Iterator[Span]:
    """Numbers of documents; of equal places and types the first counts."""
    found: dict[tuple, Span] = {}
    named = any(h in lower for h in ("паспорт", "удостоверен", "ву", "в/у", "в у"))
    paired = "сер" in lower and ("ном" in lower or "№" in text)
    for s in (*(_labelled(text) if named else ()), *_grouped(text), *(_paired(text) if paired else ())):
        found.setdefault(s[:3], s)
    yield from found.values()
