"""Candidates dropped, cut or split by what stands around them, before overlaps are resolved."""

from __future__ import annotations

import re
from collections.abc import Iterable

from textloom.rules import lexicon as L
from textloom.rules.places import issuer_end
from textloom.rules.scan import Cues, Span, alt, digits, record, rx, trimmed, word

_OWNER = Cues(corporate=L.CORPORATE, private=L.PRIVATE)
_INN_LABEL = rx(r"(?<!\w)инн(?:\s*/\s*кпп)?\s*[:=—-]?\s*$")
_AFTER, _BEFORE = re.compile(r"[.,]([0-9]{1,13})(?![0-9])"), re.compile(r"(?<![0-9])([0-9]{1,13})[.,]$")
_DECIMAL, _FLOAT = re.compile(r"[+]?[0-9]{8,15}[.,][0-9]{1,8}"), re.compile(r"([+]?[0-9]{7,15})[.,]0+")
_OFFICE, _PERSONAL = rx(word(L.OFFICES)), rx(word(L.PERSONAL_CONTEXT))
_STATE_OF, _ADDRESS_OF = rx(r"(?<!\w)(?:паспорт|гражданин|гражданка)[ \t]+$"), rx(r"(?<!\w)адрес[а-яё]*[ \t]*[:=—-]?[ \t]*(?:г[.][ \t]*)?$")


def _corporate(prior: str) -> bool:
    return _OWNER.kind(prior) == "corporate"


def _neighbours(text: str, s: Span) -> tuple[str, str]:
    """Digits that a comma or dot ties to the value, before and after it."""
    a, b = _BEFORE.search(text[max(0, s.start - 15) : s.start]), _AFTER.match(text[s.end : s.end + 15])
    return (a[1] if a else "", b[1] if b else "")


def _firm_or_fraction(text: str, s: Span, context: bool) -> bool:
    if len(digits(text[s.start : s.end])) == 10 and s.reason != "cis-personal-id":
        prior = record(text, s.start, 160, semicolon=True)
        if _INN_LABEL.search(prior) and _corporate(prior):
            return True
    return s.reason in ("checksum", "ner-structured") and any(n and len(n) not in (10, 12) for n in _neighbours(text, s))


def _decimal(text: str, s: Span, context: bool) -> bool:
    value = text[s.start : s.end]
    if _DECIMAL.fullmatch(value) and not _FLOAT.fullmatch(value):
        return True
    ahead, behind = _neighbours(text, s)
    return bool(ahead) and not 7 <= len(ahead) <= 13 or bool(behind.strip("0")) and not 7 <= len(behind) <= 13


def _no_home(text: str, s: Span, context: bool) -> bool:
    prior = record(text, s.start, 160, semicolon=True)
    if _OFFICE.search(prior) and not context:
        return True
    if text[s.start : s.end].lower() in ("рф", "россии") and _STATE_OF.search(prior):
        return True
    return bool(_ADDRESS_OF.search(prior)) and _corporate(prior)


_DROPS = {"INN": _firm_or_fraction, "PHONE": _decimal, "CITY": _no_home, "LOCATION": _no_home}


def _piece(text: str, s: Span, start: int, end: int) -> list[Span]:
    start, end = trimmed(text, start, end)
    return [s._replace(start=start, end=end)] if start < end else []


_NUMBER = rx(r"(?:(?<!\w)номер(?!\w)|(?<!\w)ном[.]?(?!\w)|№)\s*[:№=—-]?\s*")
_DIGITS = re.compile(r"[0-9](?:[0-9 \t]*[0-9])?")


def _document(text: str, s: Span) -> list[Span]:
    """Series and number apart, without the words between them."""
    m = _NUMBER.search(text, s.start, s.end)
    if not m or not all(_DIGITS.fullmatch(x) for x in (text[s.start : m.start()].strip(" \t\r\n,;"), text[m.end() : s.end].strip())):
        return [s]
    return _piece(text, s, s.start, m.start()) + _piece(text, s, m.end(), s.end)


_MISSING, _PROSE = rx(alt(L.MISSING) + r"(?!\w)"), rx(rf"(?<![\w-])(?:{alt(L.PROSE)}(?!\w)|назначение(?=\s*:))")


def _name(text: str, s: Span) -> list[Span]:
    """Without the deed told after it; a holder that is missing is none."""
    holder = s.type == "CARDHOLDER"
    if holder and _MISSING.match(text, s.start):
        return []
    m = _PROSE.search(text, s.start, min(len(text), s.end + 1))
    if not m or m.start() >= s.end or (m.start() == s.start and not holder):
        return [s]
    return _piece(text, s, s.start, m.start())


def _phone(text: str, s: Span) -> list[Span]:
    m = _FLOAT.fullmatch(text[s.start : s.end])
    return [s._replace(end=s.start + m.end(1))] if m else [s]


_AT, _LISTED = rx(r"\s*по\s+адресу\s*[:=—-]?\s*"), re.compile(r"\s*[0-9]+[.)]\s*")
_SCAFFOLD, _LOCAL = rx("|".join(map(re.escape, L.FIELD_SCAFFOLD))), rx(word("г.|ул.|д.|кв.|пос.|город|улица|дом"))
_PLACE_PROSE, _SECOND = rx(rf"(?<![\w-]){alt(L.PLACE_PROSE)}(?!\w)"), rx(rf"(?:[.]\s*|,\s*){alt(L.SECOND_ADDRESS)}\s*[:=—-]?\s*")


def _place(text: str, s: Span) -> list[Span]:
    """Without the rest of a label, a number in a list and prose; two addresses apart."""
    start, end = s.start, s.end
    lead = _AT.match(text, start, end)
    colon = text.find(":", start, min(end, start + 100))
    if lead:
        start = lead.end()
    elif colon >= 0 and _SCAFFOLD.search(text, start, colon) and not _LOCAL.search(text, start, colon):
        start = colon + 1
    listed = _LISTED.match(text, start, end)
    start = listed.end() if listed else start
    prose = _PLACE_PROSE.search(text, start, end)
    end = prose.start() if prose else end
    out = []
    for cut in _SECOND.finditer(text, start, end) if s.type == "ADDRESS" else ():
        out += _piece(text, s, start, cut.start())
        start = cut.end()
    return out + _piece(text, s, start, end)


_FORMS = {
    "PASSPORT": _document, "DRIVER_LICENSE": _document, "ADDRESS": _place, "BIRTH_PLACE": _place, "PERSON": _name, "CARDHOLDER": _name, "PHONE": _phone,
    "PASSPORT_ISSUER": lambda t, s: _piece(t, s, s.start, issuer_end(t, s.start, s.end)),
}


def refine(text: str, candidates: Iterable[Span]) -> list[Span]:
    """Candidates that stay, cut to what they mean; tenants' own spans pass as they are."""
    candidates, out = list(candidates), []
    context = any(s.type in ("CITY", "LOCATION") for s in candidates) and bool(_PERSONAL.search(text))
    for s in candidates:
        if s.reason == "custom-rule":
            out.append(s)
        elif not (s.type in _DROPS and _DROPS[s.type](text, s, context)):
            out += _FORMS[s.type](text, s) if s.type in _FORMS else [s]
    return out
