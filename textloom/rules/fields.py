"""Labelled and bare values as rows of a table: which labels or shapes, which value, which check."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from textloom.rules import lexicon as L, values as V
from textloom.rules.documents import number_owner, passport_record
from textloom.rules.places import issuer_end, public_place
from textloom.rules.scan import Cues, Span, alt, before, blocks, digits, record, rx, trimmed, word

#: What may stand between a label and its value, and what may enclose the value.
GAP = r"[ \t]*(?:[:=№#—–-][ \t]*){0,3}"
OPEN = GAP + r"[«\"'“(]?[ \t]*"
NUMBERED = rf"{GAP}(?:(?:номер|№|no[.]?)[ \t]*)?{GAP}"
_BLANKS = "[ \t]*"
_SPACED = r"[ \t]{0,8}"


class Field(NamedTuple):
    type: str
    pattern: re.Pattern
    reason: str
    confidence: float
    hints: tuple[str, ...]
    check: Callable[[str, int, int], bool] | None
    #: What the text must hold besides one of the hints.
    also: str = ""


def _hints(labels: str) -> tuple[str, ...]:
    """What a lower-cased text must hold for one of the labels to occur: the first word, as far as it is always spelt alike."""
    first = (re.split(r"[ ~ё/—-]", p)[0] for p in labels.split("|"))
    return tuple(sorted({h for h in first if h}))


def labelled(kind: str, labels: str, value: str, check=None, *, reason: str = "context", confidence: float = 0.98, gap: str = GAP, end: str = "(?![0-9])", start: str = "") -> Field:
    """A value right after one of the labels."""
    return Field(kind, rx(rf"(?<!\w){alt(labels)}(?![^\W\d_]){start}{gap}(?P<value>{value}){end}"), reason, confidence, _hints(labels), check)


def bare(kind: str, value: str, reason: str, confidence: float, check=None, *, hints: tuple[str, ...] = (), left: str = r"(?<!\w)", right: str = r"(?!\w)") -> Field:
    """A value without a label."""
    return Field(kind, rx(rf"{left}(?P<value>{value}){right}"), reason, confidence, hints, check)


def many(low: int, high: int, between: str) -> str:
    """low to high digits with `between` allowed between them."""
    return rf"[0-9](?:{between}[0-9]){{{low - 1},{high - 1}}}"


# --- checks -------------------------------------------------------------------------------------------------------
_ORDER = rx(rf"{word(L.ORDER_NUMBERS)}[ \t]*(?:[:=№#—-][ \t]*){{0,2}}$")
_OWN = rx(rf"{word(L.OWN_NUMBERS)}[^.;,\n\d:]{{0,48}}[ \t]*(?:[:=№#—-][ \t]*){{0,2}}$")


def own_number(text: str, start: int, end: int = 0) -> bool:
    """Not the value of an order, ticket or article field."""
    prior = record(text, start, 96)
    return bool(_OWN.search(prior)) or not _ORDER.search(prior)


_FIRM_INN = rx(rf"(?<!\w)инн[ \t]+{alt(L.PUBLIC_INN)}(?:[ \t]+[а-яёa-z«»\"-]{{1,35}}){{0,3}}[ \t]*[:=—-]?[ \t]*$")
_PERSON = Cues(private=L.PRIVATE)


def private_inn(text: str, start: int, end: int) -> bool:
    """Not the ten digits of a firm."""
    if end - start != 10:
        return True
    label = _FIRM_INN.search(text[max(0, start - 120) : start])
    return not label or bool(_PERSON.last(label[0]))


_RECORD = Cues(private=L.PERSONAL_RECORD, public=L.PUBLIC_RECORD)


def private_record(text: str, start: int, end: int = 0) -> bool:
    """Not a date or place of a public person."""
    kinds = {m.lastgroup for m in _RECORD.pattern.finditer(before(text, start, 160))}
    return "public" not in kinds or "private" in kinds


def _all(*checks) -> Callable[[str, int, int], bool]:
    return lambda t, s, e: all(c(t, s, e) for c in checks)


def _of(test: Callable[[str], bool]) -> Callable[[str, int, int], bool]:
    return lambda t, s, e: test(t[s:e])


def _count(low: int, high: int):
    return _of(lambda v: low <= len(digits(v)) <= high)


def _home(text: str, start: int, end: int) -> bool:
    return not public_place(text, start)


# --- fixed values: the shapes of values -------------------------------------------------------------------------------------------------------
_ATOM, _LABEL = r"[a-zа-яё0-9.!#$%&'*+/=?^_`{|}~-]", r"[a-zа-яё0-9](?:[a-zа-яё0-9-]{0,61}[a-zа-яё0-9])?"
_EMAIL = rf"{_ATOM}{{1,64}}@{_LABEL}(?:[.]{_LABEL}){{1,8}}"
_IP4 = rf"[0-9]{{1,3}}(?:{_SPACED}[.]{_SPACED}[0-9]{{1,3}}){{3}}"
_HEX = rf"{_SPACED}:{_SPACED}[0-9a-f]{{0,4}}"
_IP6 = rf"(?:[0-9a-f]{{1,4}}(?:{_HEX}){{2,8}}|:{_SPACED}:{_SPACED}[0-9a-f]{{0,4}}(?:{_HEX}){{0,7}})"
_PHONE_GAP = r"[ \t.-]*"
_AREA = rf"(?:[(]{_BLANKS}[0-9]{{3}}{_BLANKS}[)]|[0-9]{{3}})"
_PHONE = rf"(?:[+]7|8|7){_PHONE_GAP}{_AREA}{_PHONE_GAP}{blocks(3, 2, 2, between=_PHONE_GAP)}"
PHONE = rx(_PHONE)
_SERIES_LABEL, _NUMBER_LABEL = r"(?:(?:серия|сер[.])\s*)?", r"(?:(?:номер|ном[.]?|№)[ \t]*)?"
_FOREIGN = r"(?:[IVXLCІVХ]{1,8}[- ]?[А-ЯЁA-Z]{2}[ \t№-]*[0-9]{6}|[0-9]{2}[ \t№-]*[0-9]{7}|[A-ZА-ЯЁ]{1,3}[ \t-]*[0-9]{6,9}|[0-9]{7,12})"
_INNER = r"(?:(?:серия|номер|№)\s*)?"
_HOUSE = rf"[0-9]{{1,4}}(?:[/-][0-9]{{1,4}})?[а-яёa-z]?(?:\s*{alt(L.BUILDING)}\s*[0-9]{{1,3}}[а-яёa-z]?)?"
_WORD = r"[а-яё][а-яё'-]{0,39}"
_STREET_NAME = rf"(?:[0-9]{{1,3}}[- ]?)?{_WORD}(?:[ \t]+{_WORD}){{0,2}}?"
_STREET_END = rf"(?=\s*(?:[,;.\n!?]|$|{word('дом|д.|кв.|квартира|корпус|корп.')}|[0-9]))"
_WHOLE_DATE = rx(V.FULL_DATE)
_NEXT = rf"(?=\s*(?:[,;\n]|$|{word(L.NEXT_FIELD)}))"

ADDRESS_FIELDS = (
    labelled("CITY", L.CITY, rf"{_WORD}(?:-{_WORD})?", _home, end=r"(?!\w)", start=r"(?![ \t]*о[.])"),
    labelled("STREET", L.STREET, _STREET_NAME, _home, end=_STREET_END),
    labelled("HOUSE", L.HOUSE, _HOUSE, _home, end=r"(?!\w)"),
    labelled("APARTMENT", L.APARTMENT, "[0-9]{1,5}[а-яёa-z]?", _home, end=r"(?!\w)"),
)


def _regional(kind: str, labels: str, country: str, value: str, optional: bool) -> Field:
    state, label = alt(L.COUNTRIES[country]), alt(labels)
    after = rf"(?:[ \t]+(?:гражданина[ \t]+)?{state}|[ \t]*[(][ \t]*{state}[ \t]*[)])" + "?" * optional
    ahead = rf"{state}[ \t]*(?:[,;:/—-][ \t]*|[ \t]+|\n[ \t]*){label}"
    pattern = rx(rf"(?<!\w)(?:{label}{after}|{ahead})(?![^\W\d_]){NUMBERED}(?P<value>{value})(?!\w)")
    return Field(kind, pattern, "cis-personal-id" if kind == "INN" else "cis-document-context", 0.98, _hints(labels), None)


CONTACTS = (
    bare("EMAIL", _EMAIL, "format", 0.995, hints=("@",), left=r"(?<![\w.+-])", right=r"(?![\w@-])"),
    *(_regional(*row) for row in L.REGIONAL),
)
NUMBERS = (
    bare("IP_ADDRESS", _IP4, "ip-address-format", 0.99, _of(V.network_address), hints=(".",), left=r"(?<![\w.])", right=rf"(?!\w|[.][0-9]|{_SPACED}[.]{_SPACED}[0-9])"),
    bare("IP_ADDRESS", _IP6, "ip-address-format", 0.99, _of(V.network_address), hints=(":",), left=r"(?<![\w:])", right=rf"(?!\w|{_SPACED}:)"),
    bare("PHONE", _PHONE, "russian-phone-format", 0.98, own_number, right="(?![0-9])"),
    bare("PHONE", rf"[+][1-9][0-9]{{0,2}}(?:[ \t().-]*[0-9]){{7,13}}", "international-phone-format", 0.98, _all(_count(8, 15), own_number), hints=("+",), right="(?![0-9])"),
    labelled("PHONE", L.PHONE, r"[+]?[0-9(][0-9() .-]{7,24}[0-9]", _count(7, 15)),
    labelled("SNILS", L.SNILS, many(11, 11, r"[ \t:._/|–—-]{0,8}"), reason="explicit-snils-field", confidence=0.99, gap=NUMBERED, end=r"(?![0-9]|[ \t:._/|–—-]+[0-9])"),
    labelled("PASSPORT", L.PASSPORT, rf"{blocks(2, 2)}[ \t,-]*{_NUMBER_LABEL}[0-9]{{6}}", lambda t, s, e: number_owner(t, s, labelled=True) == "PASSPORT", gap=GAP + _SERIES_LABEL + GAP),
    labelled("PASSPORT", "паспорт|паспорта|паспорт рф|паспорта рф", "[0-9]{10}"),
    labelled("DRIVER_LICENSE", L.LICENSE + "|права", rf"(?:[0-9]{{2}}[ \t]*[а-яёa-z]{{2}}|{blocks(2, 2)})[ \t,-]*(?:(?:номер|№)\s*)?[0-9]{{6}}", gap=GAP + r"(?:серия\s*)?"),
    labelled("FOREIGN_DOCUMENT", L.FOREIGN, _FOREIGN, gap=GAP + _INNER, end=r"(?!\w)"),
    labelled("BIRTH_CERTIFICATE", L.BIRTH_CERTIFICATE, _FOREIGN, gap=GAP + _INNER, end=r"(?!\w)"),
    labelled("DEPARTMENT_CODE", L.DEPARTMENT, blocks(3, 3, between="[ -]")),
    labelled("DEPARTMENT_CODE", "код подразделения|к/п|к п", blocks(3, 3, between="[ \t-]"), reason="explicit-department-field", confidence=0.99, gap=rf"[ \t]*(?:{alt(L.DEPARTMENT_SAID)}[ \t]*)?{GAP}", end=r"(?!\w|[ \t-][0-9])"),
    labelled("INN", L.INN, rf"{blocks(4, 4, 4, between='[ \t]+')}|[0-9]{{12}}|[0-9]{{10}}", private_inn, start=rf"(?:[ \t]+{alt(L.INN_OWNERS)})?(?:[ \t]+банка)?"),
    bare("INN", "[0-9]{12}|[0-9]{10}", "checksum", 0.94, _all(_of(V.inn), private_inn, own_number)),
    labelled("CARD", L.CARD, many(13, 19, "[ \t-]*"), reason="explicit-card-context"),
    labelled("CARD", L.CARD_END, "[0-9]{4}", reason="explicit-card-suffix", end=r"(?!\w)"),
    labelled("CARD", L.BANK_CARD, many(13, 19, "[ \t-]*"), reason="explicit-payment-security-field", confidence=0.99, gap=OPEN, end=r"(?!\w|[ \t-]*[0-9])"),
    bare("CARD", r"[2-6][0-9]{2,3}(?:[ \t-]?[0-9]){9,15}", "luhn-checksum", 0.96, _all(_of(V.luhn), own_number)),
    labelled("CVV", L.CVV, "[0-9]{3,4}", start=rf"(?:[ -]*{alt('код|карты')})?"),
    labelled("CVV", L.CVV, "[0-9]{3,4}", reason="explicit-payment-security-field", confidence=0.99, gap=OPEN, end=r"(?!\w)", start=rf"(?:[ -]+кода?)?(?:[ \t]+{alt(L.ORDER_OF_CARD)})?(?:[ \t]+(?:указан[ \t]+)?код)?"),
    Field("CVV", rx(rf"(?<!\w)код[ \t]+(?P<value>[0-9]{{3,4}})(?!\w)[ \t]+(?:(?:неверно|ошибочно)[ \t]+)?(?:введ[её]н[ \t]+)?{alt(L.CVV)}(?!\w)"), "explicit-payment-security-field", 0.99, ("код",), None),
    labelled("CVV", L.CVV_BACK, "[0-9]{3,4}", reason="explicit-payment-security-field", confidence=0.99, gap=OPEN, end=r"(?!\w)"),
    labelled("PIN", L.PIN, "[0-9]{4,6}", start=r"(?:[ -]*код)?(?:[ \t]+карты)?"),
    labelled("PIN", L.PIN, "[0-9]{4,6}", reason="explicit-payment-security-field", confidence=0.99, gap=OPEN, end=r"(?!\w)", start=rf"(?:[ -]*(?:код|code))?(?:[ \t]+{alt(L.ORDER_OF_CARD)})?"),
    labelled("BIRTH_DATE", L.BIRTH_DATE, V.FULL_DATE, _all(_of(V.full_date), private_record)),
    Field("BIRTH_DATE", rx(rf"(?<![0-9])(?P<value>{V.FULL_DATE})(?:\s*г(?:ода|[.])?)?\s+{alt(L.BIRTH_DATE_TAIL)}(?!\w)"), "context", 0.98, ("рожд", "г.р", "г. р", "гр."), _all(_of(V.full_date), private_record)),
    labelled("PASSPORT_DATE", L.ISSUE_DATE, V.FULL_DATE, _all(_of(V.full_date), lambda t, s, e: passport_record(t, s))),
    Field("PASSPORT_DATE", rx(rf"(?<!\w){alt(L.ISSUED)}\s+[^\n;:]{{0,130}}?[, \t]+(?P<value>{V.FULL_DATE})(?![0-9])"), "context", 0.98, ("выдан",), _all(_of(V.full_date), lambda t, s, e: passport_record(t, s)), "паспорт"),
    labelled("POSTAL_CODE", L.INDEX, "[0-9]{6}", _home),
    bare("POSTAL_CODE", "[0-9]{6}", "address-format", 0.95, _all(_home, own_number), left="(?<![0-9])", right=r"(?=\s*[, ]\s*(?:г[.]|город|обл[.]|(?-i:[А-ЯЁ][а-яё-]+)))"),
    *ADDRESS_FIELDS[2:],
)
TEXTS = (
    labelled("BIRTH_PLACE", L.BIRTH_PLACE, r"[^;\n]{2,140}?", _all(_of(lambda v: bool(re.search("[а-яёА-ЯЁ]", v)) and not _WHOLE_DATE.fullmatch(v)), private_record), end=_NEXT),
    labelled("CITIZENSHIP", L.CITIZENSHIP, rf"(?:{alt(L.STATES)}|республик[аи]\s+{_WORD})", end=r"(?!\w)"),
    labelled("COUNTRY", L.COUNTRY, rf"{_WORD}(?:[ \t]+{_WORD}){{0,2}}?", _home, end=rf"(?=\s*(?:[,;.\n!?]|$|{word('город|индекс|адрес')}))"),
    *ADDRESS_FIELDS[:2],
)
_ENDS = {"ADDRESS": " \t,.!?", "BIRTH_PLACE": " \t,.!?", "PASSPORT_ISSUER": " \t,.!?"}


def matches(text: str, lower: str, fields: tuple[Field, ...]) -> Iterator[Span]:
    for f in fields:
        if f.also not in lower or (f.hints and not any(h in lower for h in f.hints)):
            continue
        for m in f.pattern.finditer(text):
            start, end = trimmed(text, *m.span("value"), left="", right=_ENDS.get(f.type, " \t,"))
            if start < end and (f.check is None or f.check(text, start, end)):
                yield Span(start, end, f.type, f.confidence, f.reason)


# --- labelled dates with an owner between label and value ------------------------------------------------------------
_DATE_LABEL = rx(rf"(?P<birth>{word(L.BIRTH_DATE_FIELD)})|(?P<issue>{word(L.ISSUE_DATE_FIELD)})")
_DATE_LEAD = rx(r"[ \tа-яё()—–-]{0,96}[:=][ \t]*|[ \t]*(?:[—–-][ \t]*)?")
_DATE_VALUE, _DATE_WORDS = rx(V.PARTIAL_DATE), rx(V.WRITTEN)
_DATE_OTHER = rx(word(L.DATE_OTHER))
_DATE_OWNER, _POET, _DATE_PRIVATE = rx(word(L.DATE_OWNER_PUBLIC)), rx(word(L.POET)), rx(word(L.DATE_OWNER_PRIVATE))


def labelled_dates(text: str) -> Iterator[Span]:
    for label in _DATE_LABEL.finditer(text):
        lead = _DATE_LEAD.match(text, label.end())
        owner, prior = text[label.end() : lead.end()], before(text, lead.end(), lead.end() - label.start() + 80, ".!?;\n")
        public = _DATE_OWNER.search(owner) or _POET.search(prior)
        if _DATE_OTHER.search(owner) or (public and not _DATE_PRIVATE.search(prior)):
            continue
        found, limit = _DATE_VALUE.match(text, lead.end()), label.end() + 160
        good = found and V.partial_date(found[0])
        if not found and label["birth"]:
            found = _DATE_WORDS.match(text, lead.end())
            good = found and V.written_date(found[0])
        if good and found.end() <= limit:
            end = found.end() - (found[0].endswith(".") and not found[0].lower().endswith(" г."))
            yield Span(found.start(), end, "BIRTH_DATE" if label["birth"] else "PASSPORT_DATE", 0.99, "explicit-personal-date-field")


# --- issuers without a strong label ---------------------------------------------------------------------------------
_AUTHORITY = rf"(?:{alt(L.AUTHORITIES)}|{alt('отдел|отделом|управление|управления|управлением|управлении')})"
_TAIL = rf"(?=\s*(?:[,;\n]|$|{word('код|дата')}|(?<!\w)[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}(?!\w)))"
ISSUERS = (
    labelled("PASSPORT_ISSUER", L.ISSUER_SHORT, rf"{_AUTHORITY}[^\n;]{{0,150}}?", end=_TAIL, gap=rf"{GAP}(?:{V.FULL_DATE}\s*[, ]+)?"),
    Field("PASSPORT_ISSUER", rx(rf"(?<!\w)(?P<value>{alt('увд|овд|гвд|фмс|уфмс|офмс|оуфмс|гу мвд|мвд')}\s+(?:россии\s+)?(?:по\s+)?[а-яё0-9 .-]{{3,100}}?){_TAIL}"), "context", 0.95, ("вд", "фмс"), lambda t, s, e: passport_record(t, s), "паспорт"),
)
