"""Which values are possible: check digits, days of the calendar, written dates, network addresses."""

from __future__ import annotations

import re
from datetime import date
from ipaddress import ip_address

from textloom.rules import lexicon as L
from textloom.rules.scan import alt, digits, rx


def luhn(value: str) -> bool:
    """13 to 19 digits, not all equal, with a right check digit."""
    d = [int(c) for c in digits(value)]
    if not 13 <= len(d) <= 19 or len(set(d)) == 1:
        return False
    doubled = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
    return (sum(d[-1::-2]) + sum(doubled)) % 10 == 0


#: Weights of the check digits; the longer number uses tails of the same row.
_WEIGHTS = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def inn(value: str) -> bool:
    """10 or 12 digits, not all equal, with right check digits."""
    d = [int(c) for c in value]
    if len(d) not in (10, 12) or len(set(d)) == 1:
        return False
    places = (9,) if len(d) == 10 else (10, 11)
    return all(sum(a * b for a, b in zip(d, _WEIGHTS[-n:])) % 11 % 10 == d[n] for n in places)


def day(year: int, month: int, number: int) -> bool:
    try:
        return 1800 <= year <= 2100 and bool(date(year, month, number))
    except ValueError:
        return False


MONTH = alt("|".join(L.MONTHS))
_MONTHS = [rx(rf"(?<!\w){alt(m)}(?!\w)") for m in L.MONTHS]


def month(value: str) -> int:
    return next((i for i, m in enumerate(_MONTHS, 1) if m.search(value)), 0)


def full_date(value: str) -> bool:
    """Some reading of the value, day or month first, is a day of the calendar."""
    n, named = [int(x) for x in re.findall("[0-9]+", value)], month(value)
    years, rest = [x for x in n if x >= 1000], [x for x in n if x < 1000]
    if named:
        return bool(years and rest) and day(years[0], named, rest[0])
    return len(n) == 3 and len(years) == 1 and len(rest) == 2 and (day(years[0], *rest) or day(years[0], *rest[::-1]))


def partial_date(value: str) -> bool:
    """As full_date, with short and missing years; without a year 29 February counts."""
    n, named = [int(x) for x in re.findall("[0-9]+", value)], month(value)
    if named:
        parts, year = ([named, n[0]] if n else []), (n[1] if len(n) == 2 else 2000)
        known = len(n) in (1, 2)
    else:
        first = bool(n) and n[0] >= 1000
        year = 2000 if len(n) == 2 else (n[0] if first else n[-1] if n else 0)
        parts, known = (n if len(n) == 2 else n[1:] if first else n[:-1]), len(n) in (2, 3)
    if not known:
        return False
    year += 2000 if year < 100 else 0
    return day(year, *parts) or (not named and day(year, *parts[::-1]))


def _ordinals() -> dict[str, int]:
    out = {}
    for i, stem in enumerate(L.ORDINALS, 1):
        for s in {stem, stem.replace("ё", "е")}:
            soft = stem == "треть"
            out |= {s + ("е" if soft else "ое"): i, s + ("его" if soft else "ого"): i}
    return out | {s + "ого": 30 + 10 * i for i, s in enumerate(L.TENTHS)} | {"тридцатое": 30}


_ORDINAL, _TEN = _ordinals(), {t: 20 + 10 * i for i, t in enumerate(L.TENS)}
_NUMBER = rf"(?:{alt('|'.join(L.TENS))}[ \t]+)?{alt('|'.join(_ORDINAL))}"
WRITTEN = rf"(?P<d>{_NUMBER})[ \t]+(?P<m>{MONTH})[ \t]+(?P<c>{alt('|'.join(L.CENTURIES))})(?:[ \t]+(?P<y>{_NUMBER}))?[ \t]+года(?!\w)"
_WRITTEN = rx(WRITTEN)


def _spoken(words: str) -> int:
    *tens, last = words.lower().split()
    n = _ORDINAL.get(last, 0)
    return n if not tens else _TEN[tens[0]] + n if 1 <= n <= 9 else 0


def written_date(value: str) -> bool:
    m = _WRITTEN.fullmatch(value)
    if not m:
        return False
    rest = _spoken(m["y"]) if m["y"] else 0
    return not (m["y"] and not rest) and day(L.CENTURIES[" ".join(m["c"].lower().split())] + rest, month(m["m"]), _spoken(m["d"]))


_SEP, _D, _Y = "[./-]", "[0-9]{1,2}", "[0-9]{4}"
_YEAR_WORD = r"(?:[ \t]+(?:года|год|г[.]))?"
_M = rf"(?<!\w){MONTH}(?!\w)"
FULL_DATE = "(?:" + "|".join(
    (_SEP.join((_D, _D, _Y)), _SEP.join((_Y, _D, _D)), rf"{_D}\s+{_M}\s+{_Y}", rf"{_Y}(?:\s+г(?:ода|[.])?)?[, ]+{_D}\s+{_M}", rf"{_M}\s+{_D}[, ]+{_Y}")
) + rf"){_YEAR_WORD}"
_ANY = r"(?:[./-]|[ \t]+)"
PARTIAL_DATE = "(?:" + "|".join(
    (_ANY.join((_Y, _D, _D)), _ANY.join((_D, _D, rf"(?:{_Y}|[0-9]{{2}})")), rf"{_D}{_ANY}{_M}[.]?(?:{_ANY}(?:{_Y}|[0-9]{{2}}))?", _ANY.join((_D, _D)))
) + rf"){_YEAR_WORD}(?!\w|[./-][0-9]|[ \t]+[0-9])"


def network_address(value: str) -> bool:
    compact = re.sub(r"[ \t]", "", value)
    if not re.search("[0-9a-fA-F]", compact):
        return False
    try:
        return bool(ip_address(compact))
    except ValueError:
        return False
