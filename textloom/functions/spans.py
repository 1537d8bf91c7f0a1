"""Span algebra in built-in expressions: offsets of matches, overlap resolution, splicing and restoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.types import DEFAULT_PRIORITY, MODEL_PRIORITY, PRIORITY, REGIONAL_FLOOR, REPLACEMENTS, SPANS


def match_spans(text: Column, pattern: str) -> Column:
    """start, end, value of the second group of each match of a pattern of two groups: context and value, in code points.

    The pieces between matches and the matches themselves are laid end to end, so no UTF-16 index is ever used.
    """
    gaps = F.split(text, pattern, -1)
    whole, lead = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    parts = F.zip_with(F.arrays_zip(gaps.alias("g"), whole.alias("w")), F.arrays_zip(lead.alias("l"), value.alias("v")), lambda a, b: F.struct(a["g"].alias("g"), a["w"].alias("w"), b["l"].alias("l"), b["v"].alias("v")))
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["g"])
        start = at + F.length(p["l"])
        found = F.struct(start.cast("int").alias("start"), (start + F.length(p["v"])).cast("int").alias("end"), p["v"].alias("value"))
        return F.struct((at + F.coalesce(F.length(p["w"]), F.lit(0))).cast("int").alias("at"), F.when(p["w"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def priority(span: Column) -> Column:
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), span["type"]), F.lit(DEFAULT_PRIORITY))
    own = F.when(span["reason"] == "cis-personal-id", F.greatest(own, F.lit(REGIONAL_FLOOR))).otherwise(own)
    return F.when(span["reason"] == "ner-structured", F.lit(MODEL_PRIORITY)).otherwise(own)


def resolve(candidates: Column) -> Column:
    """Of overlapping candidates the one of higher priority, then length, then confidence, then place and name; in text order."""
    ranked = F.transform(
        F.array_distinct(candidates),
        lambda s: F.struct((-priority(s)).alias("p"), (s["start"] - s["end"]).alias("l"), (-s["confidence"]).alias("c"), s["start"].alias("start"), s["type"].alias("type"), s["reason"].alias("reason"), s["end"].alias("end"), s["confidence"].alias("confidence")),
    )
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "type", "confidence", "reason")])
    keep = lambda acc, s: F.when(F.exists(acc, lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"])), acc).otherwise(F.array_append(acc, plain(s)))
    return F.array_sort(F.aggregate(F.array_sort(ranked), F.array().cast(SPANS), keep))


def shape_mask(value: Column) -> Column:
    """Every letter and number as a star, all else as it is."""
    return F.regexp_replace(value, r"[\p{L}\p{N}]", "*")


def mask_values(text: Column, values: Column) -> Column:
    """Every occurrence of the values masked by shape, longer values first: where a longer one was masked, a shorter one that overlaps it is not found any more.

    replace_spans masks places; this masks values, as SQL's replace does.
    """
    longest = F.array_sort(F.transform(F.array_distinct(values), lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v"))))
    return F.aggregate(longest, text, lambda t, x: F.replace(t, x["v"], shape_mask(x["v"])))


def synthetic(kind: Column, value: Column, ordinal: Column) -> Column:
    """An evidently invalid value of the same kind; the ordinal tells persons, mailboxes and addresses apart."""
    #: Templates by type.
    fixed = {
        "PHONE": "+0 (000) 000-00-00", "PASSPORT": "0000 000000", "DRIVER_LICENSE": "00 00 000000", "INN": "000000000000", "CARD": "0000 0000 0000 0000", "CVV": "***", "PIN": "****", "CITY": "Макетный",
        "STREET": "Тестовая", "HOUSE": "0", "APARTMENT": "0", "POSTAL_CODE": "000000", "LOCATION": "Макетная область", "COUNTRY": "Тестовая страна", "CITIZENSHIP": "Тестовое гражданство", "BIRTH_PLACE": "г. Макетный",
        "PASSPORT_ISSUER": "ТЕСТОВЫЙ ОРГАН", "DEPARTMENT_CODE": "000-000", "BIRTH_DATE": "01.01.1900", "PASSPORT_DATE": "01.01.2000", "FOREIGN_DOCUMENT": "DEMO000000",
    }
    numbered = {"PERSON": "Тестов%d Макет Макетович", "CARDHOLDER": "DEMO USER %d", "EMAIL": "person%d@example.invalid", "ADDRESS": "г. Макетный, ул. Тестовая, д. %d"}
    out = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), kind)
    for k, form in numbered.items():
        out = F.when(kind == k, F.format_string(form, ordinal)).otherwise(out)
    return F.coalesce(out, shape_mask(value))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column by two nested hashes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def replace_spans(text: Column, spans: Column, mode: str, key: bytes = b"", record: Column | None = None) -> Column:
    """struct(masked, replacements): spans replaced left to right; replacements hold coordinates in the masked text.

    mode: mask (shape), token (equal values of a type share a token of the record) or synthetic.
    """
    value = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    identity = F.array_distinct(F.transform(spans, lambda s: F.concat_ws("\x00", s["type"], value(s))))

    def new(s: Column) -> Column:
        if mode == "mask":
            return shape_mask(value(s))
        if mode == "token":
            name = F.concat_ws("\x00", record if record is not None else F.lit(""), s["type"], value(s))
            token = lambda n: F.concat(F.lit("⟦PD:"), s["type"], F.lit(":"), F.substring(hmac_sha256(key, n), 1, 16), F.lit("⟧"))
            # a token must not stand in the text already
            return F.when(F.contains(text, token(name)), token(F.concat(name, F.lit("\x00again")))).otherwise(token(name))
        return synthetic(s["type"], value(s), F.array_position(identity, F.concat_ws("\x00", s["type"], value(s))).cast("int"))

    pairs = F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), value(s).alias("v"), new(s).alias("r")))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(REPLACEMENTS).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, p["s"] - acc["at"]))
        item = F.struct(F.length(out).alias("start"), (F.length(out) + F.length(p["r"])).alias("end"), p["v"].alias("original"), p["r"].alias("replacement"))
        return F.struct(p["e"].alias("at"), F.concat(out, p["r"]).alias("out"), F.array_append(acc["done"], item).alias("done"))

    return F.aggregate(pairs, begin, step, lambda acc: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))).alias("masked"), acc["done"].alias("replacements")))


def restore_exact(masked: Column, replacements: Column) -> Column:
    """The original text; null where a replacement isn't where the record says."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, r: Column) -> Column:
        here = F.substring(masked, r["start"] + 1, r["end"] - r["start"]) == r["replacement"]
        out = F.concat(acc["out"], F.substring(masked, acc["at"] + 1, r["start"] - acc["at"]), r["original"])
        return F.struct(r["end"].alias("at"), out.alias("out"), (acc["ok"] & here & (r["start"] >= acc["at"])).alias("ok"))

    return F.aggregate(replacements, begin, step, lambda acc: F.when(acc["ok"], F.concat(acc["out"], F.substring(masked, acc["at"] + 1, F.length(masked)))))


TOKEN = "⟦PD:[A-Z][A-Z0-9_]{1,39}:[0-9a-f]{16}⟧"


def restore_tokens(reply: Column, replacements: Column, limit: int | None = None) -> Column:
    """The reply with every token replaced in one pass; null if there is none, one is unknown, or the result is over limit."""
    known = F.map_from_entries(F.array_distinct(F.transform(replacements, lambda r: F.struct(r["replacement"], r["original"]))))
    tokens = F.regexp_extract_all(reply, F.lit(TOKEN), F.lit(0))
    values = F.transform(tokens, lambda t: F.element_at(known, t))
    gaps = F.split(reply, TOKEN, -1)
    out = F.array_join(F.flatten(F.zip_with(gaps, values, lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    ok = (F.size(tokens) > 0) & F.forall(values, lambda v: v.isNotNull())
    if limit is not None:  # the length is known before anything is built
        size = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + F.length(g)) + F.aggregate(values, F.lit(0).cast("long"), lambda n, v: n + F.coalesce(F.length(v), F.lit(0)))
        ok = ok & (size <= limit)
    return F.when(ok, out)


def token_estimate(text: Column) -> Column:
    """About how many tokens a text has: a quarter of its characters."""
    return F.length(text) / 4


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits, not all equal, with a right check digit."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & (F.size(F.array_distinct(F.split(digits, ""))) > 1) & F.call_function("luhn_check", digits)


def inn_valid(value: Column) -> Column:
    """10 or 12 digits, not all equal, with right check digits."""
    d = F.transform(F.split(value, ""), lambda c: c.cast("int"))

    def check(weights: tuple[int, ...]) -> Column:
        terms = F.zip_with(F.slice(d, 1, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(0), lambda s, x: s + x) % 11 % 10 == F.get(d, F.lit(len(weights)))

    #: Weights of the check digits.
    ten = check((2, 4, 10, 3, 5, 9, 4, 6, 8))
    twelve = check((7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) & check((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))
    return (F.size(F.array_distinct(d)) > 1) & F.when(F.length(value) == 10, ten).when(F.length(value) == 12, twelve).otherwise(False)
