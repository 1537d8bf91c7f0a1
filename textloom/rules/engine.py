"""All rules over one text, and over a column of texts in one Arrow kernel."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.rules import fields
from textloom.rules.documents import document_spans
from textloom.rules.names import name_spans
from textloom.rules.places import place_spans
from textloom.rules.refine import refine
from textloom.rules.scan import Span
from textloom.types import DEFAULT_PRIORITY, MODEL_PRIORITY, PRIORITY, REGIONAL_FLOOR, SPANS

GROUPS = ("contacts", "numbers", "documents", "texts", "issuers", "names", "places")
#: Rows of an Arrow batch: whole texts in batches of the usual 10,000 rows would fill a worker.
BATCH_ROWS = 1000
_DIGIT = re.compile("[0-9]")


def priority(s: Span) -> int:
    if s.reason == "ner-structured":
        return MODEL_PRIORITY
    return max(PRIORITY.get(s.type, DEFAULT_PRIORITY), REGIONAL_FLOOR if s.reason == "cis-personal-id" else 0)


def resolve(candidates: Iterable[Span]) -> list[Span]:
    """Of overlapping candidates the one of higher priority, then length, then confidence, then place and name; in text order."""
    kept: list[Span] = []
    starts: list[int] = []
    for s in sorted(set(candidates), key=lambda s: (-priority(s), s.start - s.end, -s.confidence, s.start, s.type, s.reason)):
        i = bisect_left(starts, s.start)
        if (i == 0 or kept[i - 1].end <= s.start) and (i == len(kept) or s.end <= kept[i].start):
            kept.insert(i, s)
            starts.insert(i, s.start)
    return kept


class RuleError(ValueError):
    """A tenant's rule that must not be used."""


@lru_cache(maxsize=128)
def tenant_pattern(kind: str, pattern: str):
    """Compiled rule of a tenant; refused if it is malformed, long or matches nothing at all."""
    import regex

    if not re.fullmatch(r"[A-Z][A-Z0-9_]{1,39}", kind or "") or not 1 <= len(pattern or "") <= 512:
        raise RuleError("invalid rule")
    try:
        compiled = regex.compile(pattern, regex.IGNORECASE | regex.UNICODE)
        if compiled.search("", timeout=0.02):
            raise RuleError("empty match")
    except (regex.error, TimeoutError) as e:
        raise RuleError("invalid rule") from e
    return compiled


def tenant_candidates(text: str, rules: Iterable[tuple[str, str]], seconds: float = 0.025, longest: int = 4096, most: int = 32) -> list[Span]:
    """Matches of a tenant's rules (type, pattern), each within its time; any fault refuses all."""
    rules, out = list(rules), []
    if len(rules) > most:
        raise RuleError("too many rules")
    for kind, pattern in rules:
        try:
            for m in tenant_pattern(kind, pattern).finditer(text, timeout=seconds):
                if not 0 < m.end() - m.start() <= longest:
                    raise RuleError("length of match")
                out.append(Span(m.start(), m.end(), kind, 1.0, "custom-rule"))
        except TimeoutError as e:
            raise RuleError("out of time") from e
    return out


def candidates(text: str, only: tuple[str, ...] = GROUPS) -> list[Span]:
    """Spans of the rules before refinement and resolution."""
    lower, out = text.lower(), []
    number = _DIGIT.search(text) is not None
    if "contacts" in only:
        out += fields.matches(text, lower, fields.CONTACTS)
    if "numbers" in only and (number or ":" in text):
        out += fields.matches(text, lower, fields.NUMBERS)
    if "documents" in only and number:
        out += document_spans(text, lower)
    if "texts" in only:
        out += fields.matches(text, lower, fields.TEXTS)
        if "рождения" in lower or "выда" in lower:
            out += fields.labelled_dates(text)
    if "issuers" in only:
        out += fields.matches(text, lower, fields.ISSUERS)
    if "names" in only:
        out += name_spans(text, lower)
    if "places" in only:
        out += place_spans(text, lower, fields.ADDRESS_FIELDS, fields.own_number)
    return out


def find(text: str, rules: Iterable[tuple[str, str]] = (), only: tuple[str, ...] = GROUPS) -> list[Span]:
    """Resolved spans of one text in text order; rules: those of a tenant."""
    if not text:
        return []
    return resolve(refine(text, candidates(text, only) + tenant_candidates(text, rules)))


def span_array(rows: list[list[Span] | None]) -> pa.Array:
    """Lists of spans as an Arrow list of structs; None is null."""
    flat = [s for r in rows if r for s in r]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
    columns = list(zip(*flat)) or [()] * 5
    values = pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["start", "end", "type", "confidence", "reason"])
    offsets, at = [], 0
    for r in rows:
        offsets.append(None if r is None else at)
        at += len(r or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def limit_batches(df: DataFrame) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)


def _outcomes(texts: list, rules: list, only) -> pa.Array:
    spans, errors = [], []
    for text, own in zip(texts, rules):
        try:
            spans.append(find(text or "", [(r["type"], r["pattern"]) for r in own or ()], only))
            errors.append(None)
        except Exception as e:  # noqa: BLE001 - a text that can't be searched must not pass
            spans.append(None)
            errors.append("invalid_rule" if isinstance(e, RuleError) else "temporarily_unavailable")
    return pa.StructArray.from_arrays([span_array(spans), pa.array(errors, pa.string())], ["spans", "error"])


def detected(text: Column, rules: Column | None = None, only: tuple[str, ...] = GROUPS) -> Column:
    """struct(spans, error): spans are null where a text could not be searched, so callers fail closed; a null text has none."""

    @F.arrow_udf(f"struct<spans: {SPANS}, error: string>")
    def plain(t: pa.Array) -> pa.Array:
        return _outcomes(t.to_pylist(), [()] * len(t), only)

    @F.arrow_udf(f"struct<spans: {SPANS}, error: string>")
    def ruled(t: pa.Array, r: pa.Array) -> pa.Array:
        return _outcomes(t.to_pylist(), r.to_pylist(), only)

    return plain(text) if rules is None else ruled(text, rules)


def detect(docs: DataFrame, text_col: str = "text", only: tuple[str, ...] = GROUPS, rules_col: str | None = None) -> DataFrame:
    """docs with `spans` (resolved, in text order) and `detect_error`. No shuffle; texts keep their partitions."""
    limit_batches(docs)
    found = docs.withColumn("_found", detected(F.col(text_col), F.col(rules_col) if rules_col else None, only))
    return found.select(*docs.columns, F.col("_found.spans").alias("spans"), F.col("_found.error").alias("detect_error"))


def tenant_spans(docs: DataFrame, policies: DataFrame) -> DataFrame:
    """docs (with system and text) and `custom`: spans of the rules of each document's system; null where the rules must not be used."""
    limit_batches(docs)
    joined = docs.join(policies.select("system", "extra_rules"), "system", "left")

    @F.arrow_udf(SPANS)
    def run(t: pa.Array, r: pa.Array) -> pa.Array:
        rows = []
        for text, rules in zip(t.to_pylist(), r.to_pylist()):
            try:
                rows.append(tenant_candidates(text or "", [(x["type"], x["pattern"]) for x in rules or ()]))
            except RuleError:
                rows.append(None)
        return span_array(rows)

    return joined.withColumn("custom", run("text", "extra_rules")).drop("extra_rules")




def register(spark) -> None:
    """For SQL: pii_spans(text), a table function for LATERAL use, and pii_mask(text), null where a text can't be searched."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="start int, end int, type string, confidence double, reason string")
    class Spans:
        def eval(self, text: str):
            yield from find(text or "")

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                chars = list(t or "")
                for s in find(t or ""):
                    chars[s.start : s.end] = ["*" if c.isalnum() else c for c in chars[s.start : s.end]]
                out.append(None if t is None else "".join(chars))
            except Exception:  # noqa: BLE001 - never the raw text
                out.append(None)
        return pa.array(out, pa.string())

    spark.udtf.register("pii_spans", Spans)
    spark.udf.register("pii_mask", mask)
