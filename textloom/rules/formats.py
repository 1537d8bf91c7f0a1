"""Values of fixed formats, each format by itself: what stands around a value doesn't count, and values of two formats may overlap.

The detector (engine) weighs such values against each other and their context, and keeps the best; this is the plain inventory of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.rules import values as V
from textloom.rules.engine import limit_batches, span_array
from textloom.rules.scan import Span
from textloom.types import SPANS


class Format(NamedTuple):
    type: str
    pattern: re.Pattern
    #: What a text must hold for the pattern to match.
    hint: str
    check: Callable[[str], bool] | None


def address(value: str) -> bool:
    """Four numbers up to 255, none with a leading zero."""
    return all(int(p) <= 255 and (len(p) == 1 or p[0] != "0") for p in value.split("."))


#: Letters in either case as SQL folds them: the long s and the Kelvin sign are s and k, the dotless i is no i.
_ANY_CASE = "a-zA-Z\u017f\u212a"
FORMATS = (
    Format("EMAIL", re.compile(rf"[{_ANY_CASE}0-9._+-]{{1,64}}@[{_ANY_CASE}0-9-]+(?:\.[{_ANY_CASE}0-9-]+){{1,8}}"), "@", None),
    Format("CARD", re.compile(r"\b[2-6][0-9]{2,3}(?:[ \t-]?[0-9]){9,15}\b", re.ASCII), "", V.luhn),
    Format("IP_ADDRESS", re.compile(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", re.ASCII), ".", address),
    Format("PHONE", re.compile(r"\+[1-9][0-9]{0,2}(?:[ \t().-]*[0-9]){7,13}"), "+", None),
)


def find(text: str) -> list[Span]:
    """Values of each format in text order, one format after the other."""
    return [Span(*m.span(), f.type, 1.0, "format") for f in FORMATS if f.hint in text for m in f.pattern.finditer(text) if f.check is None or f.check(m[0])]


def formatted(text: Column) -> Column:
    """Spans of the values of all formats; a null text has none."""

    @F.arrow_udf(SPANS)
    def run(t: pa.Array) -> pa.Array:
        return span_array([find(x or "") for x in t.to_pylist()])

    return run(text)


def with_formats(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """docs with the spans of the values of all formats. No shuffle; texts keep their partitions."""
    limit_batches(docs)
    return docs.withColumn(name, formatted(F.col(text_col)))
