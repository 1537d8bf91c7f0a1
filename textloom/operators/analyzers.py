"""Models as injected analyzers: windows over long texts, decoding of labels, checks of what comes back.

An analyzer is any object with analyze(texts: list[str]) -> list[list[dict]]: for each text the spans {start, end,
score, entity_type}. It is made in the worker by a factory, so nothing of it is pickled. Whatever goes wrong, the
document gets an error and no spans: callers fail closed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.operators.model_spans import LIMIT, LIMITS
from textloom.types import TYPES

WINDOW, OVERLAP = 16_000, 2_080
MOST_SPANS, BATCH, TRIES = 2_048, 4, 4
ENTITY = "struct<start: int, end: int, type: string, score: double>"
#: Labels of the word model and the types they stand for; a label without a type is dropped.
NATIVE = {
    "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON", "MIDDLE_NAME": "PERSON", "PERSON": "PERSON", "CITY": "LOCATION", "COUNTRY": "LOCATION", "DISTRICT": "LOCATION", "REGION": "LOCATION", "STREET": "LOCATION", "HOUSE": "LOCATION",
    "EMAIL": "EMAIL", "PHONE": "PHONE", "PASSPORT": "PASSPORT", "DRIVER_LICENSE": "DRIVER_LICENSE", "INN": "INN", "CARD": "CARD", "SNILS": "SNILS", "OMS": "OMS", "IP": "IP_ADDRESS", "URL": "URL", "MILITARY_ID": "MILITARY_ID", "BIRTH_CERTIFICATE": "BIRTH_CERTIFICATE",
}


class BadOutput(ValueError):
    """Output of a model that must not be used."""


def known_types(types: Sequence[str]) -> tuple[str, ...]:
    """The types a model says it gives: each known, none twice."""
    if len(set(types)) != len(types) or not set(types) <= set(TYPES) or not types:
        raise BadOutput("types")
    return tuple(types)


def windows(size: int, width: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Places (start, end) of the windows over a text; a text of up to `width` is one."""
    if size <= width:
        return [(0, size)]
    step = width - overlap
    return [(a, min(a + width, size)) for a in range(0, size - overlap, step)]


def inner(spans: list[dict], start: int, end: int, size: int) -> list[dict]:
    """Spans of a window at their places in the text, without those that touch an edge the text doesn't have."""
    kept = (s for s in spans if not (s["start"] == 0 and start > 0) and not (s["end"] == end - start and end < size))
    return [{**s, "start": s["start"] + start, "end": s["end"] + start} for s in kept]


def checked(spans, size: int, types: Sequence[str]) -> list[dict]:
    """The spans of one text if all are what they must be: exact keys, whole numbers, possible places, scores and types."""
    if not isinstance(spans, list) or len(spans) > MOST_SPANS:
        raise BadOutput("number of spans")
    for s in spans:
        plain = isinstance(s, dict) and set(s) == {"start", "end", "score", "entity_type"} and type(s["start"]) is int and type(s["end"]) is int and isinstance(s["score"], float)
        if not plain or not 0 <= s["start"] < s["end"] <= size or not 0 <= s["score"] <= 1 or s["entity_type"] not in types:
            raise BadOutput("span")
        if s["end"] - s["start"] > LIMITS.get(s["entity_type"], LIMIT):
            raise BadOutput("length of span")
    return spans


def result(spans: list[dict], types: Sequence[str]) -> list[dict]:
    """Spans of the wanted types, each place and type once with its best score, in order."""
    best: dict[tuple, dict] = {}
    for s in spans:
        key = (s["start"], s["end"], s["entity_type"])
        if s["entity_type"] in types and (key not in best or s["score"] > best[key]["score"]):
            best[key] = s
    return [best[k] for k in sorted(best)]


def _patiently(call: Callable, seconds: float):
    """The result of call, tried again after a short and growing pause while the model is busy."""
    until = time.monotonic() + seconds
    for i in range(TRIES):
        try:
            return call()
        except BlockingIOError:
            pause = 0.005 * 2**i
            if i == TRIES - 1 or time.monotonic() + pause > until:
                raise
            time.sleep(pause)


def by_length(texts: Sequence[str], most: int = BATCH) -> Iterator[list[int]]:
    """Places of texts in batches of similar length, short ones first."""
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
    for a in range(0, len(order), most):
        yield order[a : a + most]


def analyze_texts(texts: list[str], analyzer, types: Sequence[str], seconds: float = 10.0) -> list[tuple[list[dict] | None, str | None]]:
    """(spans, error) of each text; windows of all texts go to the analyzer in batches of similar length."""
    pieces = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(len(t))]
    cut = [texts[i][a:b] for i, a, b in pieces]
    found: list[list[dict]] = [[] for _ in texts]
    bad: set[int] = set()
    for batch in by_length(cut):
        try:
            out = _patiently(lambda batch=batch: analyzer.analyze([cut[k] for k in batch]), seconds)
            if len(out) != len(batch):
                raise BadOutput("number of texts")
        except Exception:  # noqa: BLE001 - an unanswered window leaves its texts without protection
            bad |= {pieces[k][0] for k in batch}
            continue
        for k, spans in zip(batch, out):
            i, a, b = pieces[k]
            try:
                found[i] += inner(checked(spans, b - a, types), a, b, len(texts[i]))
            except (BadOutput, TypeError, KeyError):
                bad.add(i)
    return [(None, "temporarily_unavailable") if i in bad else (result(found[i], types), None) for i in range(len(texts))]


def analyze(docs: DataFrame, factory: Callable, types: Sequence[str], text_col: str = "text", seconds: float = 10.0) -> DataFrame:
    """docs with `model` (array of ENTITY) and `model_error`: a struct column of one Arrow kernel; factory() makes the analyzer in the worker, once."""
    types, made = known_types(types), []

    @F.arrow_udf(f"struct<spans: array<{ENTITY}>, error: string>")
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(factory())
        rows = analyze_texts([t or "" for t in texts.to_pylist()], made[0], types, seconds)
        spans = pa.array([None if s is None else [{"start": x["start"], "end": x["end"], "type": x["entity_type"], "score": x["score"]} for x in s] for s, _ in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64())])))
        return pa.StructArray.from_arrays([spans, pa.array([e for _, e in rows], pa.string())], ["spans", "error"])

    return docs.withColumn("_m", run(text_col)).select(*docs.columns, F.col("_m.spans").alias("model"), F.col("_m.error").alias("model_error"))


# --- decoding of a word model -----------------------------------------------------------------------------------------
def subword_windows(words: Sequence[int], width: int = 510, overlap: int = 128) -> list[tuple[int, int, int, int]]:
    """(first, last, own first, own last) of words (their numbers of subwords) for windows of `width` subwords.

    Where two windows overlap, each word belongs to the one in which it is farther from the edge; a word longer than a window is one by itself.
    """
    ends = np.cumsum(words)
    begins = ends - np.asarray(words)
    spans, at = [], 0
    while at < len(words):
        last = int(np.searchsorted(ends, begins[at] + width, "right"))
        last = max(last, at + 1)
        spans.append((at, last))
        if last == len(words):
            break
        at = max(at + 1, int(np.searchsorted(begins, ends[last - 1] - overlap, "left")))
        at = min(at, last)
    cuts = [0, *((a[1] + b[0] + 1) // 2 for a, b in zip(spans, spans[1:])), len(words)]
    return [(a, b, own, until) for (a, b), own, until in zip(spans, cuts, cuts[1:])]


def word_labels(logits: np.ndarray, first_subwords: Sequence[int], labels: Sequence[str]) -> list[tuple[str, float]]:
    """(label, probability) of each word: the best label of its first subword."""
    x = np.asarray(logits, np.float64)[list(first_subwords)]
    e = np.exp(x - x.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [(labels[k], float(p[i, k])) for i, k in enumerate(best)]


def validate_native(text: str, spans: list[dict]) -> list[dict]:
    """Spans {start, end, label, score, text} of the word model if they are in order, apart, and quote the text."""
    at = 0
    for s in spans:
        if set(s) != {"start", "end", "label", "score", "text"} or not at <= s["start"] < s["end"] <= len(text) or text[s["start"] : s["end"]] != s["text"] or not 0 <= s["score"] <= 1:
            raise BadOutput("native span")
        at = s["end"]
    return spans


def to_types(text: str, spans: list[dict]) -> list[dict]:
    """Spans of the word model by their types; neighbours of one type with only white space between become one with the best score."""
    out: list[dict] = []
    for s in validate_native(text, spans):
        kind = NATIVE.get(s["label"])
        if not kind:
            continue
        last = out[-1] if out else None
        if last and last["entity_type"] == kind and not text[last["end"] : s["start"]].strip():
            last["end"], last["score"] = s["end"], max(last["score"], s["score"])
        else:
            out.append({"start": s["start"], "end": s["end"], "score": float(s["score"]), "entity_type": kind})
    return out


def parse_schema_model(spans: list[dict], schema: dict[str, str], size: int) -> list[dict]:
    """Spans {start, end, label, score} of a model asked by label names: schema maps names to types, organizations and unknown names go, the best of equal ones stays."""
    kept = [{"start": s["start"], "end": s["end"], "score": float(s["score"]), "entity_type": schema[s["label"]]} for s in spans if s["label"] in schema and schema[s["label"]] != "ORGANIZATION"]
    return result(checked(kept, size, tuple(set(schema.values()))), tuple(set(schema.values())))
