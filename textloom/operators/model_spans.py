"""Spans of a model: words, labels to spans. Built-in expressions only.

Model output arrives as columns, so any analyzer (a table, a pandas function) can feed these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.spans import match_spans

#: Punctuation that stands alone, marks that may join two words of a label, labels that are never joined.
_ALONE = r"(){}\[\]«»\"“”‘’',;:!?"
_JOINING = r"^[.,;:!?]+$"
UNBRIDGED = "FIRST_NAME LAST_NAME MIDDLE_NAME CITY COUNTRY DISTRICT REGION STREET HOUSE".split()
_SPACE = r"\s\p{Z}\x1c-\x1f\x85"
_BLANK = rf"^[{_SPACE}]*$"
LABELLED = "array<struct<start: int, end: int, label: string, score: double>>"
#: Longest span of a type, types that are parts of an address, types that are never split.
LIMITS, LIMIT = {"EMAIL": 320, "URL": 2048}, 200
ADDRESS_PARTS = "ADDRESS LOCATION COUNTRY REGION DISTRICT CITY STREET HOUSE APARTMENT POSTAL_CODE".split()
ATOMIC = "PERSON CARDHOLDER ADDRESS IP_ADDRESS".split()


def words(text: Column) -> Column:
    """start, end, value of words; punctuation and the dots at a word's edges are words of their own.

    The list grows by copying: give it a model's window (protocol.chunks), not a whole long text.
    """
    return match_spans(text, rf"()([^{_SPACE}.{_ALONE}](?:[^{_SPACE}{_ALONE}]*[^{_SPACE}.{_ALONE}])?|[.{_ALONE}])")


def bridge(tokens: Column) -> Column:
    """tokens (start, end, value, label, score): an O of joining marks between equal labels takes the label and the lower score."""

    def one(t: Column, i: Column) -> Column:
        prev, following = F.get(tokens, i - 1), F.get(tokens, i + 1)
        name = lambda x: F.substring(x["label"], 3, 1000)
        joined = (t["label"] == "O") & t["value"].rlike(_JOINING) & (prev["label"] != "O") & (following["label"] != "O") & (name(prev) == name(following)) & ~name(prev).isin(UNBRIDGED)
        joined = F.coalesce(joined, F.lit(False))
        label, score = F.when(joined, F.concat(F.lit("I-"), name(prev))).otherwise(t["label"]), F.when(joined, F.least(prev["score"], following["score"])).otherwise(t["score"])
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), label.alias("label"), score.alias("score"))

    return F.transform(tokens, one)


def entities(tokens: Column) -> Column:
    """Runs of words of one label (B- and I- alike) as spans with the mean score; O and a change of label end a run."""
    name = lambda x: F.when(x["label"] == "O", F.lit(None).cast("string")).otherwise(F.substring(x["label"], 3, 1000))
    empty = F.struct(F.array().cast("array<struct<start: int, end: int, label: string, total: double, n: int>>").alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        out, label = acc["out"], name(t)
        last = F.element_at(out, -1)
        grown = F.struct(last["start"].alias("start"), t["end"].alias("end"), label.alias("label"), (last["total"] + t["score"]).alias("total"), (last["n"] + 1).alias("n"))
        fresh = F.struct(t["start"].alias("start"), t["end"].alias("end"), label.alias("label"), t["score"].alias("total"), F.lit(1).alias("n"))
        same = acc["open"] & F.coalesce(F.get(out, F.size(out) - 1)["label"] == label, F.lit(False))
        return F.struct(
            F.when(label.isNull(), out).when(same, F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), grown)).otherwise(F.array_append(out, fresh)).alias("out"), label.isNotNull().alias("open")
        )

    runs = F.aggregate(tokens, empty, lambda a, t: F.when(F.size(a["out"]) == 0, _first(a, t, name)).otherwise(step(a, t)), lambda a: a["out"])
    return F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["label"].alias("label"), (r["total"] / r["n"]).alias("score"))).cast(LABELLED)


def _first(acc: Column, t: Column, name) -> Column:
    label = name(t)
    fresh = F.struct(t["start"].alias("start"), t["end"].alias("end"), label.alias("label"), t["score"].alias("total"), F.lit(1).alias("n"))
    return F.struct(F.when(label.isNull(), acc["out"]).otherwise(F.array(fresh)).alias("out"), label.isNotNull().alias("open"))


def merge_adjacent(spans: Column, text: Column) -> Column:
    """spans (start, end, label, score) in order: neighbours of one label with only white space between become one with the greater score."""

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        gap = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
        near = F.coalesce((last["label"] == s["label"]) & gap.rlike(_BLANK), F.lit(False))
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), s["label"].alias("label"), F.greatest(last["score"], s["score"]).alias("score"))
        return F.when(near, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), one)).otherwise(F.array_append(acc, s))

    return F.aggregate(F.array_sort(spans), F.array().cast(LABELLED), step)


def align_bio(text: Column, tokens: Column, labels: Column, types: list[str]) -> Column:
    """struct(spans, error): the spans of BIO labels, each token found in the text right after the last one.

    error is null or token_label_length_mismatch, invalid_token_or_label, token_not_exactly_alignable, invalid_bio_transition,
    unaligned_text_suffix; then spans is null. An empty token labelled O only ends a span.
    """
    found = "array<struct<type: string, start: int, end: int>>"
    begin = F.struct(F.lit(0).alias("at"), F.lit("O").alias("last"), F.array().cast(found).alias("out"), F.lit(None).cast("string").alias("error"))

    def state(at, last, out, error):
        return F.struct(at.cast("int").alias("at"), last.alias("last"), out.alias("out"), error.cast("string").alias("error"))

    def step(acc: Column, x: Column) -> Column:
        token, label, out = x["t"], x["l"], acc["out"]
        start = F.call_function("locate", token, text, acc["at"] + 1) - 1
        end, kind = start + F.length(token), F.substring(label, 3, 1000)
        known = kind.isin(types)
        opens = label.startswith("B-") & known
        goes_on = label.startswith("I-") & known & ((acc["last"] == label) | (acc["last"] == F.concat(F.lit("B-"), kind)))
        tail = F.get(out, F.size(out) - 1)
        grown = F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.struct(kind.alias("type"), tail["start"].alias("start"), end.cast("int").alias("end")))
        added = F.array_append(out, F.struct(kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end")))
        error = F.when(token.isNull() | label.isNull() | (token == ""), "invalid_token_or_label")
        error = error.when((start < 0) | ~F.substring(text, acc["at"] + 1, start - acc["at"]).rlike(_BLANK), "token_not_exactly_alignable").when(~(opens | goes_on | (label == "O")), "invalid_bio_transition")
        moved = state(end, label, F.when(opens, added).when(goes_on, grown).otherwise(out), F.lit(None))
        bad = state(acc["at"], acc["last"], out, error)
        empty = F.coalesce((token == "") & (label == "O"), F.lit(False))
        return F.when(acc["error"].isNotNull(), acc).when(empty, state(acc["at"], F.lit("O"), out, F.lit(None))).when(error.isNotNull(), bad).otherwise(moved)

    pairs = F.zip_with(tokens, labels, lambda t, l: F.struct(t.alias("t"), l.alias("l")))
    run = F.aggregate(pairs, begin, step, lambda a: state(a["at"], a["last"], a["out"], F.coalesce(a["error"], F.when(~F.substring(text, a["at"] + 1, F.length(text)).rlike(_BLANK), "unaligned_text_suffix"))))
    error = F.when(F.size(tokens) != F.size(labels), "token_label_length_mismatch").otherwise(run["error"])
    return F.struct(F.when(error.isNull(), F.array_distinct(run["out"])).alias("spans"), error.alias("error"))
