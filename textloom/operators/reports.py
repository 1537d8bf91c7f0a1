"""Reports over gold and predicted spans: characters, cases, changes between versions, corpora.

Spans are rows (case_id, type, start, end), texts are rows (case_id, text), points are the letters and numbers that
spans cover: rows (case_id, type, pos). Every report is joins on case_id and aggregations; no case is collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.evaluate import characters, covered_characters as points, scores, span_outcomes

_BLANK = r"^[\s\p{Z}]*$"
_VERSIONS = ("gold", "before", "after")


def parse_marked(rows: DataFrame, marked: str = "marked") -> DataFrame:
    """rows with `text` and `expected` (type, start, end): values marked {{TYPE|value}} taken out of their marks."""
    pattern = r"\{\{([A-Z_]+)\|([^{}]+)\}\}"
    found = "array<struct<type: string, start: int, end: int>>"
    kinds, values, gaps = (F.regexp_extract_all(marked, F.lit(pattern), F.lit(1)), F.regexp_extract_all(marked, F.lit(pattern), F.lit(2)), F.split(marked, pattern, -1))
    parts = F.arrays_zip(gaps.alias("g"), kinds.alias("k"), values.alias("v"))

    def step(acc: Column, p: Column) -> Column:
        start = (acc["at"] + F.length(p["g"])).cast("int")
        end = (start + F.coalesce(F.length(p["v"]), F.lit(0))).cast("int")
        one = F.struct(p["k"].alias("type"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["k"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    expected = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(found).alias("out")), step, lambda a: a["out"])
    return rows.withColumn("text", F.regexp_replace(marked, pattern, "$2")).withColumn("expected", expected)


def untyped(spots: DataFrame) -> DataFrame:
    return spots.select("case_id", "pos").distinct()


def _sides(texts: DataFrame, **sides: DataFrame) -> DataFrame:
    """case_id, pos and for each side whether it covers the place."""
    rows = None
    for name, spots in sides.items():
        one = untyped(spots).select("case_id", "pos", *[F.lit(n == name).alias(n) for n in sides])
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("case_id", "pos").agg(*[F.bool_or(n).alias(n) for n in sides])


def case_counts(texts: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each text: tp, fp, fn in characters, exact, positive, fully_protected, false_alarm."""
    g, p = F.coalesce("gold", F.lit(False)), F.coalesce("predicted", F.lit(False))
    each = _sides(texts, gold=gold, predicted=predicted).groupBy("case_id").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    rows = texts.select("case_id").join(each, "case_id", "left").na.fill(0, ["tp", "fp", "fn"])
    positive = (F.col("tp") + F.col("fn")) > 0
    return rows.select(
        "case_id", "tp", "fp", "fn", ((F.col("fp") + F.col("fn")) == 0).alias("exact"), positive.alias("positive"), (positive & (F.col("fn") == 0)).alias("fully_protected"), (~positive & (F.col("fp") > 0)).alias("false_alarm")
    )


def summary(counts: DataFrame, weight: str | None = None, where: str | None = None) -> DataFrame:
    """One row: summed counts and flags (times a weight, of some cases only) with scores and rates."""
    rows = counts.where(where) if where else counts
    times = F.col(weight) if weight else F.lit(1)
    total = lambda c: F.coalesce(F.sum(c.cast("long") * times), F.lit(0)).cast("long")
    flags = ("exact", "positive", "fully_protected", "false_alarm")
    sums = rows.agg(total(F.lit(1)).alias("cases"), *[total(F.col(c)).alias(c) for c in ("tp", "fp", "fn")], *[total(F.col(c)).alias(f"n_{c}") for c in flags])
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    rated = scores(sums, "development").withColumn("n_negative", F.col("cases") - F.col("n_positive"))
    return rated.select("*", rate("n_exact", "cases").alias("exact_rate"), rate("n_fully_protected", "n_positive").alias("protected_rate"), rate("n_false_alarm", "n_negative").alias("false_alarm_rate"))


def type_coverage(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """By gold type: characters, protected ones (by any type), cases, fully protected cases, recall."""
    hit = gold.join(untyped(predicted).withColumn("hit", F.lit(1)), ["case_id", "pos"], "left")
    cases = hit.groupBy("type", "case_id").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    rows = cases.groupBy("type").agg(F.sum("n").alias("gold_characters"), F.sum("h").alias("protected_characters"), F.count("*").alias("cases"), F.count_if(F.col("n") == F.col("h")).alias("fully_protected_cases"))
    return rows.withColumn("character_recall", F.round(F.col("protected_characters") / F.col("gold_characters"), 6))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def annotation_problems(cases: DataFrame) -> DataFrame:
    """case_id, problem of cases (text, decision, uncertain, entities) that break a rule of annotations; the first one that holds."""
    e = F.array_sort(F.transform("entities", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"))))
    before = lambda i: F.coalesce(F.get(e, i - 1)["end"], F.lit(0))
    bounds = F.forall(F.transform(e, lambda s, i: (s["start"] >= before(i)) & (s["start"] < s["end"]) & (s["end"] <= F.length("text"))), lambda ok: F.coalesce(ok, F.lit(False)))
    named = F.forall(e, lambda s: F.coalesce(F.length(s["type"]) > 0, F.lit(False)))
    same = F.forall(e, lambda s: F.coalesce(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["text"], F.lit(False)))
    decided = F.coalesce(F.col("decision") == F.when(F.size(e) > 0, "positive").otherwise("negative"), F.lit(False))
    problem = F.when(F.col("text").isNull() | F.col("entities").isNull(), "missing_value").when(~bounds, "invalid_or_overlapping_offsets").when(~named, "invalid_type").when(~same, "substring_mismatch")
    problem = problem.when(F.col("uncertain").isNull(), "uncertainty_missing").when(~decided, "decision_conflict")
    return cases.select("case_id", problem.alias("problem")).where("problem is not null")


def mask_points(texts: DataFrame, spots: DataFrame) -> DataFrame:
    """case_id, masked: a star at every point of a text."""

    @F.arrow_udf("string")
    def starred(text: pa.Array, at: pa.Array) -> pa.Array:
        out = []
        for t, places in zip(text.to_pylist(), at.to_pylist()):
            chars = list(t or "")
            for p in places or ():
                chars[p] = "*"
            out.append(None if t is None else "".join(chars))
        return pa.array(out, pa.string())

    places = untyped(spots).groupBy("case_id").agg(F.collect_list("pos").alias("at"))
    return texts.join(places, "case_id", "left").select("case_id", starred("text", "at").alias("masked"))


def map_types(spans: DataFrame, mapping: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """Spans with their types replaced by mapping (type, family); the others go, or stay as UNMAPPED:type."""
    joined = spans.join(mapping.select("type", "family"), "type", "left" if keep_unmapped else "inner")
    return joined.select("case_id", F.coalesce("family", F.concat(F.lit("UNMAPPED:"), "type")).alias("type"), "start", "end").distinct()


def whole_cases(texts: DataFrame, gold: DataFrame, types: list[str]) -> DataFrame:
    """Texts all of whose gold spans have one of the types, those without gold spans among them."""
    other = gold.where(~F.col("type").isin(types)).select("case_id").distinct()
    return texts.join(other, "case_id", "left_anti")


def join_adjacent(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans of one type that overlap or have only white space between them, as one."""
    order = Window.partitionBy("case_id", "type").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.distinct().withColumn("_reach", reach).join(texts.select("case_id", "text"), "case_id")
    gap = F.substring(F.col("text"), F.col("_reach") + 1, F.greatest(F.col("start") - F.col("_reach"), F.lit(0)))
    new = F.when(F.col("_reach").isNull() | ((F.col("start") >= F.col("_reach")) & ~gap.rlike(_BLANK)), 1).otherwise(0)
    marked = rows.select("case_id", "type", "start", "end", new.alias("_new")).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy("case_id", "type", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def compare_cases(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """case_id, change of fp and fn, verdict (improved, regressed, mixed_tradeoff, equal_error_counts), flip (became_exact, lost_exact) of case_counts of two systems."""
    r, c = reference.alias("r"), candidate.alias("c")
    fp, fn = F.col("c.fp") - F.col("r.fp"), F.col("c.fn") - F.col("r.fn")
    verdict = F.when((fp == 0) & (fn == 0), "equal_error_counts").when((fp <= 0) & (fn <= 0), "improved").when((fp >= 0) & (fn >= 0), "regressed").otherwise("mixed_tradeoff")
    flip = F.when(F.col("c.exact") & ~F.col("r.exact"), "became_exact").when(F.col("r.exact") & ~F.col("c.exact"), "lost_exact")
    return r.join(c, F.col("r.case_id") == F.col("c.case_id")).select(F.col("r.case_id").alias("case_id"), fp.alias("fp_change"), fn.alias("fn_change"), verdict.alias("verdict"), flip.alias("flip"))


def first_errors(gold: DataFrame, predicted: DataFrame, k: int = 5) -> DataFrame:
    """The first k cases whose spans differ, with the number of spans on one side only."""
    wrong = span_outcomes(gold, predicted).where("in_gold <> in_predicted")
    return wrong.groupBy("case_id").agg(F.count_if("in_predicted").alias("false_positive"), F.count_if("in_gold").alias("false_negative")).orderBy("case_id").limit(k)


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def visiting_order(cases: DataFrame, key: str, weight: str, cycles: int, seed: int) -> DataFrame:
    """key, visit, at: the weighted order of visits in the first `cycles` cycles; a case of weight w is visited w times a cycle, once in each share of it."""
    k = F.explode(F.sequence(F.lit(0), (F.ceil(F.col(weight) * cycles) - 1).cast("int"))).alias("visit")
    visits = cases.where(F.col(weight) > 0).select(key, weight, k)
    at = (F.col("visit") + _unit(F.lit(str(seed)), F.col(key).cast("string"), F.col("visit").cast("string"))) / F.col(weight)
    return visits.select(key, "visit", at.alias("at")).where(F.col("at") < cycles)


#: Rows of a range that one task numbers, about.
RANGE_ROWS = 1_000_000


def _in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with `_part`, the range of a total order they fall into. Bounds come from one small sample and are literals from then on, so every use of the plan, and every retry, cuts alike."""
    n = rows.count()
    parts = -(-n // RANGE_ROWS)
    if parts < 2:
        return rows.withColumn("_part", F.lit(0))
    some = rows.select(*order).sample(min(1.0, 64 * parts / n), 11).orderBy(*order).limit(256 * parts).collect()
    bounds = [some[len(some) * k // parts] for k in range(1, parts)] if some else []
    key = F.struct(*order)
    literal = lambda r: F.struct(*[F.lit(r[c]).cast(rows.schema[c].dataType).alias(c) for c in order])
    at = F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b <= key)) if bounds else F.lit(0)
    return rows.withColumn("_part", at)


def _moved(cut: DataFrame, order: list[str], own: Column, total: Column, name: str) -> DataFrame:
    """A running number within each range plus the total of the ranges before it: a few rows are sent to all tasks."""
    before = F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy("_part").agg(total.alias("s")).select("_part", before.alias("_before"))
    return cut.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Rows with their place (from 1) in a total order of columns without nulls: each range is numbered by itself and moved by the size of those before it."""
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    return _moved(_in_ranges(rows, order), order, place, F.count("*"), name)


def running_total(rows: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """Rows with the sum of `value` up to and with each in a total order; ranges are summed by themselves and moved, as in numbered()."""
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _moved(_in_ranges(rows, order), order, own, F.sum(value), name)


def capture_within(rows: DataFrame, order: list, size: str, most: int) -> DataFrame:
    """Rows with `kept`: captured until the sizes reach `most`; the counts of kept and dropped rows follow from it."""
    return running_total(rows, order, size, "_total").withColumn("kept", F.col("_total") <= most).drop("_total")


def captured_texts(rows: DataFrame, text: str, source: str) -> DataFrame:
    """digest, source, n: how often each text was captured from each source; texts themselves are not shown."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("digest"), F.col(source).alias("source")).agg(F.count("*").alias("n"))


def by_label_hash(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows in the order of the SHA-256 of their labels, numbered from 1."""
    return numbered(rows.withColumn("_h", F.sha2(F.concat(F.lit(prefix), F.col(key).cast("string")), 256)), ["_h", key]).drop("_h")


def audit_rows(requests: DataFrame) -> DataFrame:
    """What may be logged of requests: never text, ids of payloads or keys."""
    return requests.select("system", "operation", F.array_sort(F.array_distinct(F.transform("entities", lambda s: s["type"]))).alias("types"), "mode", "latency_ms", "profile")


def triple_scores(texts: DataFrame, gold: DataFrame, predicted: DataFrame, group: str) -> DataFrame:
    """group, metric (joined, character, exact), tp, fp, fn, precision, recall, f of texts by a group column of theirs."""
    groups = texts.select("case_id", F.col(group).alias("group"))
    exact = span_outcomes(gold, predicted).select("case_id", "in_gold", "in_predicted")
    joined = span_outcomes(join_adjacent(gold, texts), join_adjacent(predicted, texts)).select("case_id", "in_gold", "in_predicted")
    chars = _sides(texts, in_gold=points(gold, texts), in_predicted=points(predicted, texts)).select("case_id", "in_gold", "in_predicted")
    rows = exact.withColumn("metric", F.lit("exact")).union(joined.withColumn("metric", F.lit("joined"))).union(chars.withColumn("metric", F.lit("character")))
    both = F.col("in_gold") & F.col("in_predicted")
    table = rows.join(groups, "case_id").groupBy("group", "metric").agg(F.count_if(both).alias("tp"), F.count_if(~F.col("in_gold")).alias("fp"), F.count_if(~F.col("in_predicted")).alias("fn"))
    return scores(table)


def gold_build(inputs: DataFrame, annotations: DataFrame, weights: DataFrame) -> DataFrame:
    """case_id, text, entities (with their text), decision, traffic_weight, expected_masked of the cases that all three tables hold."""
    value = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    from textloom.functions.spans import replace_spans
    from textloom.types import SPANS

    spans = F.transform("entities", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), F.lit(1.0).alias("confidence"), F.lit("gold").alias("reason"))).cast(SPANS)
    entities = F.transform("entities", lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("text")))
    joined = inputs.select("case_id", "text").join(annotations.select("case_id", F.array_sort("entities").alias("entities")), "case_id").join(weights.select("case_id", "traffic_weight"), "case_id")
    return joined.select("case_id", "text", entities.alias("entities"), F.when(F.size("entities") > 0, "positive").otherwise("negative").alias("decision"), "traffic_weight", replace_spans(F.col("text"), spans, "mask")["masked"].alias("expected_masked"))


def parity(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """case_id, matched, missing, extra, largest and mean difference of scores of two systems' spans (with score)."""
    key = ["case_id", "type", "start", "end"]
    both = reference.select(*key, F.col("score").alias("a")).join(candidate.select(*key, F.col("score").alias("b")), key, "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("case_id").agg(
        F.count(gap).alias("matched"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.round(F.coalesce(F.max(gap), F.lit(0.0)), 6).alias("largest"), F.round(F.coalesce(F.avg(gap), F.lit(0.0)), 6).alias("mean")
    )


def normalized(text: Column) -> Column:
    """Lower case, one blank for any white space, none at the ends: what near-equal texts are compared by."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _changes(texts: DataFrame, gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, pos, gold, before, after."""
    return _sides(texts, gold=gold, before=before, after=after)


def _change_counts() -> list[Column]:
    g, b, a = (F.col(n) for n in _VERSIONS)
    return [F.count_if(g & b & ~a).alias("lost_tp"), F.count_if(g & a & ~b).alias("gained_tp"), F.count_if(~g & a & ~b).alias("new_fp"), F.count_if(~g & b & ~a).alias("removed_fp")]


def case_transitions(texts: DataFrame, gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each text: characters lost, gained, newly and no longer wrongly covered, became_exact, lost_exact, new_negative_alarm, recovered_negative."""
    g, b, a = (F.col(n) for n in _VERSIONS)
    each = _changes(texts, gold, before, after).groupBy("case_id").agg(*_change_counts(), F.count_if(g).alias("g"), F.count_if(b != g).alias("wb"), F.count_if(a != g).alias("wa"), F.count_if(b).alias("b"), F.count_if(a).alias("a"))
    rows = texts.select("case_id").join(each, "case_id", "left").na.fill(0)
    return rows.select(
        "case_id", "lost_tp", "gained_tp", "new_fp", "removed_fp", F.expr("wb > 0 and wa = 0").alias("became_exact"), F.expr("wb = 0 and wa > 0").alias("lost_exact"),
        F.expr("g = 0 and b = 0 and a > 0").alias("new_negative_alarm"), F.expr("g = 0 and b > 0 and a = 0").alias("recovered_negative"),
    )


def change_audit(texts: DataFrame, gold: DataFrame, before: DataFrame, after: DataFrame, stratum: str) -> DataFrame:
    """By stratum (a column of texts): summed changes and the cases with lost characters, new false ones, or either."""
    rows = case_transitions(texts, gold, before, after).join(texts.select("case_id", F.col(stratum).alias("stratum")), "case_id")
    lost, new = F.col("lost_tp") > 0, F.col("new_fp") > 0
    return rows.groupBy("stratum").agg(*[F.sum(c).alias(c) for c in ("lost_tp", "gained_tp", "new_fp", "removed_fp")], F.count_if(lost).alias("cases_with_lost_tp"), F.count_if(new).alias("cases_with_new_fp"), F.count_if(lost | new).alias("cases_with_any_regression"))


def error_deltas(texts: DataFrame, gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """side (gold, predicted), type, new_fn, recovered_fn, new_fp: changes by the type of the gold span, and by that of the new prediction."""
    places = _changes(texts, gold, before, after)
    by_gold = gold.join(places, ["case_id", "pos"]).groupBy(F.lit("gold").alias("side"), "type").agg(F.count_if(F.col("before") & ~F.col("after")).alias("new_fn"), F.count_if(F.col("after") & ~F.col("before")).alias("recovered_fn"), F.lit(0).cast("long").alias("new_fp"))
    zero = F.lit(0).cast("long")
    by_new = after.join(places, ["case_id", "pos"]).groupBy(F.lit("predicted").alias("side"), "type").agg(zero.alias("new_fn"), zero.alias("recovered_fn"), F.count_if(~F.col("before") & ~F.col("gold")).alias("new_fp"))
    return by_gold.union(by_new)


def type_matrix(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold, predicted, n: characters by gold and predicted type, NONE where a side has none, with margins ALL."""
    both = gold.select("case_id", "pos", F.col("type").alias("gold")).join(predicted.select("case_id", "pos", F.col("type").alias("predicted")), ["case_id", "pos"], "full_outer")
    named = both.select(F.coalesce("gold", F.lit("NONE")).alias("gold"), F.coalesce("predicted", F.lit("NONE")).alias("predicted"))
    return named.cube("gold", "predicted").agg(F.count("*").alias("n")).select(F.coalesce("gold", F.lit("ALL")).alias("gold"), F.coalesce("predicted", F.lit("ALL")).alias("predicted"), "n")


def attribution(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """By gold type: characters, those covered before and after, gained and lost."""
    b, a = untyped(before).withColumn("b", F.lit(True)), untyped(after).withColumn("a", F.lit(True))
    rows = gold.join(b, ["case_id", "pos"], "left").join(a, ["case_id", "pos"], "left").na.fill(False, ["a", "b"])
    return rows.groupBy("type").agg(F.count("*").alias("gold_characters"), F.count_if("b").alias("reference_tp"), F.count_if("a").alias("candidate_tp"), F.count_if(F.col("a") & ~F.col("b")).alias("gained_tp"), F.count_if(F.col("b") & ~F.col("a")).alias("lost_tp"))


def strict_misses(texts: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """type, reason, n of the gold spans without an equal prediction: fully masked by the type, by any type, partly or not."""
    key = ["case_id", "type", "start", "end"]
    missed = gold.select(*key).distinct().join(predicted.select(*key).distinct(), key, "left_anti")
    each = characters(missed, texts)
    spots = points(predicted, texts).groupBy("case_id", "pos").agg(F.collect_set("type").alias("types"))
    hit = each.join(spots, ["case_id", "pos"], "left").groupBy(*key).agg(F.count("*").alias("n"), F.count("types").alias("any"), F.count_if(F.array_contains("types", F.col("type"))).alias("same"))
    reason = F.when(F.col("same") == F.col("n"), "boundary").when(F.col("any") == F.col("n"), "wrong_type").when(F.col("any") > 0, "partly_masked").otherwise("unmasked")
    every = missed.join(hit, key, "left").select("type", F.when(F.col("n").isNull(), "unmasked").otherwise(reason).alias("reason"))
    return every.groupBy("type", "reason").agg(F.count("*").alias("n"))


def stage_losses(spots: DataFrame, gold: DataFrame, stages: list[str]) -> DataFrame:
    """stage, lost_gold, lost_other, added of rows (case_id, stage, pos): what each stage no longer covers that the one before did, and what it covers anew (should be none)."""
    seen = spots.groupBy("case_id", "pos").agg(F.collect_set("stage").alias("have"))
    marked = seen.join(untyped(gold).withColumn("g", F.lit(True)), ["case_id", "pos"], "left").na.fill(False, ["g"])
    at = lambda s: F.array_contains("have", s)
    steps = F.explode(F.array(*[F.struct(F.lit(b).alias("stage"), (at(a) & ~at(b)).alias("lost"), (~at(a) & at(b)).alias("new")) for a, b in zip(stages, stages[1:])])).alias("x")
    rows = marked.select("g", steps).select("g", "x.*")
    return rows.groupBy("stage").agg(F.count_if(F.col("lost") & F.col("g")).alias("lost_gold"), F.count_if(F.col("lost") & ~F.col("g")).alias("lost_other"), F.count_if("new").alias("added"))


def displaced(candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """type, winner, n: candidates that overlap a winner of another type or place, by the types of both."""
    a, b = candidates.alias("a"), winners.alias("b")
    meets = (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    other = (F.col("a.start") != F.col("b.start")) | (F.col("a.end") != F.col("b.end")) | (F.col("a.type") != F.col("b.type"))
    return a.join(b, meets & other).groupBy(F.col("a.type").alias("type"), F.col("b.type").alias("winner")).agg(F.count("*").alias("n"))


def contract_profile(texts: DataFrame, spans: DataFrame, most: int = 2048) -> DataFrame:
    """One row: documents, entities, most entities of a document, documents over `most`, longest span."""
    each = spans.groupBy("case_id").agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("longest"))
    rows = texts.select("case_id").join(each, "case_id", "left").na.fill(0)
    return rows.agg(F.count("*").alias("documents"), F.sum("n").alias("entities"), F.max("n").alias("most_entities"), F.count_if(F.col("n") > most).alias("documents_over_limit"), F.max("longest").cast("long").alias("longest_span"))


def nearest_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median, and p95 and p99 by nearest rank, that is values that occur."""
    return rows.groupBy(group).agg(F.percentile(value, 0.5).alias("p50"), *[F.expr(f"percentile_disc({q / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"rank{q}") for q in (95, 99)])


def request_origin(requests: DataFrame, peer: str = "peer", forwarded: str = "forwarded", agent: str = "agent", longest: int = 200) -> DataFrame:
    """requests with client (first address of the forwarded chain if all of it are addresses, else the peer's if it is one) and agent cut to its longest."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    address = rf"^(?:{octet}(?:\.{octet}){{3}}|(?=.*:)[0-9A-Fa-f:]{{2,39}})$"
    chain = F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x))
    sound = F.forall(chain, lambda x: x.rlike(address))
    return requests.withColumn("client", F.when(sound, F.get(chain, F.lit(0))).when(F.col(peer).rlike(address), F.col(peer))).withColumn(agent, F.substring(agent, 1, longest))
