"""Queries of the reports over gold and predicted spans, on spans laid over the texts of `documents` by rule, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.operators import evaluate as E, reports as R
from textloom.sources.tables import parquet

_Q: dict = {}
_SQL: dict[str, str] = {}
#: Rules that lay spans over texts: (type, start, length, which cases), in words both engines know.
_RULES = {
    "gold": (("lang", "case_id % 40", "5 + case_id % 7", "case_id % 5 <> 0"), ("'B'", "50 + case_id % 3", "12", "case_id % 3 = 0")),
    "before": (("lang", "case_id % 40", "5 + case_id % 7", "case_id % 4 <> 0"), ("'B'", "50 + case_id % 4", "10", "case_id % 6 <> 1")),
    "after": (("lang", "case_id % 40", "6 + case_id % 6", "case_id % 7 <> 0"), ("'C'", "50 + case_id % 3", "12", "case_id % 6 = 0")),
}
_TEXTS = "d AS (SELECT doc_id AS case_id, text, lang FROM documents WHERE length(text) >= 80)"


def _spans_sql(name: str) -> str:
    parts = (f'SELECT case_id, {kind} AS type, ({start})::INT AS start, ({start} + {size})::INT AS "end" FROM d WHERE {where}' for kind, start, size, where in _RULES[name])
    return f"{name}_s AS ({' UNION ALL '.join(parts)})"


def _points_sql(name: str) -> str:
    return f"""{name}_p AS (SELECT DISTINCT x.case_id, x.type, x.pos FROM (SELECT case_id, type, unnest(range(start, "end"))::INT AS pos FROM {name}_s) x JOIN d USING (case_id) WHERE regexp_matches(substr(d.text, x.pos + 1, 1), '[\\p{{L}}\\p{{N}}]'))"""


_ALL = ", ".join([_TEXTS, *(_spans_sql(n) for n in _RULES), *(_points_sql(n) for n in _RULES)])
_PLACES = "places AS (SELECT case_id, pos, bool_or(k = 0) AS g, bool_or(k = 1) AS b, bool_or(k = 2) AS a FROM (SELECT case_id, pos, 0 AS k FROM gold_p UNION ALL SELECT case_id, pos, 1 FROM before_p UNION ALL SELECT case_id, pos, 2 FROM after_p) GROUP BY ALL)"
_COUNTS = "counts_{n} AS (SELECT d.case_id, count(*) FILTER (g AND {v}) AS tp, count(*) FILTER (NOT g AND {v}) AS fp, count(*) FILTER (g AND NOT {v}) AS fn FROM d LEFT JOIN places USING (case_id) GROUP BY d.case_id)"
_BEFORE, _AFTER = _COUNTS.format(n="b", v="b"), _COUNTS.format(n="a", v="a")
_FLAGS = "tp + fn > 0 AS positive, tp + fn > 0 AND fn = 0 AS fully_protected, tp + fn = 0 AND fp > 0 AS false_alarm"


def _query(sql: str, *tables: str):
    def add(f):
        def run(spark, sf_dir):
            texts = _texts(spark, sf_dir)
            return f(texts, *[_points(texts, t[:-2]) if t.endswith("_p") else _spans(texts, t) for t in tables])

        _Q[f.__name__], _SQL[f.__name__] = run, f"WITH {_ALL}, {_PLACES}, {_BEFORE}, {_AFTER} {sql}"
        return f

    return add


def _texts(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "documents").where("length(text) >= 80").select(F.col("doc_id").alias("case_id"), "text", "lang")


def _spans(texts: DataFrame, name: str) -> DataFrame:
    out = None
    for kind, start, size, where in _RULES[name]:
        one = texts.where(where).select("case_id", F.expr(kind).alias("type"), F.expr(f"cast({start} as int)").alias("start"), F.expr(f"cast({start} + {size} as int)").alias("end"))
        out = one if out is None else out.union(one)
    return out


def _points(texts: DataFrame, name: str) -> DataFrame:
    return R.points(_spans(texts, name), texts)


@_query(f"SELECT case_id, tp, fp, fn, fp + fn = 0 AS exact, {_FLAGS} FROM counts_b", "gold_p", "before_p")
def case_flags(texts, gold, before):
    return R.case_counts(texts, gold, before)


_SUMS = """SELECT sum(w)::BIGINT AS cases, sum(tp * w)::BIGINT AS tp, sum(fp * w)::BIGINT AS fp, sum(fn * w)::BIGINT AS fn, sum(w) FILTER (fp + fn = 0)::BIGINT AS n_exact, sum(w) FILTER (tp + fn > 0)::BIGINT AS n_positive,
coalesce(sum(w) FILTER (tp + fn > 0 AND fn = 0), 0)::BIGINT AS n_fully_protected, coalesce(sum(w) FILTER (tp + fn = 0 AND fp > 0), 0)::BIGINT AS n_false_alarm FROM (SELECT *, {w} AS w FROM counts_b {where})"""
_RATES = """SELECT cases, tp, fp, fn, n_exact, n_positive, n_fully_protected, n_false_alarm, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f,
cases - n_positive AS n_negative, round(n_exact / cases, 6) AS exact_rate, round(n_fully_protected / n_positive, 6) AS protected_rate, CASE WHEN cases > n_positive THEN round(n_false_alarm / (cases - n_positive), 6) END AS false_alarm_rate FROM ({sums})"""


@_query(_RATES.format(sums=_SUMS.format(w="1 + case_id % 9", where="")), "gold_p", "before_p")
def weighted_summary(texts, gold, before):
    return R.summary(R.case_counts(texts, gold, before).withColumn("weight", F.expr("1 + case_id % 9")), "weight")


@_query(_RATES.format(sums=_SUMS.format(w="1", where="WHERE case_id % 4 <> 1")), "gold_p", "before_p")
def certain_summary(texts, gold, before):
    return R.summary(R.case_counts(texts, gold, before), where="case_id % 4 <> 1")


@_query("""SELECT type, sum(n)::BIGINT AS gold_characters, sum(h)::BIGINT AS protected_characters, count(*) AS cases, count(*) FILTER (n = h) AS fully_protected_cases, round(sum(h) / sum(n), 6) AS character_recall
FROM (SELECT x.type, x.case_id, count(*) AS n, count(*) FILTER (p.b) AS h FROM gold_p x JOIN places p USING (case_id, pos) GROUP BY ALL) GROUP BY type""", "gold_p", "before_p")
def type_coverage(texts, gold, before):
    return R.type_coverage(gold, before)


@_query("SELECT case_id, 1 + count(*) AS n FROM (SELECT case_id FROM d WHERE case_id % 11 = 0) GROUP BY case_id")
def duplicate_keys(texts):
    return R.duplicate_keys(texts.select("case_id").union(texts.where("case_id % 11 = 0").select("case_id")), "case_id")


@_query("""SELECT case_id, CASE case_id % 13 WHEN 1 THEN 'invalid_or_overlapping_offsets' WHEN 2 THEN 'invalid_type' WHEN 3 THEN 'substring_mismatch' WHEN 4 THEN 'uncertainty_missing' ELSE 'decision_conflict' END AS problem FROM d WHERE case_id % 13 BETWEEN 1 AND 5""")
def annotation_check(texts):
    bad = lambda n, a, b: F.when(F.expr(f"case_id % 13 = {n}"), a).otherwise(b)
    one = F.struct(bad(2, F.lit(""), F.col("lang")).alias("type"), F.lit(5).alias("start"), F.lit(15).alias("end"), bad(3, F.lit("?"), F.substring("text", 6, 10)).alias("text"))
    two = F.struct(F.lit("B").alias("type"), bad(1, F.lit(14), F.lit(15)).alias("start"), F.lit(20).alias("end"), F.substring(F.col("text"), bad(1, F.lit(15), F.lit(16)), bad(1, F.lit(6), F.lit(5))).alias("text"))
    return R.annotation_problems(texts.select("case_id", "text", bad(5, F.lit("negative"), F.lit("positive")).alias("decision"), bad(4, F.lit(None).cast("boolean"), F.lit(False)).alias("uncertain"), F.array(one, two).alias("entities")))


@_query("SELECT case_id, string_agg(CASE WHEN p.b THEN '*' ELSE c END, '' ORDER BY pos) AS masked FROM (SELECT case_id, unnest(range(length(text)))::INT AS pos, substr(text, pos + 1, 1) AS c FROM d WHERE case_id % 10 = 0) LEFT JOIN places p USING (case_id, pos) GROUP BY case_id", "before_p")
def mask_from_points(texts, before):
    return R.mask_points(texts.where("case_id % 10 = 0"), before)


@_query("""SELECT DISTINCT case_id, CASE type WHEN 'en' THEN 'X' WHEN 'de' THEN 'X' WHEN 'B' THEN 'Y' ELSE 'UNMAPPED:' || type END AS type, start, "end" FROM before_s""", "before")
def family_spans(texts, before):
    mapping = texts.sparkSession.createDataFrame([("en", "X"), ("de", "X"), ("B", "Y")], "type string, family string")
    return R.map_types(before, mapping, keep_unmapped=True)


@_query("SELECT case_id FROM d WHERE case_id NOT IN (SELECT case_id FROM gold_s WHERE type NOT IN ('en', 'B'))", "gold")
def whole_cases(texts, gold):
    return R.whole_cases(texts, gold, ["en", "B"]).select("case_id")


@_query("""SELECT case_id, type, min(start)::INT AS start, max("end")::INT AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY case_id, type ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM (
SELECT s.*, CASE WHEN r IS NULL OR (start >= r AND NOT regexp_full_match(substr(text, r + 1, start - r), '\\s*')) THEN 1 ELSE 0 END AS n FROM (SELECT *, max("end") OVER (PARTITION BY case_id, type ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (
SELECT case_id, 'W' AS type, unnest([0, 3, 8, 14])::INT AS start, unnest([3, 6, 13, 20])::INT AS "end" FROM d)) s JOIN d USING (case_id))) GROUP BY case_id, type, i""")
def adjacent_spans(texts):
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (3, 6), (8, 13), (14, 20))])).alias("x")
    return R.join_adjacent(texts.select("case_id", F.lit("W").alias("type"), pairs).select("case_id", "type", "x.*"), texts)


_MOVES = "SELECT b.case_id, a.fp - b.fp AS fp_change, a.fn - b.fn AS fn_change, b.fp + b.fn = 0 AS be, a.fp + a.fn = 0 AS ae FROM counts_b b JOIN counts_a a USING (case_id)"


@_query(f"""SELECT case_id, fp_change, fn_change, CASE WHEN fp_change = 0 AND fn_change = 0 THEN 'equal_error_counts' WHEN fp_change <= 0 AND fn_change <= 0 THEN 'improved' WHEN fp_change >= 0 AND fn_change >= 0 THEN 'regressed' ELSE 'mixed_tradeoff' END AS verdict,
CASE WHEN ae AND NOT be THEN 'became_exact' WHEN be AND NOT ae THEN 'lost_exact' END AS flip FROM ({_MOVES})""", "gold_p", "before_p", "after_p")
def case_comparison(texts, gold, before, after):
    return R.compare_cases(R.case_counts(texts, gold, before), R.case_counts(texts, gold, after))


@_query("""SELECT case_id, count(*) FILTER (k = 1) AS false_positive, count(*) FILTER (k = 0) AS false_negative FROM ((SELECT *, 0 AS k FROM (FROM gold_s EXCEPT FROM before_s)) UNION ALL (SELECT *, 1 AS k FROM (FROM before_s EXCEPT FROM gold_s))) GROUP BY case_id ORDER BY case_id LIMIT 5""", "gold", "before")
def first_errors(texts, gold, before):
    return R.first_errors(gold, before)


@_query("""SELECT case_id, visit, ((visit + ('0x' || substr(md5('7/' || case_id || '/' || visit), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / weight)::DOUBLE AS "at" FROM (SELECT case_id, weight, unnest(range((ceil(weight * 2))::BIGINT))::INT AS visit FROM (SELECT case_id, (1 + case_id % 3)::DOUBLE AS weight FROM d WHERE case_id % 20 = 0)) WHERE "at" < 2""")
def visiting_order(texts):
    return R.visiting_order(texts.where("case_id % 20 = 0").withColumn("weight", F.expr("cast(1 + case_id % 3 as double)")), "case_id", "weight", 2, 7)


@_query("""SELECT "group", metric, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f FROM (
SELECT lang AS "group", 'character' AS metric, count(*) FILTER (g AND b) AS tp, count(*) FILTER (NOT g AND b) AS fp, count(*) FILTER (g AND NOT b) AS fn FROM places JOIN d USING (case_id) WHERE g OR b GROUP BY ALL
UNION ALL SELECT lang, m, count(*) FILTER (g AND b), count(*) FILTER (NOT g), count(*) FILTER (NOT b) FROM (SELECT case_id, m, type, start, "end", bool_or(k = 0) AS g, bool_or(k = 1) AS b FROM (SELECT *, 0 AS k FROM gold_s UNION ALL SELECT *, 1 FROM before_s), (SELECT unnest(['exact', 'joined']) AS m) GROUP BY ALL) JOIN d USING (case_id) GROUP BY ALL)""", "gold", "before")
def triple_scores(texts, gold, before):
    return R.triple_scores(texts, gold, before, "lang")


@_query("""SELECT case_id, count(x.score) FILTER (y.score IS NOT NULL) AS matched, count(*) FILTER (y.score IS NULL) AS missing, count(*) FILTER (x.score IS NULL) AS extra, round(coalesce(max(abs(x.score - y.score)), 0), 6) AS largest, round(coalesce(avg(abs(x.score - y.score)), 0), 6) AS mean
FROM (SELECT *, (case_id % 10) / 10.0::DOUBLE AS score FROM before_s) x FULL JOIN (SELECT *, (case_id % 8) / 8.0::DOUBLE AS score FROM after_s) y USING (case_id, type, start, "end") GROUP BY case_id""", "before", "after")
def prediction_parity(texts, before, after):
    return R.parity(before.withColumn("score", F.expr("(case_id % 10) / 10.0D")), after.withColumn("score", F.expr("(case_id % 8) / 8.0D")))


_TRANSITIONS = """SELECT case_id, lost_tp, gained_tp, new_fp, removed_fp, wb > 0 AND wa = 0 AS became_exact, wb = 0 AND wa > 0 AS lost_exact, ng = 0 AND nb = 0 AND na > 0 AS new_negative_alarm, ng = 0 AND nb > 0 AND na = 0 AS recovered_negative FROM (
SELECT d.case_id, count(*) FILTER (g AND b AND NOT a) AS lost_tp, count(*) FILTER (g AND a AND NOT b) AS gained_tp, count(*) FILTER (NOT g AND a AND NOT b) AS new_fp, count(*) FILTER (NOT g AND b AND NOT a) AS removed_fp,
count(*) FILTER (g) AS ng, count(*) FILTER (b) AS nb, count(*) FILTER (a) AS na, count(*) FILTER (b <> g) AS wb, count(*) FILTER (a <> g) AS wa FROM d LEFT JOIN places USING (case_id) GROUP BY d.case_id)"""


@_query(_TRANSITIONS, "gold_p", "before_p", "after_p")
def case_transitions(texts, gold, before, after):
    return R.case_transitions(texts, gold, before, after)


@_query(f"""SELECT lang AS stratum, sum(lost_tp)::BIGINT AS lost_tp, sum(gained_tp)::BIGINT AS gained_tp, sum(new_fp)::BIGINT AS new_fp, sum(removed_fp)::BIGINT AS removed_fp, count(*) FILTER (lost_tp > 0) AS cases_with_lost_tp, count(*) FILTER (new_fp > 0) AS cases_with_new_fp,
count(*) FILTER (lost_tp > 0 OR new_fp > 0) AS cases_with_any_regression FROM ({_TRANSITIONS}) JOIN d USING (case_id) GROUP BY lang""", "gold_p", "before_p", "after_p")
def change_audit(texts, gold, before, after):
    return R.change_audit(texts, gold, before, after, "lang")


@_query("""SELECT 'gold' AS side, type, count(*) FILTER (b AND NOT a) AS new_fn, count(*) FILTER (a AND NOT b) AS recovered_fn, 0::BIGINT AS new_fp FROM gold_p JOIN places USING (case_id, pos) GROUP BY type
UNION ALL SELECT 'predicted', type, 0, 0, count(*) FILTER (NOT b AND NOT g) FROM after_p JOIN places USING (case_id, pos) GROUP BY type""", "gold_p", "before_p", "after_p")
def error_deltas(texts, gold, before, after):
    return R.error_deltas(texts, gold, before, after)


@_query("SELECT coalesce(g, 'ALL') AS gold, coalesce(p, 'ALL') AS predicted, count(*) AS n FROM (SELECT coalesce(x.type, 'NONE') AS g, coalesce(y.type, 'NONE') AS p FROM gold_p x FULL JOIN before_p y USING (case_id, pos)) GROUP BY CUBE (g, p)", "gold_p", "before_p")
def type_matrix(texts, gold, before):
    return R.type_matrix(gold, before)


@_query("SELECT type, count(*) AS gold_characters, count(*) FILTER (b) AS reference_tp, count(*) FILTER (a) AS candidate_tp, count(*) FILTER (a AND NOT b) AS gained_tp, count(*) FILTER (b AND NOT a) AS lost_tp FROM gold_p JOIN places USING (case_id, pos) GROUP BY type", "gold_p", "before_p", "after_p")
def type_attribution(texts, gold, before, after):
    return R.attribution(gold, before, after)


@_query("""SELECT type, reason, count(*) AS n FROM (SELECT m.type, CASE WHEN count(p.pos) = 0 THEN 'unmasked' WHEN count(p.pos) = count(*) FILTER (same) THEN 'boundary' WHEN count(p.pos) = count(*) FILTER (hit) THEN 'wrong_type' WHEN count(*) FILTER (hit) > 0 THEN 'partly_masked' ELSE 'unmasked' END AS reason
FROM (FROM gold_s EXCEPT FROM before_s) m LEFT JOIN (SELECT x.case_id, x.type, x.pos, bool_or(y.pos IS NOT NULL) AS hit, bool_or(y.type = x.type) IS TRUE AS same FROM gold_p x LEFT JOIN before_p y USING (case_id, pos) GROUP BY ALL) p ON p.case_id = m.case_id AND p.type = m.type AND p.pos >= m.start AND p.pos < m."end"
GROUP BY m.case_id, m.type, m.start, m."end") GROUP BY type, reason""", "gold", "before")
def strict_misses(texts, gold, before):
    return R.strict_misses(texts, gold, before)


@_query("""SELECT 'second' AS stage, count(*) FILTER (b AND NOT a AND g) AS lost_gold, count(*) FILTER (b AND NOT a AND NOT g) AS lost_other, count(*) FILTER (a AND NOT b) AS added FROM places WHERE a OR b""", "gold_p", "before_p", "after_p")
def stage_losses(texts, gold, before, after):
    stages = before.select("case_id", F.lit("first").alias("stage"), "pos").union(after.select("case_id", F.lit("second").alias("stage"), "pos"))
    return R.stage_losses(stages, gold, ["first", "second"])


@_query("""SELECT x.type, y.type AS winner, count(*) AS n FROM before_s x JOIN after_s y ON x.case_id = y.case_id AND x.start < y."end" AND y.start < x."end" AND (x.start <> y.start OR x."end" <> y."end" OR x.type <> y.type) GROUP BY ALL""", "before", "after")
def displaced_spans(texts, before, after):
    return R.displaced(before, after)


@_query("""SELECT count(*) AS documents, sum(n)::BIGINT AS entities, max(n) AS most_entities, count(*) FILTER (n > 1) AS documents_over_limit, max(l)::BIGINT AS longest_span FROM (SELECT d.case_id, count(s.type) AS n, coalesce(max(s."end" - s.start), 0) AS l FROM d LEFT JOIN before_s s USING (case_id) GROUP BY d.case_id)""", "before")
def contract_profile(texts, before):
    return R.contract_profile(texts, before, most=1)


@_query("SELECT count(*) AS n_unique, sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS n_groups, sum(n - 1)::BIGINT AS n_extra, sum(n * (n - 1) // 2)::BIGINT AS n_pairs, max(n) AS largest FROM (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, count(*) AS n FROM d GROUP BY t)")
def normalized_duplicates(texts):
    return E.duplicate_groups(texts, R.normalized(F.col("text")))


@_query("""SELECT case_id, type, "position" AS pos FROM (SELECT case_id, type, unnest(range(start, "end"))::INT AS "position" FROM before_s)""", "before")
def span_characters(texts, before):
    return E.characters(before, texts, alnum=False).select("case_id", "type", "pos")


@_query("""SELECT case_id, 'positive' AS decision, 1 + case_id % 5 AS traffic_weight, substr(text, 1, 5) || regexp_replace(substr(text, 6, 10), '[\\p{L}\\p{N}]', '*', 'g') || substr(text, 16) AS expected_masked FROM d WHERE case_id % 3 = 0""")
def gold_build(texts):
    notes = texts.where("case_id % 3 = 0").select("case_id", F.array(F.struct(F.lit(5).alias("start"), F.lit(15).alias("end"), F.col("lang").alias("type"))).alias("entities"))
    return R.gold_build(texts, notes, texts.select("case_id", F.expr("1 + case_id % 5").alias("traffic_weight"))).select("case_id", "decision", "traffic_weight", "expected_masked")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
