"""Evaluation of span predictions, gates and reports as aggregations.

Gold and predicted spans are rows (case_id, type, start, end). Scores round to 6 places at the end only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["case_id", "type", "start", "end"]


def span_outcomes(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each distinct span of either side: KEY, in_gold, in_predicted."""
    g = gold.select(*KEY).distinct().withColumn("g", F.lit(True))
    p = predicted.select(*KEY).distinct().withColumn("p", F.lit(True))
    return g.join(p, KEY, "full_outer").select(*KEY, F.coalesce("g", F.lit(False)).alias("in_gold"), F.coalesce("p", F.lit(False)).alias("in_predicted"))


def counts() -> list[Column]:
    return [
        F.count_if(F.col("in_gold") & F.col("in_predicted")).alias("tp"),
        F.count_if(~F.col("in_gold") & F.col("in_predicted")).alias("fp"),
        F.count_if(F.col("in_gold") & ~F.col("in_predicted")).alias("fn"),
    ]


def scores(table: DataFrame, convention: str = "external", beta: float = 1.0) -> DataFrame:
    """table (tp, fp, fn) with precision, recall, f.

    convention "external": a ratio without a denominator is 0. "development": precision is 1 when nothing was
    predicted and nothing missed, recall is 1 when there is no gold span.
    """
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    empty_p, empty_r = (F.when(fn == 0, 1.0).otherwise(0.0), F.lit(1.0)) if convention == "development" else (F.lit(0.0), F.lit(0.0))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(empty_p)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(empty_r)
    f = F.when(p + r > 0, (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)
    return table.select(*table.columns, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f"))


def by_type(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts and scores of every type and, with the type "ALL", of all."""
    rows = span_outcomes(gold, predicted)
    total = rows.rollup("type").agg(*counts(), F.grouping("type").alias("all"))
    return scores(total.select(F.when(F.col("all") == 1, F.lit("ALL")).otherwise(F.col("type")).alias("type"), "tp", "fp", "fn"))


def covered_characters(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """case_id, type, pos: the letters and numbers that spans cover, once each."""
    return characters(spans, texts).select("case_id", "type", "pos").distinct()


def characters(spans: DataFrame, texts: DataFrame, alnum: bool = True) -> DataFrame:
    """The columns of spans and pos: one row for each letter and number (or every character) of each span. Only the value, not the text, is carried along."""
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    joined = spans.join(texts.select("case_id", "text"), "case_id").select(*spans.columns, value.alias("_value")).where("length(_value) > 0")
    each = joined.select(*spans.columns, "_value", F.explode(F.sequence(F.lit(0), F.length("_value") - 1)).alias("_at"))
    kept = each.where(F.substring(F.col("_value"), F.col("_at") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")) if alnum else each
    return kept.withColumn("pos", (F.col("start") + F.col("_at")).cast("int")).drop("_value", "_at")


def islands(rows: DataFrame, partition: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Rows with `island`: runs of intervals that overlap or lie at most `gap` apart, numbered within the partition."""
    order = Window.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn("island", F.sum("_new").over(order)).drop("_new")


def coverage_problems(**tables: DataFrame) -> DataFrame:
    """case_id and the names of the tables it is missing from, for cases that aren't in all tables."""
    names = list(tables)
    marked = [t.select("case_id").distinct().withColumn("name", F.lit(n)) for n, t in tables.items()]
    every = marked[0]
    for m in marked[1:]:
        every = every.union(m)
    have = every.groupBy("case_id").agg(F.collect_set("name").alias("have"))
    return have.select("case_id", F.array_sort(F.array_except(F.array(*map(F.lit, names)), "have")).alias("missing")).where(F.size("missing") > 0)


def regression_gate(now: DataFrame, baseline: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """type and what got worse than the baseline: precision, recall or f below it, more fp."""
    n, b = now.alias("n"), baseline.alias("b")
    worse = [F.when(F.col(f"n.{c}") < F.col(f"b.{c}") - tolerance, F.lit(c)) for c in ("precision", "recall", "f")]
    worse.append(F.when(F.col("n.fp") > F.col("b.fp"), F.lit("fp")))
    joined = b.join(n, F.col("n.type") == F.col("b.type"), "left")
    missing = F.when(F.col("n.type").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*worse)))
    return joined.select(F.col("b.type").alias("type"), missing.alias("worse")).where(F.size("worse") > 0)


def duplicate_groups(texts: DataFrame, text: Column) -> DataFrame:
    """Rows, distinct texts, groups of equal texts, extra rows, pairs and largest group."""
    n = F.col("n")
    groups = texts.groupBy(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum(n).alias("n_rows"), F.count("*").alias("n_unique"), F.count_if(n > 1).alias("n_groups"), F.sum(n - 1).alias("n_extra"), F.sum(F.floor(n * (n - 1) / 2)).cast("long").alias("n_pairs"), F.max(n).alias("largest")
    )


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Texts (column h) that both sides hold: distinct texts, rows of either side, row pairs."""
    a, b = left.groupBy("h").agg(F.count("*").alias("a")), right.groupBy("h").agg(F.count("*").alias("b"))
    return a.join(b, "h").agg(F.count("*").alias("n_shared"), F.coalesce(F.sum("a"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("right_rows"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("row_pairs"))


def latency_summary(rows: DataFrame, group: str, value: str, slow: tuple[float, ...] = (500.0, 1000.0)) -> DataFrame:
    """Interpolated p50, p95, p99, nearest-rank p95, maximum and counts over limits."""
    q = lambda p: F.round(F.percentile(value, p), 6)
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("rank95"), F.max(value).alias("largest"),
        *[F.count_if(F.col(value) > s).alias(f"over_{int(s)}") for s in slow],
    )


def histogram(rows: DataFrame, group: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts by upper bound, one row for each group and bound."""
    wide = rows.groupBy(group).agg(*[F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)])).alias("x")
    return wide.select(group, pairs).select(group, "x.le", "x.n")
