"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) with token weights. The
table of cells is raked until its source, language and topic marginals equal
the targets; a cell's factor is its raked weight over its own. Documents are
then sampled with the probability `rate * factor`, at most 1, where `rate` is
chosen so that the expected tokens are `share` of all tokens. The draw is a
hash of id and text, so a rerun or a lost executor draws the same rows.

Targets default to the observed shares raised to a power below 1, which takes
weight from a dominating source. Only the table of cells is used for fitting;
up to MAX_CELLS cells it is fitted in the driver, beyond that as DataFrames
with one factor for each category in the driver, and where a margin has over
MAX_CATEGORIES of them as DataFrames alone; always to the same tolerance,
rounds and rate.

A null source or language is a category of its own; null and empty texts have
0 tokens and the topic "empty", cells without tokens have the factor 1. Equal
rows draw alike. Empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import discard, materialize

MARGINS = ("source", "lang", "topic")
#: Powers of the observed shares that are the default targets.
POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.9}
SHARE, SEED = 0.6, 17
BYTES_PER_TOKEN = 4
MAX_CELLS, MAX_CATEGORIES, ROUNDS, TOLERANCE = 100_000, 1_000_000, 200, 1e-9
#: Rates tried in one pass over a table of cells too large for the driver.
RATES = 64
NULL = "\x00null"


def token_weight(text: Column) -> Column:
    """Estimated tokens of a text: its bytes over BYTES_PER_TOKEN."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / BYTES_PER_TOKEN).cast("long")


def topic(text: Column) -> Column:
    """The kind of text: empty, table, symbols, or prose by length."""
    size = F.octet_length(text)
    count = lambda marks: size - F.octet_length(F.replace(text, F.lit(marks), F.lit("")))
    symbols = sum((count(m) for m in "#*$%&"), F.lit(0))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(count("|") * 50 > size, "table").when(symbols * 20 > size, "symbols").when(size < 1000, "short prose").when(size < 8000, "prose").otherwise("long prose")
    )


def cells_of(docs: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """All rows of docs as `row`, with cell columns and tokens."""
    text = F.col("text")
    own = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(c) for c in ("source", "lang")]
    return docs.select(F.struct("*").alias("row"), *own, F.coalesce(topic_of if topic_of is not None else topic(text), F.lit(NULL)).alias("topic"), token_weight(text).alias("tokens"))


def default_targets(weights: dict[str, dict]) -> dict[str, dict]:
    """Observed shares of each margin raised to its power, adding up to 1."""
    out = {}
    for name, observed in weights.items():
        powered = {k: v ** POWERS[name] for k, v in observed.items() if v > 0}
        total = sum(powered.values()) or 1.0
        out[name] = {k: v / total for k, v in powered.items()}
    return out


def _scaled(targets: dict[str, dict], observed: dict[str, dict]) -> dict[str, dict]:
    """Targets of the categories that have tokens, adding up to the tokens of all."""
    total = float(sum(next(iter(observed.values())).values()))
    out = {}
    for name, want in targets.items():
        here = {k: max(0.0, want.get(k, 0.0)) for k, v in observed[name].items() if v > 0}
        mass = sum(here.values())
        out[name] = {k: v / mass * total if mass else observed[name][k] for k, v in here.items()}
    return out


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Raked weights of cells whose margins have the given codes and target totals."""
    w = tokens.astype(float)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets):
            have = np.bincount(code, weights=w, minlength=len(target))
            ratio = np.divide(target, have, out=np.ones(len(target)), where=have > 0)
            worst = max(worst, float(np.abs(ratio - 1).max(initial=0)))
            w = w * ratio[code]
        if worst < TOLERANCE:
            break
    return w


def _margin_sums(cells: DataFrame, factors: list[np.ndarray], margin: int) -> np.ndarray:
    """Weight of each category of one margin, with the factors of all margins applied."""
    size = len(factors[margin])

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            code = [batch.column(f"code{i}").to_numpy() for i in range(len(MARGINS))]
            w = batch.column("tokens").to_numpy().astype(float)
            for f, c in zip(factors, code):
                w = w * f[c]
            total += np.bincount(code[margin], weights=w, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "w"])

    sums = cells.mapInArrow(run, "code long, w double").groupBy("code").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(size)
    out[sums.column("code").to_numpy()] = sums.column("w").to_numpy()
    return out


def _rake_frames(cells: DataFrame, targets: dict[str, dict], names: dict[str, list]) -> DataFrame:
    """The same for a table of cells too large for the driver, which holds one factor for each category only: cells with their factor, written to the shared folder."""

    def code(batches):
        for batch in batches:
            codes = [pc.index_in(batch.column(m), pa.array(names[m], pa.string())).cast(pa.int64()) for m in MARGINS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *codes], [*batch.schema.names, *(f"code{i}" for i in range(len(MARGINS)))])

    kinds = "source string, lang string, topic string, tokens long"
    coded, path = materialize(cells.select(*MARGINS, "tokens").mapInArrow(code, kinds + ", code0 long, code1 long, code2 long"), "codes")
    want = [np.array([targets[m].get(k, 0.0) for k in names[m]], float) for m in MARGINS]
    factors = [np.ones(len(names[m])) for m in MARGINS]
    for _ in range(ROUNDS):
        worst = 0.0
        for i, target in enumerate(want):
            have = _margin_sums(coded, factors, i)
            ratio = np.divide(target, have, out=np.ones(len(target)), where=have > 0)
            worst = max(worst, float(np.abs(ratio - 1).max(initial=0)))
            factors[i] = factors[i] * ratio
        if worst < TOLERANCE:
            break

    def apply(batches):
        for batch in batches:
            w = np.ones(batch.num_rows)
            for i, f in enumerate(factors):
                w = w * f[batch.column(f"code{i}").to_numpy()]
            w[batch.column("tokens").to_numpy() == 0] = 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(w)], [*batch.schema.names[:4], "factor"])

    raked, _ = materialize(coded.mapInArrow(apply, kinds + ", factor double"), "raked")
    discard(cells.sparkSession, path)
    return raked


def _target_frames(cells: DataFrame, targets: dict[str, dict] | None) -> dict[str, DataFrame]:
    """category, target tokens of each margin, as default_targets() and _scaled() have them."""
    spark, out = cells.sparkSession, {}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for m in MARGINS:
        observed = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
        if targets is None:
            wanted = observed.select(m, F.pow("n", F.lit(POWERS[m])).alias("want"))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()] or [("", 0.0)], f"{m} string, want double")
            wanted = observed.join(given, m, "left").select(m, F.greatest(F.lit(0.0), F.coalesce("want", F.lit(0.0))).alias("want"))
        mass = float(wanted.agg(F.sum("want")).first()[0] or 0)
        frame = wanted.select(m, (F.col("want") / mass * total).alias("want")) if mass else observed.select(m, F.col("n").alias("want"))
        out[m] = materialize(frame, "targets")[0]
    return out


def _rake_joins(cells: DataFrame, targets: dict[str, dict] | None) -> DataFrame:
    """The same where a margin's categories are too many for the driver: factors are joined, nothing but a round's worst ratio leaves the executors."""
    spark, want = cells.sparkSession, _target_frames(cells, targets)
    now, path = materialize(cells.select(*MARGINS, "tokens", F.col("tokens").cast("double").alias("w")), "raked")
    for _ in range(ROUNDS):
        worst = 0.0
        for m in MARGINS:
            have = now.groupBy(m).agg(F.sum("w").alias("have"))
            ratio, ratio_path = materialize(have.join(want[m], m, "left").select(m, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias("ratio")), "ratios")
            worst = max(worst, float(ratio.agg(F.max(F.abs(F.col("ratio") - 1))).first()[0] or 0))
            after, new = materialize(now.join(ratio, m).select(*MARGINS, "tokens", (F.col("w") * F.col("ratio")).alias("w")), "raked")
            discard(spark, path, ratio_path)
            now, path = after, new
        if worst < TOLERANCE:
            break
    factor = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)
    raked, _ = materialize(now.select(*MARGINS, "tokens", factor.alias("factor")), "raked")
    discard(spark, path)
    return raked


def rate_for(tokens: np.ndarray, factor: np.ndarray, share: float) -> float:
    """The rate at which sampling with min(1, rate * factor) expects `share` of all tokens (or all that can be had)."""
    want = share * tokens.sum()
    low, high = 0.0, 1.0
    got = lambda r: float((tokens * np.minimum(1.0, r * factor)).sum())
    if got(np.inf if (factor > 0).all() else 1e18) <= want:
        return 1e18
    while got(high) < want:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if got(mid) < want else (low, mid)
    return high


def _expected(raked: DataFrame, rates: np.ndarray) -> np.ndarray:
    """Expected tokens at each rate."""

    def run(batches):
        total = np.zeros(len(rates))
        for batch in batches:
            tokens, factor = batch.column("tokens").to_numpy().astype(float), batch.column("factor").to_numpy()
            total += [float((tokens * np.minimum(1.0, r * factor)).sum()) for r in rates]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rates))), pa.array(total)], ["at", "n"])

    sums = raked.select("tokens", "factor").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(rates))
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return out


def _rate_frames(raked: DataFrame, total: float, share: float) -> float:
    """rate_for() for a table of cells too large for the driver: many rates in each pass."""
    want = share * total
    positive = raked.where("factor <= 0").isEmpty()
    most = total if positive else float(_expected(raked, np.array([1e18]))[0])
    if most <= want:
        return 1e18
    low, high = 0.0, 0.0
    for k in range(0, 1024, RATES):
        tried = 2.0 ** np.arange(k, min(k + RATES, 1024))
        enough = np.flatnonzero(_expected(raked, tried) >= want)
        if len(enough):
            high = float(tried[enough[0]])
            break
    else:
        return 1e18
    for _ in range(40):  # RATES + 1 parts of the range in each pass: as fine as 200 halvings
        tried = low + (high - low) * np.arange(1, RATES + 1) / (RATES + 1)
        tried = tried[(tried > low) & (tried < high)]
        if not len(tried) or high - low <= 1e-15 * high:
            break
        enough = np.flatnonzero(_expected(raked, tried) >= want)
        first = int(enough[0]) if len(enough) else len(tried)
        low, high = float(tried[first - 1]) if first else low, float(tried[first]) if first < len(tried) else high
    return high


def probabilities(cells: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE, max_cells: int = MAX_CELLS, max_categories: int = MAX_CATEGORIES) -> tuple[DataFrame, bool]:
    """(source, lang, topic, factor, probability of every cell; whether the table is within max_cells)."""
    spark = cells.sparkSession
    cells, _ = materialize(cells.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    few = cells.count() <= max_cells
    if not few and max(cells.select(m).distinct().count() for m in MARGINS) > max_categories:
        raked, total = _rake_joins(cells, targets), float(cells.agg(F.sum("tokens")).first()[0] or 0)
        rate = _rate_frames(raked, total, share) if total > 0 else 1.0
        return raked.select(*MARGINS, "factor", F.least(F.lit(1.0), rate * F.col("factor")).alias("probability")), few
    observed = {m: {r[m]: float(r["n"]) for r in cells.groupBy(m).agg(F.sum("tokens").alias("n")).collect()} for m in MARGINS}
    want = _scaled(targets or default_targets(observed), observed)
    schema = "source string, lang string, topic string, factor double, probability double"
    if not few:
        total = sum(observed["source"].values())
        raked = _rake_frames(cells, want, {m: sorted(observed[m]) for m in MARGINS})
        rate = _rate_frames(raked, total, share) if total > 0 else 1.0
        return raked.select(*MARGINS, "factor", F.least(F.lit(1.0), rate * F.col("factor")).alias("probability")), few
    rows = sorted(cells.collect(), key=lambda r: tuple(r[m] for m in MARGINS))
    tokens = np.array([r["tokens"] for r in rows], float)
    codes, totals = [], []
    for m in MARGINS:
        names = sorted({r[m] for r in rows})
        place = {k: i for i, k in enumerate(names)}
        codes.append(np.array([place[r[m]] for r in rows], int))
        totals.append(np.array([want[m].get(k, 0.0) for k in names], float))
    w = rake(tokens, codes, totals) if len(rows) else tokens
    factor = np.divide(w, tokens, out=np.ones(len(tokens)), where=tokens > 0)
    rate = rate_for(tokens, factor, share) if tokens.sum() > 0 else 1.0
    out = [(*(r[m] for m in MARGINS), float(f), float(min(1.0, rate * f))) for r, f in zip(rows, factor)]
    return spark.createDataFrame(out, schema), few


def mix_sources(docs: DataFrame, targets: dict[str, dict] | None = None, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """row (all columns of docs), topic, tokens, factor, probability, sampled of every row of docs."""
    rows = cells_of(docs)
    cells, few = probabilities(rows.select(*MARGINS, "tokens"), targets, share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("row.text")), 11).cast("double") / float(1 << 53)
    # at most MAX_CELLS short rows are broadcast
    joined = rows.join(F.broadcast(cells) if few else cells, list(MARGINS))
    return joined.select("row", "topic", "tokens", "factor", "probability", (draw < F.col("probability")).alias("sampled"))


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, sampled of every row of docs."""
    rows = mix_sources(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")), **parameters)
    return rows.select("row.doc_id", "row.source", "row.lang", "topic", F.col("tokens").alias("n_tokens"), "factor", "probability", "sampled")
