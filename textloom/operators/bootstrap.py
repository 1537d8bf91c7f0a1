"""Paired bootstrap of scores, one pass over the cases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

DRAWS, SEED = 2000, 20260922


def _weights(cases, draws: int, seed: int):
    """Poisson(1) counts of every case in every draw, from a hash of both: the same on every run and partition."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = cases.astype(np.uint64)[:, None] ^ (np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    k = np.arange(20)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(k, 1)))
    return np.searchsorted(steps, (x >> np.uint64(11)) / 2.0**53, side="right")


def draws_of_f1(cases: DataFrame, draws: int = DRAWS, seed: int = SEED, stratum: str | None = None) -> DataFrame:
    """system, draw, f1 from cases (case_id, system, tp, fp, fn). All systems share a case's weight in a draw.

    stratum: a column whose groups keep their sizes in every draw. A partition gives one row for each system, stratum and
    draw, so what is shuffled doesn't grow with the cases.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        sums: dict = {}
        size: dict = {}
        for batch in batches:
            for group, rows in batch.groupby(["system", "stratum"]):
                for at in range(0, len(rows), 512):
                    part = rows.iloc[at : at + 512]
                    w = _weights(part["h"].to_numpy(), draws, seed)
                    sums[group] = sums.get(group, 0) + w.T @ part[["tp", "fp", "fn", "one"]].to_numpy(dtype=np.int64)
                size[group] = size.get(group, 0) + len(rows)
        for (system, name), s in sums.items():
            yield pd.DataFrame({"system": system, "stratum": name, "draw": np.arange(draws), "tp": s[:, 0], "fp": s[:, 1], "fn": s[:, 2], "w": s[:, 3], "n": size[system, name]})

    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    hashed = cases.select("system", group.alias("stratum"), F.xxhash64("case_id").alias("h"), *[F.col(c).cast("long") for c in ("tp", "fp", "fn")], F.lit(1).cast("long").alias("one"))
    parts = hashed.mapInPandas(add, "system string, stratum string, draw long, tp long, fp long, fn long, w long, n long")
    strata = parts.groupBy("system", "stratum", "draw").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "w", "n")])
    # a stratum's sums are scaled to its own size; one that a draw leaves out has none
    scale = F.when(F.col("w") > 0, F.col("n") / F.col("w")).otherwise(0.0) if stratum else F.lit(1.0)
    total = strata.groupBy("system", "draw").agg(*[F.sum(F.col(c) * scale).alias(c) for c in ("tp", "fp", "fn")])
    size = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return total.select("system", "draw", F.when(size > 0, 2 * F.col("tp") / size).otherwise(0.0).alias("f1"))


def intervals(cases: DataFrame, reference: str, draws: int = DRAWS, seed: int = SEED, stratum: str | None = None) -> DataFrame:
    """system, low, high of F1 and, against the reference system, low and high of the difference and the share of draws above it.

    Cases are resampled by independent Poisson counts, the one-pass form of resampling with replacement; with `stratum` every draw is scaled to the strata's sizes.
    """
    each = draws_of_f1(cases, draws, seed, stratum)
    base = each.where(F.col("system") == reference).select("draw", F.col("f1").alias("base"))
    q = lambda c, p: F.round(F.percentile(c, p), 6)
    gain = F.col("f1") - F.col("base")
    return each.join(base, "draw").groupBy("system").agg(
        q("f1", 0.025).alias("low"), q("f1", 0.975).alias("high"), q(gain, 0.025).alias("gain_low"), q(gain, 0.975).alias("gain_high"), F.round(F.avg((gain > 0).cast("int")), 6).alias("better")
    )
