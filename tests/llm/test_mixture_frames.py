"""Both ways of fitting give the same cells, also where raking takes many rounds."""

import random

import numpy as np

from textloom.llm import mixture


def _cells():
    rnd = random.Random(6)
    rows = []
    for i in range(24):  # every source mostly in one language: raking converges slowly
        own = "abc"[i % 3]
        for lang in "abc":
            rows += [(f"s{i:02d}", lang, t, rnd.randint(2000, 90000) if lang == own else rnd.randint(0, 6000)) for t in ("x", "y")]
    return [*rows, ("none", "a", "empty", 0)]


def test_frames_equal_the_driver(spark, monkeypatch):
    cells = spark.createDataFrame(_cells(), "source string, lang string, topic string, tokens long").coalesce(2)
    rounds = []
    bincount = np.bincount
    with monkeypatch.context() as m:
        m.setattr(mixture.np, "bincount", lambda *a, **k: rounds.append(1) or bincount(*a, **k))
        one, few = mixture.probabilities(cells)
    two, many = mixture.probabilities(cells, max_cells=0)
    assert few and not many and len(rounds) > 3 * 20
    key = lambda r: (r["source"], r["lang"], r["topic"])
    a, b = ({key(r): (r["factor"], r["probability"]) for r in df.collect()} for df in (one, two))
    assert a.keys() == b.keys() and b["none", "a", "empty"][0] == 1.0
    assert np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-9, atol=1e-12)


def test_rate_beyond_a_million(spark):
    rows = spark.createDataFrame([(1000, 1e-9), (1000, 2e-8), (10, 1.0)], "tokens long, factor double")
    want = mixture.rate_for(np.array([1000.0, 1000.0, 10.0]), np.array([1e-9, 2e-8, 1.0]), 0.6)
    assert want > 1e6 and abs(mixture._rate_frames(rows, 2010.0, 0.6) / want - 1) < 1e-12
    assert mixture._rate_frames(rows, 2010.0, 1.0) == 1e18


def test_joins_equal_the_driver(spark):
    rnd = random.Random(3)
    rows = [(s, lang, t, rnd.randint(50_000, 60_000)) for s in "pqr" for lang in "ab" for t in "xy"] + [("none", "a", "empty", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").coalesce(1)
    key = lambda r: (r["source"], r["lang"], r["topic"])
    for targets in (None, {"source": {"p": 0.5, "q": 0.5}, "lang": {"a": 0.7, "b": 0.3}, "topic": {"x": 0.4, "y": 0.6}}):
        a, b = ({key(r): (r["factor"], r["probability"]) for r in mixture.probabilities(cells, targets, **how)[0].collect()} for how in ({}, {"max_cells": 0, "max_categories": 0}))
        assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-7, atol=1e-12)
