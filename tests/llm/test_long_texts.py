"""Repeated passages at places that need more bits than a packed position has."""

import random

import numpy as np

from textloom.llm import suffix_dedup


def _copies():
    rnd = random.Random(11)
    text = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    passage = text(900)
    return text(5000) + passage + text(700), text(300) + passage + text(400)


def _grams(w: suffix_dedup.Windows, doc: int, at: int, n: int) -> list[int]:
    out = {}
    for d, lo, k, g in zip(w.doc, w.lo, w.n, w.gram):
        out |= {(int(d), x): int(g) for x in range(lo, lo + k)}
    return [out[doc, x] for x in range(at, at + n)]


def test_anchors_beyond_the_packed_position(monkeypatch):
    one, two = _copies()
    want = suffix_dedup.Windows([one, two])
    monkeypatch.setattr(suffix_dedup, "_POSITION", 8)
    got = suffix_dedup.Windows([one, two])
    assert _grams(got, 0, 5000, 501) == _grams(got, 1, 300, 501)
    for name in ("doc", "lo", "n", "gram", "whole"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name


def test_long_texts_in_parts(monkeypatch):
    one, two = _copies()
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    monkeypatch.setattr(suffix_dedup, "PART", 2000)
    rows = [(int(d), x, int(g)) for w in suffix_dedup._parts([two, one], 400, 200) for d, lo, n, g in zip(w.doc, w.lo, w.n, w.gram) for x in range(lo, lo + n)]
    assert sorted((d, x) for d, x, _ in rows) == [(d, x) for d, t in ((0, two), (1, one)) for x in range(len(t) - 399)]
    grams = {(d, x): g for d, x, g in rows}
    assert [grams[0, 300 + k] for k in range(501)] == [grams[1, 5000 + k] for k in range(501)]
