import numpy as np
import pytest

from textloom.operators import analyzers as A


class Names:
    """Calls every capitalized run of letters a person."""

    def analyze(self, texts):
        import re

        return [[{"start": m.start(), "end": m.end(), "score": 0.5, "entity_type": "PERSON"} for m in re.finditer(r"[A-Z][a-z]+", t)] for t in texts]


class Broken:
    def __init__(self, out):
        self.out = out

    def analyze(self, texts):
        if isinstance(self.out, Exception):
            raise self.out
        return self.out


def test_windows_find_what_one_window_finds(monkeypatch):
    text = " ".join(f"x{'y' * (i % 7)} Name{'e' * (i % 5)} z" for i in range(400))
    monkeypatch.setattr(A, "windows", lambda n, width=300, overlap=40: [(0, n)] if n <= width else [(a, min(a + width, n)) for a in range(0, n - overlap, width - overlap)])
    cut = A.analyze_texts([text], Names(), ("PERSON",))[0][0]
    assert cut == A.result(Names().analyze([text])[0], ("PERSON",))


@pytest.mark.parametrize("out", [RuntimeError(), [], [[{"start": 0, "end": 99, "score": 0.5, "entity_type": "PERSON"}]], [[{"start": True, "end": 2, "score": 0.5, "entity_type": "PERSON"}]], [[{"start": 0, "end": 2, "score": 0.5, "entity_type": "CITY"}]], [[{"start": 0, "end": 2}]], BlockingIOError()])
def test_bad_output_gives_an_error_and_no_spans(out):
    assert A.analyze_texts(["Some text"], Broken(out), ("PERSON",)) == [(None, "temporarily_unavailable")]


def test_analyze_as_a_column(spark):
    rows = A.analyze(spark.createDataFrame([(1, "by Ann and Bob"), (2, None)], "id int, text string"), Names, ["PERSON"]).collect()
    assert [(s["start"], s["end"]) for s in rows[0]["model"]] == [(3, 6), (11, 14)] and rows[1]["model"] == [] and rows[0]["model_error"] is None
    with pytest.raises(A.BadOutput):
        A.known_types(["PERSON", "PERSON"])


def test_subword_windows_own_every_word_once():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        words = rnd.integers(1, 9, rnd.integers(1, 400)).tolist()
        cut = A.subword_windows(words, 60, 16)
        owned = [i for _, _, a, b in cut for i in range(a, b)]
        assert owned == list(range(len(words)))
        assert all(a <= own and until <= b for a, b, own, until in cut)
        assert all(sum(words[a:b]) <= 60 or b == a + 1 for a, b, _, _ in cut)


def test_labels_and_types():
    got = A.word_labels(np.array([[0.0, 2.0], [3.0, 0.0], [9.0, 9.5]]), [0, 2], ["O", "B-CITY"])
    assert [g[0] for g in got] == ["B-CITY", "B-CITY"] and got[0][1] == pytest.approx(np.exp(2) / (1 + np.exp(2)))
    text = "Ann  Lee, Ufa"
    native = [{"start": 0, "end": 3, "label": "FIRST_NAME", "score": 0.5, "text": "Ann"}, {"start": 5, "end": 8, "label": "LAST_NAME", "score": 0.9, "text": "Lee"}, {"start": 10, "end": 13, "label": "CITY", "score": 0.4, "text": "Ufa"}]
    assert [(s["start"], s["end"], s["entity_type"], s["score"]) for s in A.to_types(text, native)] == [(0, 8, "PERSON", 0.9), (10, 13, "LOCATION", 0.4)]
    with pytest.raises(A.BadOutput):
        A.validate_native(text, native[::-1])
    asked = [{"start": 0, "end": 3, "label": "name", "score": 0.2}, {"start": 0, "end": 3, "label": "name", "score": 0.6}, {"start": 0, "end": 3, "label": "firm", "score": 0.9}]
    assert A.parse_schema_model(asked, {"name": "PERSON", "firm": "ORGANIZATION"}, len(text)) == [{"start": 0, "end": 3, "score": 0.6, "entity_type": "PERSON"}]
