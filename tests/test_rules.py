import random
import time

import duckdb
import pytest

from textloom.plans import cases
from textloom.rules import engine, merge
from textloom.rules.scan import Span


def _found(text):
    return [(s.type, text[s.start : s.end]) for s in engine.find(text)]


@pytest.mark.parametrize("family", cases.FAMILIES)
def test_cases(family):
    for rule, marked in cases.FAMILIES[family]:
        text, spans = cases.plain(marked)
        assert [(s.type, s.start, s.end) for s in engine.find(text)] == spans, (rule, text)


@pytest.mark.parametrize("change", [str.upper, str.lower])
def test_letter_case_does_not_matter(change):
    skip = {"D36", "M08"}
    for family in ("documents", "identifiers", "dates", "issuers"):
        for rule, marked in cases.FAMILIES[family]:
            text = cases.plain(marked)[0]
            if rule not in skip and len(change(text)) == len(text):
                assert [(s.type, s.start, s.end) for s in engine.find(change(text))] == [(s.type, s.start, s.end) for s in engine.find(text)], (rule, text)


def test_places_count_code_points_and_spans_are_apart():
    rnd = random.Random(5)
    parts = [cases.plain(m)[0] for f in cases.FAMILIES.values() for _, m in f]
    for _ in range(40):
        text = "😊 " + "\n\n".join(rnd.sample(parts, 12))
        spans = engine.find(text)
        assert all(0 <= a.start < a.end <= len(text) for a in spans) and all(a.end <= b.start for a, b in zip(spans, spans[1:]))
        assert spans == engine.find(text)


def test_own_texts_of_the_tables():
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()
    assert {s.type for (t,) in rows for s in engine.find(t)} == {"EMAIL", "PHONE", "CARD", "IP_ADDRESS"}


@pytest.mark.parametrize("text", ["1 " * 50_000, "а " * 50_000, "ул. " * 20_000, "паспорт " * 15_000, "И. " * 30_000, "a@" * 50_000, ": " * 50_000, "серия номер № " * 8_000, "иванович" * 10_000, "«" * 100_000, "адрес: " * 15_000])
def test_long_repetitive_texts_take_linear_time(text):
    began = time.time()
    engine.find(text)
    assert time.time() - began < 20


def test_empty_and_null_texts(spark):
    rows = engine.detect(spark.createDataFrame([(1, None), (2, ""), (3, "почта a@example.net")], "id int, text string")).collect()
    assert [(len(r["spans"]), r["detect_error"]) for r in rows] == [(0, None), (0, None), (1, None)]


def test_tenant_rules_refuse_what_is_not_safe():
    assert engine.tenant_candidates("K-17", [("CASE_ID", "k-[0-9]+")]) == [Span(0, 4, "CASE_ID", 1.0, "custom-rule")]
    for kind, pattern in (("CASE_ID", "[0-9]*"), ("case", "x"), ("CASE_ID", "("), ("CASE_ID", ""), ("CASE_ID", "x" * 513)):
        with pytest.raises(engine.RuleError):
            engine.tenant_candidates("K-17", [(kind, pattern)])
    with pytest.raises(engine.RuleError):
        engine.tenant_candidates("K", [("CASE_ID", "k")] * 33)
    with pytest.raises(engine.RuleError):
        engine.tenant_candidates("a" * 5000, [("CASE_ID", "a+")])


def test_failing_text_has_an_error_and_no_spans(spark, monkeypatch):
    found = engine._outcomes(["x"], [[{"type": "bad", "pattern": "x"}]], engine.GROUPS).to_pylist()
    assert found == [{"spans": None, "error": "invalid_rule"}]


def test_merge_refuses_bad_output_and_keeps_what_rules_cover():
    with pytest.raises(merge.BadCandidate):
        merge.merge("abc", [], [Span(0, 9, "PERSON", 0.5, "m")])
    with pytest.raises(merge.BadCandidate):
        merge.merge_persons("Уфа", [], [Span(0, 3, "LOCATION", 0.5, "m")])
    rnd, text = random.Random(1), "Вера Шолохова живёт: ул. Лесная 5, г. Омск, тел. +7 999 555-01-02"
    base = engine.find(text)
    for _ in range(200):
        a = rnd.randrange(len(text) - 1)
        model = [Span(a, min(len(text), a + rnd.randrange(1, 20)), rnd.choice(["LOCATION", "PHONE"]), 0.5, "m")]
        out = merge.merge(text, base, model)
        assert all(x.end <= y.start for x, y in zip(out, out[1:]))
        covered = {i for s in out for i in range(s.start, s.end) if text[i].isalnum()}
        assert {i for s in base for i in range(s.start, s.end) if text[i].isalnum()} <= covered


def test_in_sql(spark):
    engine.register(spark)
    spark.createDataFrame([(1, "почта a@example.net и 10.0.0.1"), (2, None)], "id int, t string").createOrReplaceTempView("letters")
    rows = spark.sql("SELECT id, s.type, substring(t, s.start + 1, s.end - s.start) AS v FROM letters, LATERAL pii_spans(t) s ORDER BY v").collect()
    assert [tuple(r) for r in rows] == [(1, "IP_ADDRESS", "10.0.0.1"), (1, "EMAIL", "a@example.net")]
    assert [r["m"] for r in spark.sql("SELECT pii_mask(t) AS m FROM letters ORDER BY id").collect()] == ["почта *@*******.*** и **.*.*.*", None]


def test_policies_and_settings(spark, tmp_path):
    import json

    from textloom.sources import tables
    from textloom.types import TYPES

    def read(**policy):
        (tmp_path / "p.json").write_text(json.dumps({"systems": {"a": {"api_key_hash": "x", **policy}}}))
        return tables.policies(spark, str(tmp_path / "p.json"), TYPES).first()

    assert (read()["min_types"], read(types=["EMAIL"])["types"], read(enabled=False)["enabled"]) == (1, ["EMAIL"], False)
    for bad in ({"types": ["NOTHING"]}, {"mode": "shred"}, {"min_types": 0}, {"enabled": 1}, {"rps": True}, {"other": 1}, {"allowed_modes": ["token"]}, {"api_key_hash": ""}):
        with pytest.raises(ValueError):
            read(**bad)
    with pytest.raises(ValueError):
        tables.Settings(ttl_seconds=0)


def test_stratified_draws_keep_the_sizes_of_strata(spark):
    from textloom.operators.bootstrap import draws_of_f1

    rows = [(i, "a", int(i < 50), 0, int(i >= 50), "x" if i < 50 else "y") for i in range(100)]
    cases_ = spark.createDataFrame(rows, "case_id int, system string, tp int, fp int, fn int, part string")
    assert {round(r["f1"], 6) for r in draws_of_f1(cases_, 50, stratum="part").collect()} == {round(2 * 50 / (2 * 50 + 50), 6)}
    assert len({r["f1"] for r in draws_of_f1(cases_, 50).collect()}) > 5
