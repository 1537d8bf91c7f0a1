"""Queries over values of fixed formats against their SQL, on texts where values overlap or touch odd characters."""

import random
import time

import duckdb
import pytest

from textloom.plans import registry
from textloom.rules import engine, formats

TEXTS = [
    None,
    "",
    "no value",
    "or +1 (269) 555-3296 4524132264652876 and",
    "on +1 (608) 555-2280 37.92.178.161 in",
    "the 4495589438270767 42.73.240.87 the",
    "a levi enaich b",
    "a levi enaich b x@y.z",
    "+12345678.5 and a+12345678b, ++1234567890+1234567890",
    "номер заказа +7 (921) 555-12-34, билет 4111111111111111",
    "ſK@ſK.K İı@ıx.com aı@x.com é@b.c aé@b.cé x!y@z.example Почта.a@example.net",
    "1.2.3.4.5.6.7.8 é1.2.3.4é _1.2.3.4 01.2.3.4 256.1.1.1 ٣1.2.3.4 1 . 2 . 3 . 4 ::1",
    "😊 4111111111111111 4111-1111 1111\t1111 1111111111111111 é5500005555555559é 44955894382707674444444444",
    "a@b.c, a@b.c and xa@b.cd; 1.2.3.4 in 11.2.3.45",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def rows(name, spark, folder):
    """Rows of a query and of its SQL."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = [tuple(r) for r in found.fetchall()]
    return sorted((tuple(r[c] for c in names) for r in registry.queries()[name](spark, folder).collect()), key=repr), sorted(want, key=repr)


def test_detect_spans(spark, odd):
    got, want = rows("detect_spans", spark, odd)
    assert got == want
    assert {(3, "PHONE", "+1 (269) 555-3296 452"), (3, "CARD", "4524132264652876"), (5, "IP_ADDRESS", "42.73.240.87")} <= set(got)


def test_mask_documents(spark, odd):
    got, want = rows("mask_documents", spark, odd)
    assert got == want and {(3, "or +* (***) ***-**** ***4132264652876 and", 2), (6, TEXTS[6], 0)} <= set(got)


def test_protected_documents_masks_all_that_the_detector_finds(spark, odd):
    got = {r["doc_id"]: r for r in registry.flagship(spark, odd).collect()}
    assert got[3]["masked"] == "or +* (***) ***-**** **************** and" and got[6]["masked"] == "a **** ****** b" and len(got) == len(TEXTS)


@pytest.mark.parametrize("name", ["international_phones", "ip_values"])
def test_values_of_one_format(spark, odd, name):
    got, want = rows(name, spark, odd)
    assert got == want and len(got) > 5


def test_detect_all_types_counts_the_types_of_its_sql(spark, odd):
    got, want = rows("detect_all_types", spark, odd)
    assert got == want and {(4, "IP_ADDRESS", 1), (4, "PHONE", 1)} <= set(got) and not any(i == 6 for i, _, _ in got)


def test_policy_select(spark, odd):
    got, want = rows("policy_select", spark, odd)
    assert got == want and {(4, 0, "PHONE"), (9, 0, "CARD,PHONE")} <= set(got)


@pytest.mark.parametrize("mode", ["mask", "synthetic", "token"])
def test_round_trips(spark, odd, mode):
    got, want = rows(f"round_trip_{mode}", spark, odd)
    known = {i: n for i, _, n, _ in got}
    assert got == want and (known[3], known[4], known[5], known[6]) == (2, 2, 2, 0) and sum(changed for *_, changed in got) == 10


def test_each_format_equals_sql_on_random_texts(tmp_path):
    rnd = random.Random(3)
    parts = ["+1", "+49", "4111111111111111", "4524132264652876", "1.2.3.4", "255", "0", "7", ".", ".", "@", "a", "K", "\u212a", "ſ", "é", "ж", "_", "-", " ", "\t", "\n", "(", ")", "x@y.z", "999"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(3000)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = db.execute(registry.oracle_sql()["detect_spans"]).fetchall()
    got = [(i, s.type, t[s.start : s.end]) for i, t in enumerate(texts) for s in formats.find(t)]
    assert len({k for _, k, _ in got}) == 4 and sorted(got) == sorted(want)


def test_the_detector_still_weighs_values_against_each_other():
    assert [(s.type, TEXTS[3][s.start : s.end]) for s in engine.find(TEXTS[3])] == [("PHONE", "+1 (269) 555-3296"), ("CARD", "4524132264652876")]


@pytest.mark.parametrize("text", ["1" * 300_000, "a@" * 100_000, "a" * 300_000 + "@", "+1" + "( " * 150_000, "+1 " * 100_000, "1." * 150_000, "4 " * 150_000, "x@" + "a-" * 150_000])
def test_long_repetitive_texts_take_linear_time(text):
    began = time.time()
    formats.find(text)
    assert time.time() - began < 10
