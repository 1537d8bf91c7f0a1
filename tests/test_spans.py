import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.operators import evaluate as E, protocol as P
from textloom.rules.engine import detect

CASES = [
    ("😊 почта a.b@mail.example.com, тел. +7 (999) 123-45-67; ИНН 500100732259", [("EMAIL", "a.b@mail.example.com"), ("PHONE", "+7 (999) 123-45-67"), ("INN", "500100732259")]),
    ("ПАСПОРТ 4509 123456, код подразделения 770-001, CVV: 123, пин-код 4321", [("PASSPORT", "4509 123456"), ("DEPARTMENT_CODE", "770-001"), ("CVV", "123"), ("PIN", "4321")]),
    ("карта 4111 1111 1111 1111 ip 192.168.0.1", [("CARD", "4111 1111 1111 1111"), ("IP_ADDRESS", "192.168.0.1")]),
    ("номер заказа 5555555555554444", []),
    ("4111 1111 1111 1112 и 0000000000000000", []),
    ("300.1.1.1 и 1.2.3.04", []),
    ("СНИЛС 112-233-445 95", [("SNILS", "112-233-445 95")]),
    ("водительское удостоверение 99 АВ 123456", [("DRIVER_LICENSE", "99 АВ 123456")]),
    ("ИИН 900101300123", [("INN", "900101300123")]),
    ("", []),
    (None, []),
]


def test_detect_finds_exactly_these(spark):
    rows = detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")).collect()
    got = {r["id"]: [(s["type"], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in rows}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("mode", ["mask", "token", "synthetic"])
def test_round_trip(spark, mode):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES) if t], "id int, text string")
    rows = detect(docs).withColumn("r", S.replace_spans(F.col("text"), F.col("spans"), mode, b"k", F.col("id").cast("string")))
    out = rows.select("text", "r", S.restore_exact(F.col("r.masked"), F.col("r.replacements")).alias("back"), S.restore_tokens(F.col("r.masked"), F.col("r.replacements")).alias("reply")).collect()
    assert all(r["back"] == r["text"] for r in out)
    if mode == "token":
        assert all(r["reply"] == (r["text"] if r["r"]["replacements"] else None) for r in out)


def test_restore_refuses_changed_text(spark):
    row = spark.createDataFrame([("xx1", [(0, 2, "ab", "**")])], "masked string, r array<struct<start: int, end: int, original: string, replacement: string>>")
    assert row.select(S.restore_exact(F.col("masked"), F.col("r")).alias("x")).first()["x"] is None


def test_resolve_priority_length_confidence(spark):
    spans = [(0, 5, "CARD", 0.9, "a"), (3, 9, "PASSPORT", 0.9, "b"), (9, 12, "EMAIL", 0.9, "c"), (9, 11, "EMAIL", 1.0, "d"), (20, 25, "INN", 0.9, "ner-structured"), (20, 22, "PERSON", 0.5, "x")]
    rows = spark.createDataFrame([(spans,)], "s array<struct<start: int, end: int, type: string, confidence: double, reason: string>>")
    assert [(s["start"], s["type"]) for s in rows.select(S.resolve(F.col("s")).alias("s")).first()["s"]] == [(3, "PASSPORT"), (9, "EMAIL"), (20, "PERSON")]


def test_hmac_and_seal(spark):
    row = spark.createDataFrame([("сообщение",)], "m string")
    for key in (b"k", b"x" * 80):
        assert row.select(S.hmac_sha256(key, F.col("m")).alias("h")).first()["h"] == hmac.new(key, "сообщение".encode(), hashlib.sha256).hexdigest()
    sealed = row.withColumn("s", P.seal(F.col("m"), F.lit(bytearray(32)), F.lit("id")))
    assert sealed.select(P.unseal(F.col("s"), F.lit(bytearray(32)), F.lit("id")).alias("o"), P.unseal(F.col("s"), F.lit(bytearray(32)), F.lit("no")).alias("n")).first() == ("сообщение", None)


def test_scores_conventions(spark):
    table = spark.createDataFrame([(0, 0, 0), (2, 1, 1), (0, 0, 3)], "tp int, fp int, fn int")
    ext = [(r["precision"], r["recall"]) for r in E.scores(table).collect()]
    dev = [(r["precision"], r["recall"]) for r in E.scores(table, "development").collect()]
    assert ext == [(0.0, 0.0), (0.666667, 0.666667), (0.0, 0.0)] and dev == [(1.0, 1.0), (0.666667, 0.666667), (0.0, 0.0)]


def test_expiry_is_not_extended(spark):
    rows = spark.sql("select * from values ('a', timestamp_ntz'2024-01-01 00:00:00'), ('a', timestamp_ntz'2024-01-01 00:00:50'), ('a', timestamp_ntz'2024-01-01 00:01:05'), ('b', timestamp_ntz'2024-01-01 00:00:00') t(k, at)")
    assert sorted((r["k"], r["n"]) for r in P.with_expiry(rows, "k", "at", 60).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_policy_select(spark):
    spans = "array<struct<start: int, end: int, type: string, confidence: double, reason: string>>"
    rows = spark.createDataFrame([([(0, 1, "EMAIL", 1.0, ""), (2, 3, "CARD", 1.0, "")],)], f"s {spans}")
    pick = lambda types, n, need, on: rows.select(P.select_by_policy(F.col("s"), F.array(*map(F.lit, types)).cast("array<string>"), F.lit(n), F.array(*map(F.lit, need)).cast("array<string>"), F.lit(on)).alias("p")).first()["p"]
    assert len(pick([], 1, [], True)["selected"]) == 2 and len(pick(["EMAIL"], 2, [], True)["selected"]) == 0
    assert pick([], 1, ["PHONE"], True)["selected"] == [] and pick([], 1, [], False)["detected_types"] == ["CARD", "EMAIL"]
