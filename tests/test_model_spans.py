import json
import os

from pyspark.sql import functions as F

from textloom.functions import spans as S
from textloom.operators import bootstrap as B, model_spans as M

TOKENS = "array<struct<start: int, end: int, value: string, label: string, score: double>>"


def test_words_split_punctuation_and_edge_dots(spark):
    row = spark.createDataFrame([("😊 ..a.b. (в), x",), ("",)], "t string").select(M.words(F.col("t")).alias("w")).collect()
    assert [(w["start"], w["value"]) for w in row[0]["w"]] == [(0, "😊"), (2, "."), (3, "."), (4, "a.b"), (7, "."), (9, "("), (10, "в"), (11, ")"), (12, ","), (14, "x")] and row[1]["w"] == []


def test_bridge_and_entities(spark):
    tags = [("Ли", "B-PERSON", 0.9), (",", "O", 0.4), ("Ан", "I-PERSON", 0.7), ("Уфа", "B-CITY", 0.8), (".", "O", 0.3), ("Омск", "B-CITY", 0.6), ("и", "O", 0.5)]
    rows, at = [], 0
    for v, label, score in tags:
        rows.append((at, at + len(v), v, label, score))
        at += len(v) + 1
    got = spark.createDataFrame([(rows,)], f"t {TOKENS}").select(M.entities(M.bridge(F.col("t"))).alias("e")).first()["e"]
    assert [(e["start"], e["end"], e["label"], round(e["score"], 6)) for e in got] == [(0, 7, "PERSON", 0.766667), (8, 11, "CITY", 0.8), (14, 18, "CITY", 0.6)]


def test_merge_adjacent(spark):
    spans = [(0, 2, "PERSON", 0.5), (4, 6, "PERSON", 0.9), (7, 8, "PERSON", 0.1), (9, 10, "LOCATION", 0.2)]
    got = spark.createDataFrame([("ab  cd,e f", spans)], f"t string, s {M.LABELLED}").select(M.merge_adjacent(F.col("s"), F.col("t")).alias("m")).first()["m"]
    assert [tuple(x) for x in got] == [(0, 6, "PERSON", 0.9), (7, 8, "PERSON", 0.1), (9, 10, "LOCATION", 0.2)]


def test_align_bio(spark):
    cases = [
        ("Ли  Ан жив", ["Ли", "Ан", "", "жив"], ["B-P", "I-P", "O", "O"], [("P", 0, 6)], None),
        ("Ли Ан", ["Ли", "Ан"], ["B-P", "B-P"], [("P", 0, 2), ("P", 3, 5)], None),
        ("Ли Ан", ["Ли", "", "Ан"], ["B-P", "O", "I-P"], None, "invalid_bio_transition"),
        ("Ли Ан", ["Ли"], ["B-P"], None, "unaligned_text_suffix"),
        ("Ли Ан", ["Ан"], ["B-P"], None, "token_not_exactly_alignable"),
        ("Ли", ["Ли"], ["B-X"], None, "invalid_bio_transition"),
        ("Ли", ["Ли"], [], None, "token_label_length_mismatch"),
        ("Ли", [None], ["O"], None, "invalid_token_or_label"),
        ("", [], [], [], None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, a array<string>, b array<string>").select("i", M.align_bio(F.col("t"), F.col("a"), F.col("b"), ["P"]).alias("r"))
    got = {r["i"]: (None if r["r"]["spans"] is None else [tuple(s) for s in r["r"]["spans"]], r["r"]["error"]) for r in df.collect()}
    assert got == {i: (c[3], c[4]) for i, c in enumerate(cases)}


def test_bootstrap_is_stable_and_paired(spark):
    rows = [(i, s, int(i % 3 > 0 or s == "b"), int(i % 5 == 0), int(i % 3 == 0 and s == "a")) for i in range(300) for s in "ab"]
    cases = spark.createDataFrame(rows, "case_id int, system string, tp int, fp int, fn int")
    one, two = ({r["system"]: tuple(r)[1:] for r in B.intervals(cases.repartition(n), "a", draws=400).collect()} for n in (1, 5))
    assert one == two and one["a"][2:] == (0.0, 0.0, 0.0) and one["b"][4] == 1.0
    assert 0.02 < one["a"][1] - one["a"][0] < 0.15 and one["a"][0] < 2 * 200 / (2 * 200 + 60 + 100) < one["a"][1]


def _mask(text):
    token = "⟦PD:EMAIL:0123456789abcdef⟧"
    return text.replace("ab", token), [{"start": 0, "end": len(token), "original": "ab", "replacement": token}]


def _stream(spark, tmp_path, batches):
    """Outcomes by seq of requests (key, seq, second, operation, payload) that arrive batch by batch."""
    from textloom.streaming.requests import keyed_requests

    src = tmp_path / "in"
    src.mkdir()
    for part, rows in enumerate(batches):
        lines = [json.dumps({"system": "s", "payload_id": k, "seq": n, "ts": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z", "operation": op, "payload": p, "mode": "token", "masked": _mask(p)[0], "replacements": _mask(p)[1]}) for k, n, at, op, p in rows]
        (src / f"{part}.json").write_text("\n".join(lines))
        os.utime(src / f"{part}.json", (1_700_000_000 + 60 * part,) * 2)  # the file source takes older files first
    schema = f"system string, payload_id string, seq long, ts timestamp, operation string, payload string, mode string, masked string, replacements {S.REPLACEMENTS}"
    stream = keyed_requests(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), ttl_seconds=60)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return {r["seq"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_request_protocol_as_a_stream(spark, tmp_path):
    masked, done = _mask("ab c")
    seen = [
        ("k", 1, 0, "unmask", "ab c", "mapping_expired"), ("k", 2, 1, "mask", "ab c", "created"), ("k", 3, 2, "mask", "ab c", "repeated"), ("k", 4, 3, "mask", "ab d", "payload_conflict"),
        ("k", 5, 4, "process", masked, "restored"), ("k", 6, 5, "unmask", "x " + done[0]["replacement"], "restored"), ("k", 7, 6, "unmask", "⟦PD:EMAIL:ffffffffffffffff⟧", "unknown_token"),
        ("k", 8, 70, "unmask", masked, "mapping_expired"), ("j", 9, 3, "process", "ab c", "created"),
    ]
    got = _stream(spark, tmp_path, [[x[:5] for x in seen[:4]], [x[:5] for x in seen[4:]]])
    assert {n: r["outcome"] for n, r in got.items()} == {n: want for _, n, _, _, _, want in seen}
    assert got[5]["result"] == "ab c" and got[6]["result"] == "x ab" and got[2]["result"] == got[3]["result"] == masked


def test_requests_are_answered_as_they_arrive(spark, tmp_path):
    """The earlier write comes in the later batch: the record that is there answers it."""
    got = _stream(spark, tmp_path, [[("k", 2, 5, "mask", "ab d"), ("k", 3, 6, "mask", "ab d")], [("k", 1, 1, "mask", "ab c"), ("k", 4, 7, "mask", "ab d")]])
    assert {n: r["outcome"] for n, r in got.items()} == {2: "created", 3: "repeated", 1: "payload_conflict", 4: "repeated"}


def test_metric_windows_first_of_key_and_capture(spark, tmp_path):
    from textloom.sources import tables
    from textloom.streaming import windows

    rows = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,cast(id as int)) at, concat('k', id % 2) k, id from range(4)")
    tables.write(rows, str(tmp_path / "json"), "json")
    schema = "at timestamp, k string, id long"
    assert tables.json_lines(spark, str(tmp_path / "json"), schema).count() == 4
    tables.write(rows.select("k", "id"), str(tmp_path / "csv"), "csv")
    assert sorted(r["id"] for r in tables.csv(spark, str(tmp_path / "csv"), "k string, id long").collect()) == [0, 1, 2, 3]
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "json"))
    windows.capture(stream(), str(tmp_path / "cap"), str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.schema(schema).json(str(tmp_path / "cap")).count() == 4
    windows.capture(windows.first_of_key(stream(), "at", ["k"]), str(tmp_path / "first"), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.schema(schema).json(str(tmp_path / "first")).collect()) == ["k0", "k1"]
    assert sorted((r["k"], r["n"]) for r in windows.metric_windows(rows, "at", "k").collect()) == [("k0", 2), ("k1", 2)]
