"""The stages one after the other on rows with nulls, repeats, ties, long and empty texts, odd columns; no rows at all."""

import random

import corpus_pipeline as P
import pytest

from textloom.llm import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, t long, key long"  # the last three clash


def _rows():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, long = prose(60), prose(4000)
    near = long.split()
    near[100] = "other"
    texts = [None, "", "   ", "one", prose(200), long, long, " ".join(near), prose(90) + " " + passage, passage + " " + prose(120), "x " * 400, prose(100), "Ёж é 😊 " + prose(80)]
    rows = [(i, t, ["en", None][i % 2], ["a", "b", None][i % 3], len(t or ""), "r", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[4], (4, prose(70), "en", "a", 5, "r", 1, 2), (None, prose(30), None, None, None, None, None, None)], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, _ = _rows()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2), int(i == 10)) for i in range(13)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_keep_what_they_should(spark, folder):
    docs, (rows, passage) = spark.read.parquet(f"{folder}/documents.parquet"), _rows()
    deduped = P.drop_near_duplicates(spark, docs, folder)
    assert deduped.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in deduped.collect()), key=str)
    want = {(r[0], r[1]) for r in rows if r[0] not in (6, 7)}
    assert set(kept) == want and len(kept) == len(want)
    cut = {(r["doc_id"], r["n_chars"]): r["text"] for r in P.cut_repeats(spark, deduped, folder).collect()}
    texts = {k[0]: t for k, t in cut.items()}
    assert passage not in texts[8] and passage not in texts[9] and texts[5] == rows[5][1] and texts[0] is None
    assert all(n == len(t) for (_, n), t in cut.items() if t is not None)
    mixed = P.mix_sources(spark, deduped, folder)
    assert mixed.columns == docs.columns and set((r["doc_id"], r["text"]) for r in mixed.collect()) <= want


def test_run_and_empty_tables(spark, folder, tmp_path):
    out = P.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and 0 < out.count() <= 14
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_words_and_their_places():
    import numpy as np

    text = "\ta  bc\n\x0bd".encode()
    first, last = suffix_dedup.word_places(np.frombuffer(text, np.uint8))
    assert [text[a:b] for a, b in zip(first, last)] == [b"a", b"bc", b"d"]
    parts = suffix_dedup.symbols([b"a bc", b"", b" bc "], "words")
    assert [len(p) for p in parts] == [2, 0, 1] and parts[0][1] == parts[2][0]
