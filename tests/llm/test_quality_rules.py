"""The divergence rules judge by all common words and from 250 word characters."""

import re

from textloom.llm import quality


def test_common_words_and_least_length(spark):
    prose = "this is a text with words that are as plain as can be by the door and on the way to it "
    odd = " ".join(["QZ7#4190*KX"] * 3 + [f"X{i:02d}#41*90KQ" for i in range(22)])
    assert 250 <= len(odd.replace(" ", "")) < 300
    rows = [(i, prose * 12 + f"number {i}", "en") for i in range(20)] + [(99, odd, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[0]["js_class"] < quality.MAX_CLASS < got[99]["js_class"] and not got[99]["kept"] and not got[99]["base_failed"]
    assert all(len(words) == 18 for words in quality.COMMON.values())
    common = quality.measure(docs.where("doc_id = 0")).first()["common"]
    assert [common[quality.COMMON["en"].index(w)] for w in ("are", "as", "with", "be", "by", "this")] == [12, 24, 12, 12, 12, 12]


def test_each_text_is_measured_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = ["The\tDOG, the\xa0cat\x0bTHE the\r\nthe the\n" * 20, "die Für\x0cfür FÜR für, im" * 20, "the of die", None, "#1 <b> İn in Ka \n \n" * 30]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ("en", "de", "xx", "fr", "es")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(docs.mapInArrow(counted, docs.schema)).collect()}
    assert read.value == len(rows) and sorted(got) == [0, 1, 2, 3, 4]
    for r in quality.measure(docs).collect():
        text = texts[r["doc_id"]] or ""
        words = [w.lower() for w in re.findall("[^\x20\x09-\x0d]+", text)]
        assert r["common"] == [words.count(w) for w in quality.COMMON.get(rows[r["doc_id"]][2], [""] * 18)]
        solid = "".join(re.findall("[^\x20\x09-\x0d]+", text))
        kinds = ["[a-z]", "[A-Z]", "[0-9]", "[#*$%&|<>]"]
        ascii_kinds = [len(re.findall(k, solid)) for k in kinds]
        letters = sum(c.isalpha() and not re.match("[A-Za-z]", c) for c in solid)
        assert r["classes"] == [*ascii_kinds, letters, len(solid) - sum(ascii_kinds) - letters] and r["n_symbols"] == ascii_kinds[3]
