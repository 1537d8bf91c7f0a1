"""The files of the token store: row indexes, Bloom filters, order, pruning."""

import glob

import public_tokenizers as tok

from textloom.llm import token_store


def test_files_have_indexes_and_bloom_filters_and_prune(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(5000)], "doc_id long, text string")
    path = token_store.write_tokens(rows, tok.path("byte_bpe_50k.json"), f"file://{tmp_path}/tokens", partitions=3)
    files, orc, last = sorted(glob.glob(f"{tmp_path}/tokens/part-*.orc")), spark._jvm.org.apache.orc, -1
    assert len(files) == 3
    for f in files:
        conf = spark._jsc.hadoopConfiguration()
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(f), orc.OrcFile.readerOptions(conf))
        stripe = reader.getStripes().get(0)
        footer = reader.rows().readStripeFooter(stripe)
        kinds = {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
        assert stripe.getIndexLength() > 0 and {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
        ids = [r["doc_id"] for r in spark.read.orc(f).select("doc_id").collect()]
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    found = token_store.read_tokens(spark, path).where("doc_id = 4321")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4321)]" in found._jdf.queryExecution().toString()
    assert [len(r["ids"]) > 1 and r["ids"][-1] == token_store.END_ID for r in found.collect()] == [True]


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "x"), (2, "a", "x"), (2, "a", "x"), (None, None, "x"), (1, "", None)], "doc_id long, text string, ids string")
    out = token_store.describe_tokens(spark, token_store.write_tokens(rows, tok.path("byte_bpe_50k.json"), f"file://{tmp_path}/tokens", partitions=2))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in out.collect())
    assert [g[0] for g in got] == [0, *[sum(x[2] for x in got[:i]) for i in range(1, 5)]] and [g[1] for g in got] == [None, 1, 2, 2, 2]
