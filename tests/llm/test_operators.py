"""Each operator against the library, a brute-force version or an exact round trip, with nulls, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, bpe_kernel, html_text, mixture, near_dedup, quality, suffix_dedup, token_counts, token_store, toxicity
from textloom.llm.components import components

JSON, RANKS = tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"  # the last name clashes
WORDS = [f"w{i:03d}" for i in range(400)]


def _texts():
    rnd = random.Random(3)
    long = " ".join(rnd.choice(WORDS) for _ in range(300))
    near = long.split()
    near[7] = "changed"
    share = " ".join(rnd.choice(WORDS) for _ in range(120))
    odd = "don't 'sword we'll  \n\n x\t  é😊 <|endoftext|> 2²Ⅷ ࡰ " + "=" * 600
    fresh = [" ".join(rnd.choice(WORDS) for _ in range(n)) for n in (80, 150, 90)]
    return [None, "", " ", "one two", "ONE two", long, long, " ".join(near), fresh[0] + " " + share, fresh[1] + " " + share, odd, fresh[2], "line\nline\n" * 30, "a" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), "x") for i, t in enumerate(_texts())]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, 5, "x")], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def _library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_token_counts(docs, empty):
    lib, got = _library(), _by_id(token_counts.count_tokens(docs, JSON))
    for i, t in enumerate(_texts()):
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(lib(t)), len((t or "").encode()))
    assert token_counts.count_tokens(docs, JSON).count() == 16 and token_counts.count_tokens(empty, JSON).count() == 0


def test_token_store(spark, docs, empty):
    lib, at = _library(), 0
    rows = sorted(token_store.token_store(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), JSON).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(rows, _texts()):
        ids = np.array(lib(t) + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.token_store(docs, JSON).count() == 16 and token_store.token_store(empty, JSON).count() == 0


def test_bpe_round_trip(docs, empty):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe_kernel.rank_map(RANKS), special_tokens={})
    got, ids = _by_id(bpe.round_trip(docs, RANKS, tok.PATTERN)), _by_id(bpe.encode(docs, RANKS, tok.PATTERN))
    back = _by_id(bpe.decode(bpe.encode(docs, RANKS, tok.PATTERN), RANKS))
    for i, t in enumerate(_texts()):
        want = lib.encode_ordinary(t or "")
        assert ids[i]["ids"] == want and bytes(back[i]["bytes"]) == (t or "").encode()
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty, RANKS, tok.PATTERN).count() == 0


def test_fold_by_higher_order_functions(spark):
    import regex
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe_kernel.rank_map(RANKS), special_tokens={})
    rnd = random.Random(4)
    random_words = ["".join(rnd.choice("aeinorst é") for _ in range(rnd.randint(1, 24))) for _ in range(150)]
    words = sorted({w for t in [*_texts()[:11], *random_words] for w in regex.findall(tok.PATTERN, (t or "")[:20000])})
    table = spark.createDataFrame([(bytearray(w.encode()),) for w in [*words, ""]] + [(None,)], "word binary")
    folded = bpe.fold_words_sql(table, RANKS)
    got = {bytes(r["word"] or b"").decode(): r["ids"] for r in folded.collect()}
    assert got.pop("") == []
    assert got == {w: lib.encode_ordinary(w) for w in words}
    back = bpe.decode_sql(folded, RANKS, id_col="word")
    assert all(bytes(r["bytes"]) == bytes(r["doc_id"] or b"") for r in back.collect())
    assert bpe.fold_words_sql(table.limit(0), RANKS).count() == 0


def test_kernel_on_random_texts():
    import tiktoken

    rnd, lib = random.Random(1), _library()
    rank = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe_kernel.rank_map(RANKS), special_tokens={})
    marks = list("  \n\t'stremdlvabcXYZ019.,!-_é ßЖ中　\x85\xa0\x1c😊́²Ⅷ") + ["'re", "'ll", "'ve", "<|endoftext|>", "==="]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    for encoder, want in ((bpe_kernel.json_encoder(JSON), lib), (bpe_kernel.rank_encoder(RANKS, tok.PATTERN), rank.encode_ordinary)):
        flat, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [want(t) for t in texts]


def test_suffix_dedup_against_brute_force(docs, empty):
    texts = [(t or "").encode() for t in [*_texts(), _texts()[5], "no id"]]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    got = _by_id(suffix_dedup.digests(docs))
    for i, t in enumerate(texts[:14]):
        gone = bytearray(len(t))
        for j in range(len(t) - 399):
            if seen[t[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.digests(empty).count() == 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


def _without_word_windows(texts, width):
    """The texts without the words that a sequence of `width` words covers which starts anywhere else too."""
    words = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", t)] for t in texts]
    seen: dict[tuple, int] = {}
    for t, w in zip(texts, words):
        for i in range(len(w) - width + 1):
            k = tuple(t[a:b] for a, b in w[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    for t, w in zip(texts, words):
        gone = bytearray(len(t))
        for i in range(len(w) - width + 1):
            if seen[tuple(t[a:b] for a, b in w[i : i + width])] > 1:
                gone[w[i][0] : w[i + width - 1][1]] = b"\1" * (w[i + width - 1][1] - w[i][0])
        yield bytes(c for c, g in zip(t, gone) if not g)


@pytest.mark.parametrize("members", [1 << 21, 0])
def test_passages_of_words_against_brute_force(spark, docs, monkeypatch, members):
    from textloom.llm import hashing

    monkeypatch.setattr(hashing, "FILTER_MEMBERS", members)  # 0: joins take the place of filters
    rnd = random.Random(6)
    passage = lambda n: "  ".join(rnd.choice(WORDS) for _ in range(n))
    shared = [passage(n) for n in (50, 51, 52, 70, 120)]
    texts = [passage(30) + "\t" + s + "\n" + passage(40) for s in shared for _ in range(3)] + [s.replace("  ", "\n ") for s in shared] + [t or "" for t in _texts()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(rows, length=51, gram=25, unit="words").collect()}
    want = [t.decode() for t in _without_word_windows([t.encode() for t in texts], 51)]
    assert [got[i] for i in range(len(texts))] == want
    assert got[0] == texts[0] and got[3] != texts[3]


def test_pieces_of_long_texts(monkeypatch):
    rnd = random.Random(2)
    text = bytes(rnd.randrange(97, 123) for _ in range(5000))
    whole = suffix_dedup.Windows([text])
    assert int(whole.n.sum()) == 5000 - 399
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    cut = suffix_dedup.Windows([text])
    assert sorted(x for a, n in zip(cut.lo, cut.n) for x in range(a, a + n)) == list(range(5000 - 399))


def test_near_duplicates(docs, empty):
    got = _by_id(near_dedup.near_duplicates(docs))
    assert [got[i]["component_id"] for i in range(14)] == [0, 1, 2, 3, 3, 5, 5, 5, 8, 9, 10, 11, 12, 13]
    assert got[5]["n_shingles"] == len({tuple(_texts()[5].split()[i : i + 4]) for i in range(297)}) and got[0]["n_shingles"] == 0
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in near_dedup.keep_one_each(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 1, 2, 3, 5, 8, 9, 10, 11, 12, 13] and None in kept


def test_components_of_chains_and_random_graphs(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent: dict[int, int] = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == top(x) for e in edges for x in e)


def test_quality_measures(docs, empty):
    got, word = _by_id(quality.judge(docs)), re.compile("[^\x20\x09-\x0d]+")
    for i, t in enumerate(_texts()):
        w = word.findall(t or "")
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {p for k, x in enumerate(win) if win.count(x) > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert quality.judge(empty).count() == 0


def test_toxicity(spark):
    rnd = random.Random(5)
    clean = lambda: " ".join(rnd.choice(WORDS) for _ in range(12)) + ". "
    rows = [(i, clean() + (clean()[:-2] + " vile" + rnd.choice(["ness", "ly", "r"]) + ". " if i % 4 == 0 else clean()) + clean()) for i in range(600)]
    texts = spark.createDataFrame([*rows, (600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(601, None, None)], "doc_id long, quality int, toxic int")
    got = _by_id(toxicity.predict(texts, labels))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[600]["predicted"] == 0
    where = toxicity.locate(texts, toxicity.train(texts, labels)).collect()
    assert where and sum("vile" in r["sentence"] for r in where) / len(where) > 0.95
    assert toxicity.predict(texts.limit(0), labels).count() == 0 and toxicity.predict(texts, labels.limit(0)).where("predicted = 1").count() == 0


def test_html_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy</div>
    <article><h1>Head &amp; more</h1><p>Short.<p>A  long paragraph with the words of and to in a language that is here for you to read.<br>Second&nbsp;line</p>
    <div class="comments"><p>I disagree with the author of this article in every way that there is.</p></div></article><footer>&copy; x</footer><script>var a="</p>";</script></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p><b")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(rows).collect()}
    assert got[1] == "Head & more\n\nShort.\n\nA long paragraph with the words of and to in a language that is here for you to read. Second line"
    assert got[2] == got[3] == "" and html_text.main_text(rows.limit(0)).count() == 0


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2020, [None] * 16), (2040, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found: dict[int, list] = {}
    for r in ann.nearest(vectors).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = 0
    for q, near in found.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hit += len({v for v, _ in near} & set(np.argsort(-s)[:20].tolist()))
        assert all(abs(s[v] - score) < 1e-9 for v, score in near) and len(near) == 20
    assert sorted(found) == list(range(0, 1500, 20)) and hit / (20 * len(found)) > 0.9
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_mixture(spark, docs, empty):
    rows = [(i, "x" * 400, "en" if i % 4 else "de", "big" if i % 3 else "small") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixture.mixture(table, share=0.5)
    total = got.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).first()
    assert abs(total[1] / total[0] - 0.5) < 1e-6
    weights = {r["source"]: r["w"] for r in got.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("factor")).alias("w")).collect()}
    assert abs(weights["small"] / sum(weights.values()) - 1 / (1 + 2**0.5)) < 1e-3
    assert got.where("sampled").count() == mixture.mixture(table, share=0.5).where("sampled").count()
    assert mixture.mixture(docs).count() == 16 and mixture.mixture(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixture", "bpe"]
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= 200 and "doc_id" in out.columns
