"""The registered queries on whole tables against their SQL or a brute-force version."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from textloom.llm import mixture, queries

SF = "/root/testdata/sf0.001"
DOCS = duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else v
    assert sorted(str([plain(r[c]) for c in names]) for r in df.collect()) == sorted(str([plain(v) for v in r]) for r in found.fetchall())


def test_token_queries(spark):
    import hashlib

    import public_tokenizers as tok
    import tiktoken
    from tokenizers import Tokenizer

    from textloom.llm import bpe_kernel

    lib = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    ranks = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe_kernel.rank_map(tok.path("byte_bpe_50k.tiktoken")), special_tokens={})
    one, six, nine = ({r["doc_id"]: r for r in queries.QUERIES[n](spark, SF).collect()} for n in ("op1_token_counts", "op6_token_store", "op9_bpe"))
    at = 0
    for doc, text, _, _ in DOCS:
        ids, own = lib.encode(text, add_special_tokens=False).ids, ranks.encode_ordinary(text)
        assert (one[doc]["n_bytes"], one[doc]["n_tokens"], one[doc]["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 1024)
        stored = np.array([*ids, 2], "<u4")
        assert (six[doc]["start"], six[doc]["n_tokens"], six[doc]["ids_crc32"]) == (at, len(stored), zlib.crc32(stored.tobytes()))
        at += len(stored)
        assert (nine[doc]["n_tokens"], nine[doc]["ids_sha256"], nine[doc]["decoded_sha256"]) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_ann_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    got: dict = {}
    for r in queries.QUERIES["op4_ann_search"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = ids[ids % 20 == 0]
    assert sorted(got) == sorted(asked.tolist())
    hits = 0
    for q in asked.tolist():
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - score[ids == f[1]][0]) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & {int(ids[i]) for i in order})
    assert hits >= 0.9 * 20 * len(asked)


def test_mixture_query_against_plain_raking(spark):
    """Cells, margins, rate and probabilities by loops over dictionaries."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_mixture"](spark, SF).collect()}

    def topic(t):
        b = len(t.encode())
        marks = sum(t.count(m) for m in "#*$%&")
        return "empty" if not b else "table" if t.count("|") * 50 > b else "symbols" if marks * 20 > b else "short prose" if b < 1000 else "prose" if b < 8000 else "long prose"

    cell = {d: (s if s is not None else mixture.NULL, lang if lang is not None else mixture.NULL, topic(t)) for d, t, lang, s in DOCS}
    size = {d: math.ceil(len(t.encode()) / mixture.BYTES_PER_TOKEN) for d, t, _, _ in DOCS}
    own: dict = {}
    for d in cell:
        own[cell[d]] = own.get(cell[d], 0) + size[d]
    total = sum(own.values())
    margin = lambda w, i: {k: sum(v for c, v in w.items() if c[i] == k) for k in {c[i] for c in w}}
    want = []
    for i, name in enumerate(mixture.MARGINS):
        powered = {k: v ** mixture.POWERS[name] for k, v in margin(own, i).items() if v}
        want.append({k: v / sum(powered.values()) * total for k, v in powered.items()})
    w = {c: float(v) for c, v in own.items()}
    for _ in range(400):
        for i in range(3):
            have = margin(w, i)
            w = {c: v * want[i][c[i]] / have[c[i]] if have[c[i]] else v for c, v in w.items()}
    factor = {c: w[c] / own[c] if own[c] else 1.0 for c in own}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(own[c] * min(1, mid * factor[c]) for c in own) < mixture.SHARE * total else (low, mid)
    for d, r in got.items():
        assert r["topic"] == cell[d][2] and r["n_tokens"] == size[d]
        assert r["factor"] == pytest.approx(factor[cell[d]], rel=1e-5) and r["probability"] == pytest.approx(min(1, high * factor[cell[d]]), rel=1e-5)
    assert len(got) == len(DOCS)


def test_toxicity_query(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_toxicity"](spark, SF).collect()}
    assert sorted(got) == [d for d, *_ in DOCS]
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    seen = [(labels[d], r["predicted"]) for d, r in got.items() if d in labels and not r["held_out"]]
    assert sum(a == b for a, b in seen) >= 0.9 * len(seen)


def test_page_query(spark):
    """Every block of an article's paragraphs is there, in order, and nothing of what never belongs to a text."""
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    rows = queries.QUERIES["op3_html_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and not re.search(r"<[a-z]+[ >]", r["text"])
        bare = re.sub(r"(?s)<(script|style|nav|header|footer|aside|form)\b.*?</\1>", " ", pages[r["page_id"]])
        article = re.search(r"(?s)<(article|main)\b[^>]*>(.*?)</\1>", bare)
        for p in re.findall(r"(?s)<p>([^<&]{80,})</p>", article[2]) if article else ():
            assert " ".join(p.split()) in r["text"]
