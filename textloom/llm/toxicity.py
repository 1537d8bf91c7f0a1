"""Toxicity by multiple-instance learning.

Only documents carry labels. A document is a bag of sentences; a sentence's
score is a logistic function of hashed word and word-prefix features, and a
document's score is the noisy-or of its sentences: 1 - prod(1 - p). The
weights are trained through the noisy-or from document labels, so the same
weights then locate the offending sentences.

Training reads a bounded sample of labelled rows: at most `per_class` rows of
each class of at most `max_bytes` bytes of text, the first by a hash of the
id; class weights restore the labels' proportions. Every document is scored
on its whole text. Labels, lang, source and doc_id are no features.

Null and empty texts have one empty sentence. Labels that are null are
skipped; a doc_id labelled twice counts as both. Without positive or without
negative labels the weights are zero and every score is the bias alone
(0, or 1 when all labels are 1). Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm import bpe_kernel
from textloom.llm.common import blocks, id_and_text, map_text_blocks, small_batches, trim

BITS = 18
#: Rows of each class that training reads at most, and bytes of text of each row.
PER_CLASS, MAX_BYTES = 3000, 1 << 16
#: Features kept, and documents of the sample that must hold a kept feature.
MAX_FEATURES, MIN_DOCS = 4096, 4
STEPS, RATE, DECAY = 300, 0.15, 2e-4
#: Lengths (in characters) of the word prefixes that are features beside whole words of up to WORD characters.
PREFIXES, WORD = (4, 5, 6), 16
_ENDS = np.array([ord(c) for c in ".!?\n"], np.uint32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


class Bags:
    """Sentences and features of a block of texts."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(t.lower() for t in texts) + "\n"
        self.cps = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        n = len(self.cps)
        cls = bpe_kernel.char_classes()[self.cps] & 7
        lens = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts)) + 1
        self.doc_start = np.concatenate([[0], np.cumsum(lens)])
        end = np.isin(self.cps, _ENDS)
        # a sentence begins at a document's start and after each end mark
        begins = np.zeros(n + 1, bool)
        begins[self.doc_start] = True
        begins[1:][end] = True
        self.sentence_start = np.flatnonzero(begins[:n])
        self.sentence_doc = np.searchsorted(self.doc_start, self.sentence_start, "right") - 1
        word = (cls == bpe_kernel.LETTER) | (cls == bpe_kernel.NUMBER)
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sentence = np.searchsorted(self.sentence_start, start, "right") - 1
        length = stop - start
        h = np.full(len(start), np.uint64(0x9E3779B97F4A7C15))
        hashes, owners = [], []
        with np.errstate(over="ignore"):
            for j in range(WORD):
                live = np.flatnonzero(length > j)
                if not len(live):
                    break
                x = (h[live] ^ self.cps[start[live] + j].astype(np.uint64)) * np.uint64(0x100000001B3)
                h[live] = x ^ (x >> np.uint64(29))
                if j + 1 in PREFIXES:
                    longer = live[length[live] > j + 1]
                    hashes.append(h[longer] * np.uint64(0xC2B2AE3D27D4EB4F))
                    owners.append(sentence[longer])
            hashes.append(h * np.uint64(0x165667B19E3779F9))
            owners.append(sentence)
        self.feature = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
        self.owner = np.concatenate(owners)

    def pairs(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, feature) pairs of the features for which `kept` is true."""
        hit = kept[self.feature]
        key = np.unique((self.owner[hit] << BITS) | self.feature[hit])
        return key >> BITS, key & ((1 << BITS) - 1)

    def logits(self, model: Model) -> np.ndarray:
        s, f = self.pairs(model.weights != 0)
        return model.bias + np.bincount(s, weights=model.weights[f], minlength=len(self.sentence_start))


def noisy_or(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) of each owner's sentences."""
    return -np.expm1(-np.bincount(owner, weights=np.logaddexp(0, logits), minlength=n))


def _parts(texts: list[str], limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about `limit` characters, so that features are only ever held for one range."""
    cuts, total = [0], 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            cuts.append(i + 1)
            total = 0
    return [(x, y) for x, y in zip(cuts, [*cuts[1:], len(texts)]) if x < y]


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Weights from document labels, through the noisy-or."""
    zero = Model(np.zeros(1 << BITS, np.float32), 40.0 if len(toxic) and toxic.all() else -40.0)
    if not len(toxic) or toxic.all() or not toxic.any():
        return zero
    n = len(texts)
    parts = _parts(texts)
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for x, y in parts:
        bags = Bags(texts[x:y])
        seen = np.unique((bags.sentence_doc[bags.owner] << BITS) | bags.feature)
        label, feature = toxic[x + (seen >> BITS)], seen & ((1 << BITS) - 1)
        pos += np.bincount(feature[label == 1], minlength=1 << BITS)
        neg += np.bincount(feature[label == 0], minlength=1 << BITS)
    p, q = (pos + 0.5) / (toxic.sum() + 1), (neg + 0.5) / ((1 - toxic).sum() + 1)
    gain = np.where(pos + neg >= MIN_DOCS, np.abs(np.log(p / q)) * np.sqrt(pos + neg), 0)
    kept = np.zeros(1 << BITS, bool)
    best = np.argsort(-gain, kind="stable")[:MAX_FEATURES]
    kept[best[gain[best] > 0]] = True
    found, owners, m = [], [], 0
    for x, y in parts:
        bags = Bags(texts[x:y])
        sentence, feature = bags.pairs(kept)
        found.append((sentence + m, feature))
        owners.append(bags.sentence_doc + x)
        m += len(bags.sentence_start)
    s, f = (np.concatenate(c) for c in zip(*found))
    sentence_doc = np.concatenate(owners)
    f = (np.cumsum(kept) - 1)[f]
    k = int(kept.sum())
    w, b = np.zeros(k), -7.0
    mean, var = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(s, weights=w[f], minlength=m)
        a = np.bincount(sentence_doc, weights=np.logaddexp(0, z), minlength=n)
        slope = weight * np.where(toxic == 1, -1 / np.maximum(np.expm1(np.minimum(a, 500)), 1e-9), 1.0) / weight.sum()
        dz = np.clip(slope, -1, 1)[sentence_doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(f, weights=dz[s], minlength=k) + DECAY * w / 10, dz.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:k], min(b - move[k], -4.0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, fold: int = 5) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) modulo `fold` is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0)
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    picks = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picks = part if picks is None else picks.union(part)
    texts = id_and_text(docs).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(picks), "doc_id").select("text", "toxic", "doc_id").collect()  # at most 2 * per_class rows of max_bytes
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    weight = np.array([share[y] / max(1, (toxic == y).sum()) for y in toxic.tolist()])
    return fit([r["text"] for r in rows], toxic, weight)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        bags = Bags(block.column("text").to_pylist())
        p = noisy_or(bags.logits(shared.value), bags.sentence_doc, block.num_rows)
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.clip(p, 0.0, 1.0))], ["doc_id", "score"])

    return map_text_blocks(id_and_text(docs, id_col, text_col), kernel, "doc_id long, score double")


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, beside whatever else a row has."""
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        for _, block in blocks(batch, "text"):
            bags = Bags([t or "" for t in block.column("text").to_pylist()])
            out.append(np.clip(noisy_or(bags.logits(Model(weights, bias)), bags.sentence_doc, block.num_rows), 0.0, 1.0))
        trim()
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run(text)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.where(score_column(model, F.col("text")) < threshold)


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points), score, sentence of every sentence whose own score reaches threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column("text").to_pylist()
        same = [len(t) == len(t.lower()) for t in texts]
        bags = Bags([t if ok else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t, ok in zip(texts, same)])
        p = 1 / (1 + np.exp(-bags.logits(shared.value)))
        stop = np.append(bags.sentence_start[1:], len(bags.cps))
        out = []
        for i in np.flatnonzero(p >= threshold).tolist():
            d = int(bags.sentence_doc[i])
            a = int(bags.sentence_start[i] - bags.doc_start[d])
            z = min(int(stop[i] - bags.doc_start[d]), len(texts[d]))
            out.append((block.column("doc_id")[d].as_py(), a, z, float(p[i]), texts[d][a:z]))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "start", "end", "score", "sentence"])

    return map_text_blocks(id_and_text(docs), kernel, "doc_id long, start long, end long, score double, sentence string")


def predict(docs: DataFrame, labels: DataFrame, fold: int = 5, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = score(docs, train(docs, labels, fold=fold, **bounds))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
