"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of BOOKS
full-dimensional codebooks. The codebooks start as residual k-means and are
refitted by least squares to their own beam-searched codes. The index holds
every vector's codes, the squared norm of its approximation, and the vector.

Queries go in blocks of bounded size to all partitions of the index: a block's
table of inner products with the codewords scores every row by lookups, each
partition's best rows are scored exactly in double precision and its best `k`
leave; the best `k` of all partitions, ties to the smaller id, are the answer.

Codebooks are fitted on a bounded sample, the first SAMPLE vectors by a hash
of the id; every vector is indexed. Vectors that are null, zero, of another
length than the sample's most frequent one, or hold null or non-finite
components take no part. A query's own id is no candidate, repeated rows are
candidates of their own; of several rows with a query's id the least vector
asks. Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import materialize, scratch, without_leftovers

BOOKS, WORDS, BEAM = 12, 256, 8
SAMPLE, ROUNDS, REFITS = 8192, 8, 1
#: Rows of a partition that are scored exactly for each query: this many, or this share if that is more.
RERANK, RERANK_SHARE = 320, 0.05
#: Queries of a block (on average) and of a lookup pass; rows of the index of a lookup pass.
QUERY_BLOCK, PASS, ROWS = 4096, 128, 1 << 15


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # BOOKS x words x dimension, float32

    @property
    def gram(self) -> np.ndarray:
        flat = self.words.reshape(-1, self.words.shape[2])
        return flat @ flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of each row of x by beam search over the residuals."""
        books, words, _ = self.words.shape
        gram = self.gram
        own = np.diag(gram).reshape(books, words)
        out = np.empty((len(x), books), np.uint8)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            dots = (part @ self.words.reshape(books * words, -1).T).reshape(len(part), books, words)
            codes = np.zeros((len(part), 1, 0), np.int64)
            error = np.zeros((len(part), 1), np.float32)
            for m in range(books):
                cost = np.repeat((own[m] - 2 * dots[:, m])[:, None, :], codes.shape[1], axis=1)
                for j in range(m):
                    cost += 2 * gram[j * words + codes[:, :, j], m * words : (m + 1) * words]
                cost = (cost + error[:, :, None]).reshape(len(part), -1)
                width = min(beam, cost.shape[1])
                best = np.argpartition(cost, width - 1, axis=1)[:, :width]
                error = np.take_along_axis(cost, best, 1)
                codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None], 1), (best % words)[:, :, None]], axis=2)
            out[at : at + 1024] = np.take_along_axis(codes, error.argmin(1)[:, None, None], 1)[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m, codes[:, m]] for m in range(self.words.shape[0]))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> Codebooks:
    """Codebooks for the rows of x."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, stages = x.copy(), []
    for _ in range(books):
        centres = _k_means(rest, words, rng).astype(np.float32)
        rest = rest - centres[((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)]
        stages.append(centres)
    now = Codebooks(np.stack(stages))
    for _ in range(REFITS):
        codes = now.encode(x, 4)
        # least squares for all codewords at once, pulled to the present ones where a word is rare
        place = codes.astype(np.int64) + np.arange(books) * words
        a = np.zeros((books * words, books * words), np.float32)
        for i in range(books):
            for j in range(books):
                np.add.at(a, (place[:, i], place[:, j]), 1)
        b = np.zeros((books * words, x.shape[1]), np.float32)
        for i in range(books):
            np.add.at(b, place[:, i], x)
        flat = now.words.reshape(books * words, -1)
        a[np.diag_indices(len(a))] += 1.0
        now = Codebooks(np.linalg.solve(a, b + flat).reshape(now.words.shape).astype(np.float32))
    return now


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def build_index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, str, Codebooks | None]:
    """(vec_id, vector, codes, norm2 of every usable row, in the shared folder; the folder; the codebooks)."""
    rows = usable(vectors)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    schema = "vec_id long, vector array<float>, codes binary, norm2 double"
    lengths = Counter(len(x) for x in some.column("vector"))
    if not lengths:
        return *materialize(rows.select("vec_id", "vector", F.lit(b"").alias("codes"), F.lit(0.0).alias("norm2")), "index"), None
    width = lengths.most_common(1)[0][0]
    x = np.array([v for v in some.column("vector").to_pylist() if len(v) == width], np.float32)
    books = fit(x)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            v = _dense(batch.column("vector"), width)
            codes = shared.value.encode(v)
            norm2 = (shared.value.decode(codes).astype(np.float64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm2)], ["vec_id", "vector", "codes", "norm2"])

    return *materialize(rows.where(F.size("vector") == width).mapInArrow(run, schema), "index"), books


def _part_search(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm2: np.ndarray, books: Codebooks, q_ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
    """(query, candidate, exact score) of each query's best k of these rows."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, codes, norm2 = ids[order], vectors[order], codes[order], norm2[order]
    n = len(ids)
    take = min(n, max(RERANK, int(RERANK_SHARE * n)))
    exact = vectors.astype(np.float64)
    for at in range(0, len(q_ids), PASS):
        q = queries[at : at + PASS]
        tables = np.einsum("qd,mwd->qmw", q, books.words, optimize=True).astype(np.float32)
        score = np.zeros((len(q), n), np.float32)
        for m in range(codes.shape[1]):
            score += np.take(tables[:, m], codes[:, m], axis=1)
        if metric == "l2":
            score = 2 * score - norm2.astype(np.float32)
        # one number that orders by score, then by smaller id
        bits = np.ascontiguousarray(score).view(np.int32).astype(np.int64)
        key = (np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) << 32) + np.arange(n, 0, -1)
        best = np.argpartition(key, n - take, axis=1)[:, n - take :] if take < n else np.broadcast_to(np.arange(n), (len(q), n))
        q64 = q.astype(np.float64)
        for i in range(len(q)):
            rows = best[i][ids[best[i]] != q_ids[at + i]]
            s = exact[rows] @ q64[i] if metric == "ip" else -((exact[rows] - q64[i]) ** 2).sum(1)
            top = np.lexsort((ids[rows], -s))[:k]
            yield q_ids[at + i], ids[rows][top], s[top]


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 20, metric: str = "ip") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each usable query; metric: "ip" or "l2" (negative squared distance)."""
    spark = index.sparkSession
    schema = "query_id long, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = books.words.shape[2]
    asked = usable(queries).where(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    path = scratch(spark, "neighbours")
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow()  # about QUERY_BLOCK rows
        q_ids, q = block.column("vec_id").to_numpy(), np.array(block.column("vector").to_pylist(), np.float32).reshape(-1, width)
        order = np.argsort(q_ids)
        shared = spark.sparkContext.broadcast((books, q_ids[order], q[order]))

        def run(batches, shared=shared):
            books, q_ids, q = shared.value
            held: list[pa.RecordBatch] = []

            def flush():
                t = pa.Table.from_batches(held).combine_chunks()
                codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, books.words.shape[0])
                vectors = _dense(t.column("vector").chunk(0), width)
                found = list(_part_search(t.column("vec_id").to_numpy(), vectors, codes, t.column("norm2").to_numpy(), books, q_ids, q, k, metric))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                        ["query_id", "vec_id", "score"],
                    )

            n = 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    n += batch.num_rows
                if n >= ROWS:
                    yield from flush()
                    held, n = [], 0
            if held:
                yield from flush()

        # one query's rows are k from each partition
        with without_leftovers(spark):
            index.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.unpersist()
    near = spark.read.schema(schema).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`."""
    index, _, books = build_index(vectors)
    return search(index, books, vectors.where(F.col("vec_id") % every == 0), k)
