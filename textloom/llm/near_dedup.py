"""MinHash near-duplicates with compressed registers (HyperMinHash).

A document's set holds the distinct shingles (of 4 words, or `width`) of its lower-cased words
(shorter documents: the whole sequence), as 64-bit hashes. One hash of each
shingle picks a bucket by its leading bits and offers the rest as a value;
a bucket's register keeps the smallest value as a leading-zero count and
MANTISSA bits, 16 bits in all. Four registers are one 64-bit band key.

Equal sets form a class at once; only class representatives go on. Classes
that share a band key are candidates; the Jaccard estimate from the registers,
corrected for register collisions, drops what lies over `SIGMAS` standard
deviations below the threshold; the rest is verified on the full sets.

No pairs of a whole group are made: first each class is compared with the
smallest member of that bucket it shares most bands through. Buckets whose
members are then still in different components are compared by registers, in
blocks; the likely pairs form clusters, whose members are compared on the full
sets, in blocks, and only links that connect something new leave a block. No
bucket is capped: every pair that shares a band is connected or compared. Two
sets with a Jaccard index of 0.8 share none of the 32 bands with a probability
of 5e-8.

Null or wordless texts have an empty set, are linked with nothing and are
their own component. Rows with a null id are kept and have a null component.
Equal rows give equal results; where one id comes with several texts, links
are judged by one of them, and component ids by the id. Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.llm import bpe_kernel
from textloom.llm.common import blocks, discard, id_and_text, map_text_blocks, materialize, trim
from textloom.llm.components import components
from textloom.llm.hashing import in_filter, make_filter, mix, word_hashes

SHINGLE = 4
REGISTERS, ROWS, MANTISSA = 128, 4, 10
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
SIGMAS = 6.5
#: Classes of a bucket that are compared at once.
BLOCK = 256
#: Share of equal registers of disjoint sets, about 0.17 / 2**MANTISSA.
COLLISION = 0.169919 / (1 << MANTISSA)
_M = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


class ShingleSets:
    """Distinct shingles of a block of texts: flat values in ascending order within each document, and their counts."""

    def __init__(self, texts: list[bytes], width: int = SHINGLE):
        n_docs = len(texts)
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8).copy()
        data[(data >= 65) & (data <= 90)] += 32
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, n_docs) + 1)])
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(start, begin)
        words = np.diff(first)
        h = word_hashes(data, start, end)
        n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(n_docs), n)
        at = bpe_kernel.spread(first[:-1], n)
        full = words[doc] >= width
        s = np.empty(len(at), np.uint64)
        with np.errstate(over="ignore"):
            x = np.full(int(full.sum()), _M[4])
            for k in range(width):
                x = mix(x * _M[2] + h[at[full] + k])
            s[full] = x
            for i in np.flatnonzero(~full).tolist():  # fewer words than a shingle
                x = np.array([words[doc[i]]], np.uint64)
                for k in range(int(words[doc[i]])):
                    x = mix(x * _M[2] + h[at[i] + k])
                s[i] = x[0]
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        self.values, self.doc = s[new], doc[new]
        self.counts = np.bincount(self.doc, minlength=n_docs)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that tell sets apart."""
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        out = []
        with np.errstate(over="ignore"):
            for m in (_M[1], _M[4]):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.values * m + _M[2]), dtype=np.uint64)])
                out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
        return out[0], out[1]

    def registers(self) -> np.ndarray:
        """Registers of each document, 0 where a bucket is empty."""
        bits = REGISTERS.bit_length() - 1
        rest = 64 - bits
        # values are in ascending order, so the first of a bucket holds its smallest
        bucket = self.doc * REGISTERS + (self.values >> np.uint64(rest)).astype(np.int64)
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        low = (self.values[new] & np.uint64((1 << rest) - 1)).astype(np.float64)
        part, power = np.frexp(low)
        mantissa = np.where(low > 0, ((part - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), 0)
        zeros = np.where(low > 0, rest - power, rest)
        out = np.zeros(len(self.counts) * REGISTERS, np.uint16)
        out[bucket[new]] = (zeros << MANTISSA) + np.minimum(mantissa, (1 << MANTISSA) - 1) + 1
        return out.reshape(-1, REGISTERS)


def _binary_rows(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    offsets = pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, k1, k2 (which set), registers of every row."""

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        sets = ShingleSets(block.column("text").cast(pa.binary()).to_pylist(), width)
        k1, k2 = sets.keys()
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("t"), pa.array(sets.counts, pa.int64()), pa.array(k1), pa.array(k2), _binary_rows(sets.registers())], ["doc_id", "t", "n_shingles", "k1", "k2", "registers"]
        )

    return map_text_blocks(id_and_text(docs).withColumn("t", F.xxhash64("text")), kernel, "doc_id long, t long, n_shingles long, k1 long, k2 long, registers binary")


def _band_keys(bands: np.ndarray) -> np.ndarray:
    """Bucket of each band (last axis) of the registers, taken as 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(bands * _M[2] + np.arange(1, bands.shape[-1] + 1, dtype=np.uint64) * _M[4]).view(np.int64)


def band_rows(classes: DataFrame) -> DataFrame:
    """bucket, rep: one row for each band of each class that isn't empty."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = np.ascontiguousarray(_matrix(batch.column("registers"))).view(np.uint64)
            key = _band_keys(bands)
            some = bands != 0
            rep = np.broadcast_to(batch.column("rep").to_numpy()[:, None], bands.shape)
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(rep[some])], ["bucket", "rep"])

    return classes.select("rep", "registers").mapInArrow(run, "bucket long, rep long")


def estimate_ok(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the corrected Jaccard estimate of registers a, b (last axis) leaves the threshold possible."""
    some = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    share = same / np.maximum(some, 1)
    estimate = (share - COLLISION) / (1 - COLLISION)
    p = PERCENT / 100
    return (some > 0) & (estimate >= p - SIGMAS * np.sqrt(p * (1 - p) / np.maximum(some, 1)))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the estimate lets through."""
    left = classes.select(F.col("rep").alias("a"), F.col("registers").alias("ra"))
    right = classes.select(F.col("rep").alias("b"), F.col("registers").alias("rb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(estimate_ok(_matrix(batch.column("ra")), _matrix(batch.column("rb")))))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """rep, k1, k2, set (sorted values as bytes) of the documents with these ids, and of a few others."""
    rows, bits = id_and_text(docs), make_filter(ids)
    if bits is None:
        rows = rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            at = batch.column("doc_id").to_numpy(zero_copy_only=False)
            if at.dtype != np.int64:  # nulls
                batch = batch.filter(pc.is_valid(batch.column("doc_id")))
                at = batch.column("doc_id").to_numpy()
            some = batch if shared.value is None else batch.filter(pa.array(in_filter(shared.value, at)))
            for _, block in blocks(some, "text"):
                sets = ShingleSets(block.column("text").cast(pa.binary()).to_pylist(), width)
                k1, k2 = sets.keys()
                offsets = pa.py_buffer((np.concatenate([[0], np.cumsum(sets.counts)]) * 8).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), block.num_rows, [None, offsets, pa.py_buffer(sets.values)])
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(k1), pa.array(k2), column], ["rep", "k1", "k2", "set"])
        trim()

    return rows.mapInArrow(run, "rep long, k1 long, k2 long, set binary")


def _exact_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, width: int) -> tuple[DataFrame, str]:
    """rep, set of the classes whose representatives are in column `id`, written to the shared folder."""
    keyed = _sets(docs, ids, width).join(ids, F.col("rep") == F.col("id"), "left_semi").join(classes.select("rep", "k1", "k2"), ["rep", "k1", "k2"], "left_semi")
    return materialize(keyed.dropDuplicates(["rep"]).select("rep", "set"), "sets")


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(p), len(q)) < PERCENT * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets, path = _exact_sets(docs, ids, classes, width)

    def run(batches):
        for batch in batches:
            out = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    links, _ = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    discard(docs.sparkSession, path)
    return links


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their roots."""
    rooted = members.join(roots, members["rep"] == roots["node"], "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
    return rooted.join(several, "bucket")


def _in_blocks(rows: DataFrame, group: str, block: int, exact: bool) -> DataFrame:
    """a, b: pairs of different roots that connect all likely (exact: verified) pairs within each group.

    rows: group, n (its size), rep, root, registers and, if exact, set. Groups are cut into blocks of about `block`
    rows by a hash, and every two blocks meet once, so no task holds more than two blocks.
    """
    count = F.ceil(F.col("n") / block).cast("int")
    cut = rows.withColumn("own", F.pmod(F.xxhash64("rep"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    cut = cut.select(F.col(group).alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "root", "registers", *(["set"] if exact else []))
    keys = ["g", "i", "j"]

    def compare(part: pa.Table):
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        own, rep, root = (part.column(c).to_numpy() for c in ("own", "rep", "root"))
        if len(rep) < 2:
            return
        reg = _matrix(part.column("registers"))
        sets = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()] if exact else []
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        bands = reg.view(np.uint64)
        band = int(np.flatnonzero(_band_keys(bands[:1])[0] == np.int64(part.column("g")[0].as_py()))[0]) if not exact else 0
        found = []
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            ok = estimate_ok(reg[some][:, None, :], reg[right][None, :, :]) & (root[some][:, None] != root[right][None, :])
            if i == j:
                ok &= rep[some][:, None] < rep[right][None, :]
            if not exact:  # a pair is looked at in the first band that it shares, so it leaves one bucket only
                ok &= ((bands[some][:, None, :] == bands[right][None, :, :]) & (bands[some][:, None, :] > 0)).argmax(-1) == band
            x, y = np.nonzero(ok)
            found.append((some[x], right[y]))
        x, y = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        pairs = []
        same: dict[int, int] = {}
        label = root if exact else rep  # likely pairs are only joined through their own rows: each must meet the exact test

        def top(k: int) -> int:
            while (up := same.get(k, k)) != k:
                same[k] = same.get(up, up)
                k = up
            return k

        for p, q in zip(x.tolist(), y.tolist()):
            u, v = top(int(label[p])), top(int(label[q]))
            if u != v and (not exact or similar(sets[p], sets[q])):
                same[max(u, v)] = min(u, v)
                pairs.append((int(rep[p]), int(rep[q])))
        if pairs:
            a, b = map(np.array, zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = np.stack([held.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield from compare(held.slice(a, b - a))
            if len(cuts):
                held = held.slice(int(cuts[-1]))
        if held is not None:
            yield from compare(held)
        trim()

    return cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def link(docs: DataFrame, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n_shingles, k1, k2 of every row; k1, k2, root of every class)."""
    spark = docs.sparkSession
    rows, _ = materialize(signatures(docs, width), "signatures")
    whole = rows.where("doc_id is not null and n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"))
    classes, _ = materialize(whole, "classes")
    bands = band_rows(classes)
    shared, shared_path = materialize(bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1").select("bucket", "pivot"), "buckets")
    members, members_path = materialize(bands.join(shared, "bucket"), "members")
    discard(spark, shared_path)

    # each class with the smallest member it shares most bands with
    best = members.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("n")).groupBy("rep").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    first, first_path = materialize(_likely(best.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), classes), "pairs")
    links = _verify(first, docs, classes, width)
    roots = components(links)

    # what is still apart in some bucket: clusters of likely pairs, then all pairs of a cluster on the full sets
    open_members, open_path = materialize(_open_members(members, roots), "open")
    likely = _in_blocks(open_members.join(classes.select("rep", "registers"), "rep"), "bucket", BLOCK, exact=False)
    clusters = components(likely)
    sizes = clusters.groupBy("root").agg((F.count("*") + 1).alias("n"))
    sized = clusters.join(sizes, "root").select(F.col("root").alias("cluster"), "n", F.col("node").alias("id"))
    nodes, nodes_path = materialize(sized.union(sizes.select("root", "n", "root")), "clusters")
    if not nodes.isEmpty():
        sets, sets_path = _exact_sets(docs, nodes.select("id"), classes, width)
        rest = nodes.withColumnRenamed("id", "rep").join(classes.select("rep", "registers"), "rep").join(sets, "rep")
        rest = rest.join(roots, rest["rep"] == roots["node"], "left").select("cluster", "n", "rep", F.coalesce("root", "rep").alias("root"), "registers", "set")
        more, _ = materialize(_in_blocks(rest, "cluster", 2 * BLOCK, exact=True), "links")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        discard(spark, sets_path)
    discard(spark, first_path, open_path, members_path, nodes_path)
    grouped = classes.join(roots, classes["rep"] == roots["node"], "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    return rows.drop("registers"), grouped


def _judged(docs: DataFrame, width: int) -> DataFrame:
    rows, classes = link(docs, width)
    found = rows.join(classes, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "t", "k1", "k2", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    return _judged(docs, width).drop("t", "k1", "k2")


def keep_one_each(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand for their group, with all their columns; rows with a null id stay, rows with one id and one set once.

    Different texts under one id are rows of their own: each stays unless it is another document's near-duplicate.
    """
    kept = _judged(docs, width).where("kept and doc_id is not null").groupBy("doc_id", "k1", "k2").agg(F.min("t").alias("t"))
    keyed = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    some = keyed.join(kept.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")), ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"]).select("row.*")
    return some.union(docs.where("doc_id is null"))
