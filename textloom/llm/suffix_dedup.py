"""Removal of repeated passages by prefix doubling over sampled positions.

A byte goes if a string of LENGTH bytes that covers it also starts at another
place of the corpus; with unit="words", a word goes if a sequence of
`length` words that covers it does, whatever white space is between them. Prefix doubling ranks positions by strings of growing
length and drops a position as soon as its rank is unique. Two things keep it
small:

* Positions are sampled first. Of the GRAM-byte strings inside a window of
  LENGTH bytes the one with the smallest hash is the window's anchor, so equal
  windows have equal anchors at equal offsets, and about one position in a
  hundred is an anchor. Anchors are ranked by their GRAM bytes; windows of an
  anchor with a unique rank are unique. An anchor whose surroundings (all its
  windows) are the same wherever it occurs is repeated as a whole.
* Only windows around the other anchors, at the edges of repeated passages,
  go on to the next offset: they are ranked by the pair (rank of the first
  half, rank of the second half), which is past the threshold of LENGTH bytes.
  Each different surrounding takes part once, whatever its number of copies.

Ranks are 64-bit hashes, 96 bits for the pairs, aggregated with map-side
combining: a group of one row *is* the unique position, so uniqueness needs no
join back and a frequent passage sends one row per task, not one per copy.
The unique positions of a text are then joined to it, all others go.

Null texts count as empty. Texts under LENGTH bytes stay whole. Equal rows are
copies of each other: repeated rows of LENGTH bytes or more lose all bytes.
Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import blocks, discard, materialize, trim
from textloom.llm.hashing import PrefixHash, in_filter, make_filter, mix, word_hashes

LENGTH, GRAM = 400, 200
#: A passage of words, for unit="words": over 50 of them.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 25
#: Bytes of a text that are looked at at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Bytes of a text that are worked on together; a longer text takes several rounds, so memory doesn't grow with it.
PART = 8 * PIECE
#: Bits of a position beside a hash; they only tell the positions of one window apart.
_POSITION = 24


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def symbols(texts: list[bytes], unit: str) -> list:
    """The texts as sequences that windows are cut from: their bytes, or a hash of each word."""
    if unit == "bytes":
        return texts
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, end = word_places(data)
    begin = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.split(word_hashes(data, start, end), np.searchsorted(start, begin[:-1]))


class Windows:
    """Windows of a block of sequences (bytes, or hashes of words) by anchor: runs of window starts that share an anchor."""

    def __init__(self, texts: list, length: int = LENGTH, gram: int = GRAM):
        self.length = length
        width = length - gram + 1
        pieces, self.piece_doc, self.piece_at = [], [], []
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t) - length + 1), PIECE):
                if len(t) - at >= length:
                    pieces.append(t[at : at + PIECE + length - 1])
                    self.piece_doc.append(i)
                    self.piece_at.append(at)
        self.data = np.concatenate([np.frombuffer(p, np.uint8) if isinstance(p, bytes) else p for p in pieces] or [np.zeros(0, np.uint8)])
        self.hash = PrefixHash(self.data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(sizes) - sizes
        grams = self.hash.all(gram)
        n = len(grams)
        if not n:
            self.doc = self.lo = self.n = np.zeros(0, np.int64)
            self.start = np.zeros(0, np.int64)
            self.gram = self.whole = np.zeros(0, np.uint64)
            return
        # smallest hash of each `width` grams: prefix and suffix minima of rows of `width`
        rows = -(-n // width) + 1
        key = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        low = np.uint64((1 << _POSITION) - 1)
        key[:n] = (grams & ~low) | (np.arange(n, dtype=np.uint64) & low)
        grid = key.reshape(rows, width)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(grid, axis=1).ravel()
        total = len(self.data) - length + 1
        least = np.minimum(after[:total], before[width - 1 : width - 1 + total])
        # the anchor stands less than `width` behind the window's start, so its low bits tell its place
        first = np.arange(total, dtype=np.uint64)
        with np.errstate(over="ignore"):
            anchor = (first + ((least - first) & low)).astype(np.int64)
        valid = np.zeros(total + 1, bool)
        ends = begin + sizes - length + 1
        mark = np.zeros(total + 1, np.int64)
        np.add.at(mark, begin, 1)
        np.add.at(mark, np.minimum(ends, total), -1)
        valid = np.cumsum(mark)[:total] > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        new[begin] = True
        start = np.flatnonzero(new)
        # a run ends where the next begins or the piece's windows end
        piece = np.searchsorted(begin, start, "right") - 1
        stop = np.minimum(np.append(start[1:], total), ends[piece])
        self.start, self.n = start, stop - start
        self.doc = np.asarray(self.piece_doc, np.int64)[piece]
        self.lo = start - begin[piece] + np.asarray(self.piece_at, np.int64)[piece]
        self.gram = grams[anchor[start]]
        with np.errstate(over="ignore"):
            self.whole = mix(self.hash.slices(start, stop - 1 + length) + self.n.astype(np.uint64))


def _parts(texts: list, length: int, gram: int):
    """Windows of a block of texts, those of a long text in parts of PART window starts."""
    for i, t in enumerate(texts if max(map(len, texts), default=0) > PART else []):
        for at in range(0, max(1, len(t) - length + 1), PART):
            w = Windows([t[at : at + PART + length - 1]], length, gram)
            w.doc, w.lo = w.doc + i, w.lo + at
            yield w
    if max(map(len, texts), default=0) <= PART:
        yield Windows(texts, length, gram)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """key (hash of the text), text of every row with a text."""
    return docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text")).where(F.col("text").isNotNull())


def _anchors(texts: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, block in blocks(batch, "text", PIECE):
                for w in _parts(symbols(block.column("text").to_pylist(), unit), length, gram):
                    key = block.column("key").to_numpy()[w.doc]
                    yield pa.RecordBatch.from_arrays([pa.array(w.gram.view(np.int64)), pa.array(w.whole.view(np.int64)), pa.array(key), pa.array(w.lo), pa.array(w.n.astype(np.int32))], ["gram", "whole", "key", "lo", "n"])
        trim()

    return texts.mapInArrow(run, "gram long, whole long, key long, lo long, n int")


def _row_id(key: np.ndarray, lo: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(key.view(np.uint64)) + lo.astype(np.uint64)).view(np.int64)


def _with_id(rows: DataFrame) -> DataFrame:
    """gram, whole, key, lo, n with the id of the row."""

    def run(batches):
        for b in batches:
            id_ = pa.array(_row_id(b.column("key").to_numpy(), b.column("lo").to_numpy()))
            yield pa.RecordBatch.from_arrays([id_, *b.columns], ["id", *b.schema.names])

    return rows.select("gram", "whole", "key", "lo", "n").mapInArrow(run, "id long, gram long, whole long, key long, lo long, n int")


def _passing(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows with one of the grams (id), and a few others where the grams are few enough for a filter."""
    bits = make_filter(grams)
    if bits is None:
        return _with_id(rows.join(grams, F.col("gram") == F.col("id"), "left_semi"))
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column("gram").to_numpy())))

    return _with_id(rows.select("gram", "whole", "key", "lo", "n").mapInArrow(run, "gram long, whole long, key long, lo long, n int"))


def _edge_windows(texts: DataFrame, chosen: DataFrame, ranks: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    """first, second (ranks of both halves), key, lo of every window of the chosen rows, and of a few others; ranks: the repeated ones (id)."""
    ids, keys, grams = make_filter(chosen.select("id")), make_filter(chosen.select(F.col("key").alias("id"))), make_filter(ranks)
    if ids is None or grams is None:
        some = texts.join(chosen.groupBy(F.col("key").alias("at")).agg(F.collect_list("lo").alias("los")), F.col("key") == F.col("at")).select("key", "text", "los")
        share = None
    else:
        some, share = texts, texts.sparkSession.sparkContext.broadcast((keys, ids, grams))

    def picked(w: Windows, block: pa.RecordBatch, key: np.ndarray) -> np.ndarray:
        if not len(w.n):
            return np.zeros(0, np.int64)
        if share is not None:
            near = np.flatnonzero(in_filter(share.value[2], w.gram.view(np.int64)))
            return near[in_filter(share.value[1], _row_id(key, w.lo)[near])]
        los = block.column("los").to_pylist()
        wanted = np.concatenate([_row_id(np.full(len(x), k, np.int64), np.asarray(x, np.int64)) for k, x in zip(block.column("key").to_pylist(), los)])
        return np.flatnonzero(np.isin(_row_id(key, w.lo), wanted))

    def run(batches):
        for batch in batches:
            if share is not None:
                batch = batch.filter(pa.array(in_filter(share.value[0], batch.column("key").to_numpy())))
            for _, block in blocks(batch, "text", PIECE):
                for w in _parts(symbols(block.column("text").to_pylist(), unit), length, gram):
                    key = block.column("key").to_numpy()[w.doc]
                    hit = picked(w, block, key)
                    for part in np.array_split(hit, 1 + len(hit) // 4096):
                        n = w.n[part]
                        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        at = np.repeat(w.start[part], n) + step
                        half = length // 2
                        one, two = w.hash.slices(at, at + half), w.hash.slices(at + half, at + length)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(mix(one ^ (two >> np.uint64(7))).view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(np.repeat(key[part], n)), pa.array((np.repeat(w.lo[part], n) + step).astype(np.int64))],
                            ["first", "second", "key", "lo"],
                        )
        trim()

    return some.mapInArrow(run, "first long, second int, key long, lo long")


def unique_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, unit: str = "bytes") -> tuple[DataFrame, str]:
    """(key, spans: ranges (first window start, number) of a text's windows that occur nowhere else, with negative numbers those that do; its folder)."""
    spark = docs.sparkSession
    texts = _keyed(docs, text_col)
    rows, rows_path = materialize(_anchors(texts, length, gram, unit), "anchors")
    ranked = rows.groupBy("gram").agg(F.count("*").alias("c"), F.min("whole").alias("a"), F.max("whole").alias("z"), F.min(F.struct("key", "lo", "n")).alias("row")).where("c = 1 or a <> z")
    ranked, ranked_path = materialize(ranked.select("gram", (F.col("c") == 1).alias("alone"), "row.*"), "ranks")
    again = ranked.where("not alone").select(F.col("gram").alias("id"))
    chosen = _passing(rows, again).groupBy("gram", "whole").agg(F.count("*").alias("c"), F.min(F.struct("id", "key", "lo", "n")).alias("row")).select("c", "row.*")
    chosen, chosen_path = materialize(chosen, "chosen")
    discard(spark, rows_path)
    edges = _edge_windows(texts, chosen, again, length, gram, unit).groupBy("first", "second").agg(F.count("*").alias("c"), F.min(F.struct("key", "lo")).alias("row")).where("c = 1")
    # a chosen row that stands for several has no unique windows, though it took part once: negative numbers
    stands = chosen.where("c > 1").select("key", "lo", -F.col("n"))
    singles = ranked.where("alone").select("key", "lo", "n").union(edges.select("row.key", "row.lo", F.lit(1))).union(stands)
    spans, spans_path = materialize(singles.groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "spans")
    discard(spark, ranked_path, chosen_path)
    return spans, spans_path


def removed_spans(size: int, lo: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that go, given the ranges of unique (and repeated) windows of a text of `size` bytes."""
    windows = size - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = np.zeros(windows + 1, np.int64)
    unique = n > 0
    np.add.at(mark, lo[unique], 1)
    np.add.at(mark, (lo + n)[unique], -1)
    repeated = np.cumsum(mark[:windows]) == 0
    for a, k in zip(lo[~unique].tolist(), n[~unique].tolist()):
        repeated[a : a - k] = True
    edge = np.diff(np.concatenate([[0], repeated.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length
    if not len(start):
        return start, end
    apart = np.ones(len(start), bool)
    apart[1:] = start[1:] > end[:-1]
    return start[apart], end[np.append(apart[1:], True)]


def removed_bytes(text: bytes, lo: np.ndarray, n: np.ndarray, length: int, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that go; of words, from the first byte of the first to the last of the last."""
    if unit == "bytes":
        return removed_spans(len(text), lo, n, length)
    if len(text) < 2 * length - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = word_places(np.frombuffer(text, np.uint8))
    start, end = removed_spans(len(first), lo, n, length)
    return first[start], last[end - 1]


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, unit: str = "bytes") -> DataFrame:
    """All rows and columns of docs with `removal`: struct of kept (remaining bytes), n_bytes, n_removed, n_spans."""
    spans, _ = unique_ranges(docs, text_col, length, gram, unit)

    @F.arrow_udf("struct<kept: binary, n_bytes: long, n_removed: long, n_spans: long>")
    def cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
        return _cut(text, ranges, length, unit)

    return _with_spans(docs, text_col, spans).select("row", cut("text", "spans0").alias("removal"))


def _cut(text: pa.Array, ranges: pa.Array, length: int, unit: str) -> pa.StructArray:
    out = []
    for t, r in zip(text.to_pylist(), ranges):
        r = r.values if r.is_valid else None
        lo = r.field("lo").to_numpy() if r is not None else np.zeros(0, np.int64)
        n = r.field("n").to_numpy() if r is not None else np.zeros(0, np.int64)
        start, end = removed_bytes(t, lo, n, length, unit)
        kept = b"".join(t[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(t)]))
        out.append((kept, len(t), len(t) - len(kept), len(start)))
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*out)) or [()] * 4
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["kept", "n_bytes", "n_removed", "n_spans"])


def _with_spans(docs: DataFrame, text_col: str, *spans: DataFrame) -> DataFrame:
    """row (all columns of docs), text as bytes, and spans0, spans1 ... of the text; texts are joined once, so that a hot text's join can be split."""
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(text_col).alias("key"))
    each = [s.select(F.col("key").alias("at"), F.col("spans").alias(f"spans{i}")) for i, s in enumerate(spans)]
    both = reduce(lambda a, b: a.join(b, "at", "full_outer"), each)
    return named.join(both, F.col("key") == F.col("at"), "left")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """All rows of docs with the repeated passages cut from text and n_chars made to fit; halves of characters at a cut go too. how: length, gram, unit."""
    rows = remove_repeats(docs, **how)
    text = F.when(F.col("row.text").isNotNull(), _readable("removal.kept"))
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def _readable(kept: str) -> Column:
    """Bytes as text, without broken characters."""

    @F.arrow_udf("string")
    def run(kept: pa.Array) -> pa.Array:
        return pa.array([None if k is None else k.decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())

    return run(kept)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage_bytes (those in passages of over 50 words that occur elsewhere too) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    said, _ = unique_ranges(rows, "text", PASSAGE_WORDS, PASSAGE_GRAM, "words")
    spans, _ = unique_ranges(rows)
    fields = "kept: binary, n_bytes: long, n_removed: long, n_spans: long, n_passage_bytes: long"

    @F.arrow_udf(f"struct<{fields}>")
    def cut(text: pa.Array, ranges: pa.Array, passages: pa.Array) -> pa.Array:
        one, two = _cut(text, ranges, LENGTH, "bytes"), _cut(text, passages, PASSAGE_WORDS, "words")
        return pa.StructArray.from_arrays([*one.flatten(), two.field("n_removed")], [f.split(":")[0] for f in fields.split(", ")])

    found = _with_spans(rows, "text", spans, said).select("row.doc_id", cut("text", "spans0", "spans1").alias("removal"))
    return found.select("doc_id", "removal.n_bytes", "removal.n_removed", "removal.n_spans", F.sha2("removal.kept", 256).alias("kept_sha256"), "removal.n_passage_bytes")
