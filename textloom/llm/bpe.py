"""Byte-level BPE by merge ranks, and back.

Texts are cut by the pre-token pattern; the byte arrays of a block's distinct
words are folded by ranked merges against the rank map (lowest rank, leftmost
first), all words of the block at once; a document's ids are gathered from its
words. Decoding concatenates the binary pieces of the ids.

Whole texts are folded in Arrow blocks. `fold_words_sql` and `decode_sql` are
the same steps in Spark's higher-order functions, over a table of distinct
words and a literal rank map; the README says what they cost.

Null texts count as empty: no ids, empty bytes. Empty tables give empty
results, rows repeat as they come in, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm import bpe_kernel
from textloom.llm.common import id_and_text, map_text_blocks

#: Groups that the literal rank map is split into: Spark searches a map key by key.
RANK_GROUPS = 1 << 14
#: Stands for "no merge"; above every rank.
NO_RANK = 1 << 30


@lru_cache(4)
def _pieces(ranks: str) -> pa.Array:
    """Bytes of every id, null where an id is free."""
    by_id = {r: w for w, r in bpe_kernel.rank_map(ranks).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())


@lru_cache(4)
def _decimals(n: int) -> pa.Array:
    return pa.array([str(i) for i in range(n)], pa.string())


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def encode_block(texts: list[str], ranks: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    return bpe_kernel.rank_encoder(ranks, pattern).encode(texts)


def decode_block(ids: np.ndarray, counts: np.ndarray, ranks: str) -> pa.Array:
    """Bytes of each document: its ids' pieces, concatenated."""
    return pc.binary_join(_lists(_pieces(ranks).take(pa.array(ids)), counts), pa.scalar(b"", pa.binary()))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row."""

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encode_block(block.column("text").to_pylist(), ranks, pattern)
        return pa.RecordBatch.from_arrays([block.column("doc_id"), _lists(pa.array(ids, pa.int32()), counts)], ["doc_id", "ids"])

    return map_text_blocks(id_and_text(docs, id_col, text_col), kernel, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes of every row of `encoded`; null ids count as none, unknown ids are an error."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            counts = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decode_block(ids.flatten().to_numpy(zero_copy_only=False), counts, ranks)], ["doc_id", "bytes"])

    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode, then decode, in one pass over the blocks."""

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encode_block(block.column("text").to_pylist(), ranks, pattern)
        size = len(_pieces(ranks))
        lines = pc.binary_join(_lists(_decimals(size).take(pa.array(ids)), counts), " ")
        back = decode_block(ids, counts, ranks)
        sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), sha(lines), sha(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_text_blocks(id_and_text(docs, id_col, text_col), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_ranks(ranks: str) -> Callable[[Column], Column]:
    """Rank of a piece given in hex, NO_RANK where it has none: a literal array of maps, by checksum."""
    groups: list[dict[str, int]] = [{} for _ in range(RANK_GROUPS)]
    for word, rank in bpe_kernel.rank_map(ranks).items():
        groups[zlib.crc32(key := word.hex().upper().encode()) % RANK_GROUPS][key.decode()] = rank
    literal = F.from_json(F.lit(json.dumps(groups)), "array<map<string,int>>")
    return lambda piece: F.coalesce(F.try_element_at(F.get(literal, (F.crc32(piece.cast("binary")) % RANK_GROUPS).cast("int")), piece), F.lit(NO_RANK))


def fold_words_sql(words: DataFrame, ranks: str, word_col: str = "word") -> DataFrame:
    """word, ids of each row of distinct pre-tokens (binary), by higher-order functions only.

    A state of pieces and the ranks of neighbours is folded: the lowest rank,
    leftmost first, is merged and only its two neighbours are ranked again.
    A word of n bytes takes n - 1 steps of up to n entries. A null or empty
    word has no ids.
    """
    rank = _literal_ranks(ranks)
    none = F.array().cast("array<int>")
    text = F.hex(word_col)

    def merged(state: Column, at: Column) -> Column:
        p, r = state["p"], state["r"]
        size = F.size(p)

        def joined(new: Column) -> Column:
            left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), new)))).otherwise(none)
            right = F.when(at + 1 < size, F.array(rank(F.concat(new, F.get(p, at + 1))))).otherwise(none)
            before = F.when(at > 2, F.slice(r, 1, F.greatest(at - 2, F.lit(0)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, 1, at - 1), F.array(new), F.slice(p, at + 2, size)).alias("p"),
                F.concat(before, left, right, F.slice(r, at + 2, size)).alias("r"),
            )

        return _let(F.concat(F.get(p, at - 1), F.get(p, at)), joined)

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state["r"]), lambda low: F.when(F.coalesce(low, F.lit(NO_RANK)) == NO_RANK, state).otherwise(_let(F.array_position(state["r"], low).cast("int"), lambda at: merged(state, at))))

    n = F.length(word_col)
    start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * 2 + 1, F.lit(2)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: rank(F.substring(text, i * 2 + 1, F.lit(4))))).otherwise(none)
    folded = F.aggregate(F.sequence(F.lit(1), n), F.struct(start.alias("p"), pairs.alias("r")), step, lambda state: F.transform(state["p"], rank))
    whole = rank(text)
    ids = F.when(F.coalesce(n, F.lit(0)) == 0, none).when(whole < NO_RANK, F.array(whole)).otherwise(folded)
    return words.select(F.col(word_col).alias("word"), ids.alias("ids"))


def decode_sql(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes: the ids' binary pieces, concatenated by built-in functions; null ids count as none."""
    pieces = F.split(F.lit(",".join((x.as_py() or b"").hex() for x in _pieces(ranks))), ",")
    text = F.concat_ws("", F.transform(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: F.element_at(pieces, i + 1)))
    return encoded.select(F.col(id_col).alias("doc_id"), F.unhex(text).alias("bytes"))
