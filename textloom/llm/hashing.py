"""Hashes and fixed-size filters over flat numpy arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A membership filter has BITS to twice as many bits a member, so about one stranger in a thousand passes, and is made
#: for at most so many members: 32 MB at most are broadcast. Callers join where make_filter gives none.
FILTER_MEMBERS, BITS, LEAST_BITS = 1 << 21, 64, 1 << 16
_M = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Base of the polynomial hash, an odd number.
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M[0]
        x = (x ^ (x >> np.uint64(27))) * _M[1]
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), np.uint64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class PrefixHash:
    """Hash of any byte slice of data in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(data.astype(np.uint64) + _M[2]) * up[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        """Hash of every slice of `width` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice."""
    length = end - start
    h = mix(length.astype(np.uint64) * _M[2])
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    view = np.ndarray((len(data) + 8,), np.dtype("<u8"), padded, 0, (1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    live, j = np.arange(len(start)), 0
    while len(live) and j < 256:
        x = view[start[live] + j] & masks[np.minimum(length[live] - j, 8)]
        h[live] = mix(h[live] ^ x) + _STEP
        j += 8
        live = live[length[live] > j]
    for i in live.tolist():  # words of more than 256 bytes
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h, low = mix(ids.view(np.uint64) + _M[2]), np.uint64(bits - 1)
    return [(h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)]


def make_filter(ids: DataFrame) -> np.ndarray | None:
    """Filter over the longs in column `id`, made by aggregation and sized by their number; none for over FILTER_MEMBERS of them."""
    n = ids.count()
    if n > FILTER_MEMBERS:
        return None
    size = max(LEAST_BITS, 1 << (BITS * n).bit_length())

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(places(batch.column("id").to_numpy(), size)))
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(bit.view(np.int64))], ["word", "bits"])

    rows = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").mapInArrow(run, "word long, bits long")
    words = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be a member; true for every member."""
    hit = np.ones(len(ids), bool)
    for at in places(ids, len(bits) * 64):
        hit &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return hit
