"""Vectorised byte-level BPE over a block of texts.

The block is cut into pre-tokens, every *distinct* pre-token is folded by
ranked merges exactly once, and the pieces are gathered back to the documents.
All steps are numpy passes over flat arrays, so memory is a fixed multiple of
the block size and nothing depends on the corpus size.

Exactness: distinct pre-tokens are found by a 64-bit hash and every occurrence
is then compared with its representative; where two different pre-tokens share
a hash, the block is grouped by the bytes instead.
Texts with characters whose class may differ between Unicode versions, and
texts holding an added special string, go through the library itself.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
UNSTABLE = 8
_BIG = np.int64(1) << 30
#: A pre-token longer than this is folded with a heap, one by one.
LONG_WORD = 512
#: Multipliers of the hash tables (odd constants).
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_WHITE = frozenset([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point; UNSTABLE is added where Unicode 3.2 and the present version disagree."""

    def kind(category: str) -> int:
        return {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)

    old = unicodedata.ucd_3_2_0.category
    new = unicodedata.category
    table = np.full(0x110000, UNSTABLE, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        a = old(c)
        if a != "Cn":
            k = kind(a)
            if kind(new(c)) == k:
                table[cp] = SPACE if cp in _WHITE else k
    return table


class PairTable:
    """Immutable hash table from (left id, right id) to a merge's rank and id; lookups are array gathers."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.uint64) << np.uint64(20)) | np.asarray(right, np.uint64)
        rank, merged = np.asarray(rank, np.int64), np.asarray(merged, np.int64)
        self.rank, self.merged = rank, merged
        self.levels = []
        rows = np.arange(len(keys))
        while len(rows):
            bits = max(4, int(np.ceil(np.log2(len(rows) * 4))))
            mult = np.uint64(_MULTIPLIERS[len(self.levels) % len(_MULTIPLIERS)] + 2 * (len(self.levels) // len(_MULTIPLIERS)))
            shift = np.uint64(64 - bits)
            slot = (keys[rows] * mult) >> shift
            slots_k = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
            slots_v = np.full(1 << bits, -1, np.int32)
            slots_k[slot[::-1]] = keys[rows][::-1]
            slots_v[slot[::-1]] = rows[::-1]
            self.levels.append((mult, shift, slots_k, slots_v))
            rows = rows[slots_k[slot] != keys[rows]]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, -1 where there is no merge."""
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(len(keys), -1, np.int32)
        for mult, shift, slots_k, slots_v in self.levels:
            slot = (keys * mult) >> shift
            hit = slots_k[slot] == keys
            out[hit] = slots_v[slot[hit]]
        return out


class Blocks:
    """Pre-tokens of a block: byte data, start and length of each, and the document each belongs to."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.data = np.frombuffer(joined.encode(), np.uint8)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(cps)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        doc_start = np.concatenate([[0], np.cumsum(lens)])
        cls = char_classes()[cps]
        self.odd = np.zeros(len(texts), bool)
        if (cls >= UNSTABLE).any():
            self.odd[np.searchsorted(doc_start, np.flatnonzero(cls >= UNSTABLE), "right") - 1] = True
            cls = np.where(cls >= UNSTABLE, OTHER, cls)
        first = np.zeros(n + 1, bool)
        first[doc_start] = True
        run = first.copy()
        run[1:n] |= cls[1:] != cls[:-1]
        start = run[:n].copy()
        # white space: all but the last of a run stand alone when more text follows in the document
        after = np.flatnonzero(run[1:n] & ~first[1:n] & (cls[:-1] == SPACE)) + 1 if n else np.zeros(0, np.int64)
        start[after - 1] = True
        attached = after[cps[after - 1] == 32]
        start[attached] = False
        # contractions
        quote = np.flatnonzero((cps == 39) & run[:n] & start)
        quote = quote[quote + 1 < n]
        quote = quote[(cls[quote + 1] == LETTER) & ~first[quote + 1]]
        if len(quote):
            one = cps[quote + 1]
            two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], cps[np.minimum(quote + 2, n - 1)], 0)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for hit, width in ((single, 2), (double, 3)):
                at = quote[hit]
                start[at + 1] = False
                end = at + width
                end = end[end < n]
                end = end[(cls[end] == LETTER) & ~first[end]]
                start[end] = True
        where = np.flatnonzero(start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(where, doc_start)))
        if n == len(self.data):
            self.start = where
            self.end = np.append(where[1:], n)
        else:
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width)])
            self.start = at[where]
            self.end = np.append(self.start[1:], len(self.data))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat index of the slices [start, start + length), one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def _load(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first min(length, 8) bytes at each place as one number, the rest zero."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    view = np.ndarray((len(data) + 16,), np.dtype("<u8"), padded, 0, (1,))
    short = np.clip(length, 0, 8)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    return view[at] & masks[short]


class Distinct:
    """Distinct slices: code of each slice and, of each code, a representative row.

    Slices of up to 16 bytes are compared as two numbers, longer ones as bytes; a hash only finds the groups.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        import pandas as pd

        length = end - start
        small = length <= 16
        s, n = start[small], length[small]
        a, b = _load(data, s, n), _load(data, s + np.minimum(n, 8), n - 8)
        with np.errstate(over="ignore"):
            h = (a ^ (a >> np.uint64(29))) * np.uint64(_MULTIPLIERS[0]) + (b ^ (b >> np.uint64(31))) * np.uint64(_MULTIPLIERS[1]) + n.astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(_MULTIPLIERS[3])
            h ^= h >> np.uint64(30)
        codes, values = pd.factorize(h)
        rows = np.empty(len(values), np.int64)
        rows[codes[::-1]] = np.arange(len(codes))[::-1]
        rep = rows[codes]
        if not ((a[rep] == a).all() and (b[rep] == b).all() and (n[rep] == n).all()):  # a hash of two slices
            codes, values = pd.factorize(pd.MultiIndex.from_arrays([a, b, n]))
            rows = np.empty(len(values), np.int64)
            rows[codes[::-1]] = np.arange(len(codes))[::-1]
        #: hash, both halves and length of the distinct short slices
        self.h, self.a, self.b, self.n = h[rows], a[rows], b[rows], n[rows]
        self.rows = np.flatnonzero(small)[rows] if not small.all() else rows
        self.codes = codes
        if not small.all():
            self.codes = np.empty(len(start), np.int64)
            self.codes[small] = codes
            large = np.flatnonzero(~small)
            raw = data.tobytes()
            seen: dict[bytes, int] = {}
            more = [seen.setdefault(raw[x:y], len(seen)) for x, y in zip(start[large].tolist(), end[large].tolist())]
            more = np.array(more, np.int64)
            firsts = np.empty(len(seen), np.int64)
            firsts[more[::-1]] = large[::-1]
            self.codes[large] = more + len(self.rows)
            self.rows = np.concatenate([self.rows, firsts])


class WordCache:
    """Pieces of short pre-tokens seen in earlier blocks of this worker; it starts anew beyond `limit` words."""

    def __init__(self, limit: int = 1 << 17):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.h, self.a, self.b = (np.zeros(0, np.uint64) for _ in range(3))
        self.n, self.begin, self.per = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.int32)

    def find(self, d: Distinct) -> np.ndarray:
        """Place of each distinct short slice in the cache, -1 if it isn't there."""
        if not len(self.h):
            return np.full(len(d.h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h, d.h), len(self.h) - 1)
        hit = (self.h[at] == d.h) & (self.a[at] == d.a) & (self.b[at] == d.b) & (self.n[at] == d.n)
        return np.where(hit, at, -1)

    def add(self, d: Distinct, which: np.ndarray, ids: np.ndarray, per: np.ndarray) -> None:
        if len(self.h) + len(which) > self.limit:
            self.clear()
        if len(which) > self.limit:
            return
        begin = len(self.ids) + np.cumsum(per) - per
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        new = [np.concatenate([x, y]) for x, y in ((self.h, d.h[which]), (self.a, d.a[which]), (self.b, d.b[which]), (self.n, d.n[which]), (self.begin, begin), (self.per, per))]
        order = np.argsort(new[0], kind="stable")
        self.h, self.a, self.b, self.n, self.begin, self.per = (x[order] for x in new)


def _fold_long(word: np.ndarray, table: PairTable) -> list[int]:
    """Ranked merges of one long word with a heap and a linked list."""
    ids = list(map(int, word))
    n = len(ids)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    row = table.find(word[:-1], word[1:])
    heap = [(int(table.rank[r]), i, ids[i], ids[i + 1], int(table.merged[r])) for i, r in enumerate(row) if r >= 0]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            r = int(table.find(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r >= 0:
                heapq.heappush(heap, (int(table.rank[r]), i, ids[i], ids[j], int(table.merged[r])))

    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = new, -1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [x for x in ids if x >= 0]


def fold_words(tok: np.ndarray, length: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Fold each word (its byte ids flat in tok) by ranked merges, lowest rank and leftmost first: (ids, ids per word)."""
    n_words = len(length)
    long = np.flatnonzero(length > LONG_WORD)
    kept_t, kept_w = [], []
    word = np.repeat(np.arange(n_words), length)
    if len(long):
        begins = np.cumsum(length) - length
        for w in long:
            ids = np.array(_fold_long(tok[begins[w] : begins[w] + length[w]], table), np.int64)
            kept_t.append(ids)
            kept_w.append(np.full(len(ids), w))
        stay = ~np.isin(word, long)
        tok, word = tok[stay], word[stay]
    tok = tok.astype(np.int64)
    rows = np.full(len(tok), -1, np.int32)
    if len(tok) > 1:
        rows[:-1] = table.find(tok[:-1], tok[1:])
        rows[:-1][word[:-1] != word[1:]] = -1
    while len(tok):
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        key = np.where(rows >= 0, table.rank[rows], _BIG) << np.int64(32) | np.arange(len(tok))
        best = np.minimum.reduceat(key, begins)
        at = best[best < (_BIG << np.int64(32))] & np.int64(0xFFFFFFFF)
        if not len(at):
            kept_t.append(tok)
            kept_w.append(word)
            break
        tok[at] = table.merged[rows[at]]
        keep = np.ones(len(tok), bool)
        keep[at + 1] = False
        done = np.repeat(best >= (_BIG << np.int64(32)), np.diff(np.append(begins, len(tok))))
        if done.any():
            kept_t.append(tok[done])
            kept_w.append(word[done])
            keep &= ~done
        moved = np.cumsum(keep) - 1
        at = moved[at]
        tok, word, rows = tok[keep], word[keep], rows[keep]
        for i in (at, at[at > 0] - 1):
            has = i + 1 < len(tok)
            rows[i[~has]] = -1
            i = i[has]
            same = word[i] == word[i + 1]
            rows[i[~same]] = -1
            i = i[same]
            rows[i] = table.find(tok[i], tok[i + 1])
    if not kept_t:
        return np.zeros(0, np.int64), np.zeros(n_words, np.int64)
    all_t, all_w = np.concatenate(kept_t), np.concatenate(kept_w)
    order = np.argsort(all_w, kind="stable")
    return all_t[order], np.bincount(all_w, minlength=n_words)


class Encoder:
    """Encodes blocks of texts; `library` encodes one text where the fast path does not apply."""

    def __init__(self, byte_ids, table: PairTable, library, specials: tuple[str, ...] = ()):
        self.byte_ids = np.asarray(byte_ids, np.int64)
        self.table = table
        self.library = library
        self.specials = specials
        self.cache = WordCache()

    def _pieces(self, texts: list[str]):
        b = Blocks(texts)
        for s in self.specials:
            for i, t in enumerate(texts):
                if s in t:
                    b.odd[i] = True
        d = Distinct(b.data, b.start, b.end)
        known = self.cache.find(d)
        todo = np.concatenate([np.flatnonzero(known < 0), np.arange(len(d.h), len(d.rows))])
        rows = d.rows[todo]
        length = b.end[rows] - b.start[rows]
        ids, per = fold_words(self.byte_ids[b.data[spread(b.start[rows], length)]], length, self.table)
        have = np.flatnonzero(known >= 0)
        old = self.cache
        all_ids = np.concatenate([old.ids, ids.astype(np.int32)])
        begin, count = np.empty(len(d.rows), np.int64), np.empty(len(d.rows), np.int64)
        begin[have], count[have] = old.begin[known[have]], old.per[known[have]]
        begin[todo], count[todo] = len(old.ids) + np.cumsum(per) - per, per
        short = todo < len(d.h)
        n_short = int(per[short].sum())
        self.cache.add(d, todo[short], ids[:n_short], per[short])
        return b, d.codes, all_ids, begin, count

    def count(self, texts: list[str]) -> np.ndarray:
        """Pieces of each text: counted once per distinct pre-token, joined to the texts' pre-tokens and summed."""
        if not any(texts):
            return np.zeros(len(texts), np.int64)
        b, codes, _, _, per = self._pieces(texts)
        out = np.bincount(b.doc, weights=per[codes], minlength=len(texts)).astype(np.int64)
        for i in np.flatnonzero(b.odd):
            out[i] = len(self.library(texts[i]))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, flat int32; number of ids of each text)."""
        if not any(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        b, codes, ids, begins, per = self._pieces(texts)
        counts = np.bincount(b.doc, weights=per[codes], minlength=len(texts)).astype(np.int64)
        flat = ids[spread(begins[codes], per[codes])].astype(np.int32)
        if b.odd.any():
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(b.odd):
                parts[i] = np.asarray(self.library(texts[i]), np.int32)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, counts


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


@lru_cache(4)
def json_encoder(path: str) -> Encoder:
    """Encoder equal to the tokenizers library with the byte-level BPE file at path, without added tokens around."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    letters = _byte_letters()
    byte_ids = np.zeros(256, np.int64)
    for letter, b in letters.items():
        byte_ids[b] = vocab[letter]
    table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
    library = Tokenizer.from_file(path)
    return Encoder(byte_ids, table, lambda t: library.encode(t, add_special_tokens=False).ids, tuple(x["content"] for x in spec["added_tokens"]))


@lru_cache(4)
def rank_map(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def rank_encoder(path: str, pattern: str) -> Encoder:
    """Encoder equal to tiktoken with the rank file at path: any two neighbours whose concatenation has a rank merge."""
    import tiktoken

    ranks = rank_map(path)
    left, right, rank = [], [], []
    for word, r in ranks.items():
        for i in range(1, len(word)):
            a, b = ranks.get(word[:i]), ranks.get(word[i:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Encoder([ranks[bytes([b])] for b in range(256)], PairTable(left, right, rank, rank), library.encode_ordinary)
