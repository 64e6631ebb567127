"""Byte-level BPE encoding and decoding in padded numpy matrices.

Each text is cut by the tokenizer's pattern; a piece that the vocabulary holds whole is one id. The other pieces of a batch
go into matrices of one row each, by length. Every round looks up all adjacent pairs in a hash table, merges the leftmost
pair of minimum rank in every row, closes the gap and drops rows that are finished. Pieces beyond LONG bytes would make the
matrices quadratic; they take the same merges in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os

import numpy as np
import regex
from pyspark.sql import DataFrame

from linewright.llm.common import map_arrow, pieces

LONG = 512
CACHE = 400_000
NONE = np.int32(2**31 - 1)
#: A vocabulary is shipped with every task, so its file has a size limit.
MAX_VOCABULARY = 32 << 20


def read_vocabulary(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """Open addressing: the id that two adjacent ids merge to, or NONE."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (len(pairs) * 3).bit_length())
        n = 1 << self.bits
        self.keys, self.values = np.full(n, self.EMPTY), np.full(n, NONE)
        keys, values = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (n - 1)

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left, right):
        """left, right: int arrays of one shape; a negative id has no pair."""
        out = np.full(left.shape, NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[todo].astype(np.uint64) << np.uint64(32)) | right.ravel()[todo].astype(np.uint64)
        at, flat = self._home(keys), out.ravel()
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            flat[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != self.EMPTY)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs, self.pair_dict = PairTable(pairs), pairs
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: bytes, pattern: str) -> Bpe:
        key = (hashlib.sha256(vocabulary).digest(), pattern)
        if _LAST.get("key") != key:
            _LAST.update(key=key, value=cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}, pattern))
        return _LAST["value"]

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of each row; the rows share a matrix, so their lengths should be near each other."""
        lens = np.array([len(r) for r in rows])
        width = int(lens.max())
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        out: list = [None] * len(rows)
        who, cols = np.arange(len(rows)), np.arange(width)
        rank = self.pairs(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 0), NONE)
        while True:
            if rank.shape[1]:
                at = rank.argmin(1)
                best = rank[np.arange(len(who)), at]
                go = best < NONE
            else:
                go = np.zeros(len(who), bool)
            for i in np.flatnonzero(~go):
                out[who[i]] = ids[i, : lens[i]]
            if not go.any():
                return out
            ids, rank, who, lens, at, best = ids[go], rank[go], who[go], lens[go], at[go], best[go]
            lens = lens - 1
            width = int(lens.max())
            r = np.arange(len(who))
            take = cols[:width] + (cols[:width] > at[:, None])
            last = ids.shape[1] - 1
            ids = np.where(cols[:width] < lens[:, None], np.take_along_axis(ids, np.minimum(take, last), 1), np.int32(-1))
            ids[r, at] = best
            if width < 2:
                rank = np.full((len(who), 0), NONE)
                continue
            rank = np.take_along_axis(np.concatenate([rank, np.full((len(who), 1), NONE)], 1), np.minimum(take[:, : width - 1], rank.shape[1]), 1)
            rank[cols[: width - 1] >= lens[:, None] - 1] = NONE
            right = at < lens - 1
            rank[r[right], at[right]] = self.pairs(ids[r[right], at[right]], ids[r[right], at[right] + 1])
            left = at > 0
            rank[r[left], at[left] - 1] = self.pairs(ids[r[left], at[left] - 1], ids[r[left], at[left]])

    def merge_long(self, row: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(row, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair_dict.get
        heap = [(x, i) for i in range(n - 1) if (x := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pair(ids[i] << 32 | ids[j]) != x:
                continue
            ids[i], ids[j] = x, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (y := pair(x << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (y, i))
            if (h := before[i]) >= 0 and (y := pair(ids[h] << 32 | x)) is not None:
                heapq.heappush(heap, (y, h))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _learn(self, new: set[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.cache[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                by_length.setdefault((len(raw) + 3) // 4 if len(raw) <= 32 else 8 * len(raw).bit_length(), []).append((piece, raw))
        for group in by_length.values():
            for i in range(0, len(group), 4096):
                run = group[i : i + 4096]
                for (piece, _), ids in zip(run, self.merge_rows([raw for _, raw in run]), strict=True):
                    self.cache[piece] = ids.astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pattern.findall(t) for t in texts]
        own = set().union(*cut)
        new = own.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = own
        self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LAST: dict = {}


def _encode(batches, vocabulary, pattern, with_ids):
    bpe = Bpe.of(vocabulary, pattern)
    for b in pieces(batches, 200):
        texts = [x or "" for x in b.column(1).to_pylist()]
        ids = bpe.encode_batch(texts)
        back = [bpe.decode(x) for x in ids]
        yield {
            "doc_id": b.column(0),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
        } | ({"ids": [np.frombuffer(x, "<u4").astype(np.int64) for x in ids], "decoded": [x.decode() for x in back]} if with_ids else {})


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Ids of each text and the text decoded from them, one row per row of docs (doc_id, text).

    A null text is empty and has no ids; null and repeated doc_ids pass through; other columns are ignored. Rows never meet,
    so there is no shuffle, and a task holds one run of texts and a bounded cache of pieces.
    """
    return map_arrow(docs.select("doc_id", "text"), _encode, DIGESTS + (", ids array<long>, decoded string" if with_ids else ""), read_vocabulary(vocabulary_path), pattern, with_ids)
