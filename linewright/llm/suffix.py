"""Suffix-array dedup: suffix arrays of shards by induced sorting, longest common prefixes by text position.

Suffixes are S (smaller than the next) or L. The leftmost S of a run starts a substring that ends at the next such place.
These substrings are sorted and named, the string of names is sorted recursively, and the order of its suffixes induces the
order of all others in two linear scans. Scans go bucket by bucket (equal first bytes), each step moving all suffixes that a
bucket's known ones induce. Deeper levels have names in place of bytes and nearly as many buckets as suffixes, so there each
suffix's part up to the next leftmost S and the rank of the suffix there give its order directly.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, map_arrow, pieces, texts
from linewright.llm.repeats import Symbols, covered, repeated

LENGTH, GRAM = 400, 200


def types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are S, and the places of leftmost ones; the last symbol must be the single smallest."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    small = np.ones(n, bool)
    small[:-1] = step[after] > 0
    left = np.zeros(n, bool)
    left[1:] = small[1:] & ~small[:-1]
    return small, np.flatnonzero(left)


def _rank_parts(t: np.ndarray, start: np.ndarray, end: np.ndarray, tail: np.ndarray | None) -> np.ndarray:
    """Ranks of t[start..end] (end included), a part that is a prefix of another being larger; then of tail.

    As many symbols as a long holds are read at a time, and only parts still tied with another are read on.
    """
    n, top = len(start), int(t.max()) + 1
    bits = top.bit_length()
    step = max(1, 62 // bits)
    rank = np.zeros(n, np.int64)
    todo, depth = np.arange(n), 0
    while len(todo):
        at, stop = start[todo] + depth, end[todo]
        key = np.zeros(len(todo), np.int64)
        for k in range(step):
            key = key << bits | np.where(at + k <= stop, t[np.minimum(at + k, len(t) - 1)], np.where(at + k == stop + 1, top, 0))
        order = np.lexsort((key, rank[todo])) if depth else np.argsort(key, kind="stable")
        who, key = todo[order], key[order]
        r = rank[who]
        head = np.ones(len(who), bool)
        head[1:] = r[1:] != r[:-1]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        # a group's rank is its first member's place among all
        place = np.arange(len(who))
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[who] = r + first - np.maximum.accumulate(np.where(head, place, 0))
        alone = new & np.append(new[1:], True)
        depth += step
        todo = who[~alone & (start[who] + depth <= end[who] + 1)]
    if tail is not None:
        order = np.lexsort((tail, rank))
        rank[order] = np.arange(n)
    return rank


def _order_names(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names whose last is the single smallest."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    _, left = types(t)
    # the last symbol is leftmost S by definition, so every suffix but it has a next one
    after = left[np.searchsorted(left, np.arange(n - 1), side="right")]
    names = _rank_parts(t, left[:-1], left[1:], None) if len(left) > 1 else np.zeros(0, np.int64)
    lookup = np.zeros(n, np.int64)
    if len(np.unique(names)) == len(names):
        lookup[left[:-1]] = names + 1
    else:
        reduced = np.append(np.unique(names, return_inverse=True)[1] + 1, 0)
        sub = _order_names(reduced)
        place = np.empty(len(sub), np.int64)
        place[sub] = np.arange(len(sub))
        lookup[left] = place
    ranks = _rank_parts(t, np.arange(n - 1), after, lookup[after])
    out = np.empty(n, np.int64)
    out[0] = n - 1
    out[ranks + 1] = np.arange(n - 1)
    return out


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost S ones (seeds) in order."""
    n = len(t)
    out = np.full(n, -1, np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    first = t[seeds]
    seed_counts = np.bincount(first, minlength=len(counts))
    seed_at = np.cumsum(seed_counts) - seed_counts
    used = np.flatnonzero(counts).tolist()

    def move(src, cursor, want_small):
        """Suffixes before src of the wanted kind go behind (or, from the right, before) what their buckets hold."""
        p = src[src > 0] - 1
        p = p[small[p] == want_small]
        if not len(p):
            return
        b = t[p]
        o = np.argsort(b, kind="stable")
        p, b = p[o], b[o]
        c = np.bincount(b, minlength=len(counts))
        k = np.arange(len(p)) - (np.cumsum(c) - c)[b]
        if want_small:
            out[cursor[b] - 1 - k] = p
            np.subtract(cursor, c, out=cursor)
        else:
            out[cursor[b] + k] = p
            np.add(cursor, c, out=cursor)

    head = starts.copy()
    for c in used:
        done = starts[c]
        while done < head[c]:
            now = out[done : head[c]]
            done = head[c]
            move(now, head, False)
        move(seeds[seed_at[c] : seed_at[c] + seed_counts[c]], head, False)
    tail = ends.copy()
    for c in reversed(used):
        done = ends[c]
        while done > tail[c]:
            now = out[tail[c] : done][::-1]
            done = tail[c]
            move(now, tail, True)
        large = out[starts[c] : head[c]][::-1]
        move(large, tail, True)
    out[0] = n - 1  # the end is S, but nothing induces it
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: small whole numbers, the last being the single smallest."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    small, left = types(t)
    counts = np.bincount(t)
    names = _rank_parts(t, left[:-1], left[1:], None)
    if len(names) and len(np.unique(names)) < len(names):
        reduced = np.append(np.unique(names, return_inverse=True)[1] + 1, 0)
        order = _order_names(reduced)
        seeds = left[order]
    else:
        seeds = np.append(left[-1], left[:-1][np.argsort(names, kind="stable")])
    return _induce(t, small, seeds, counts)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of bytes t, by text position: symbols shared with the suffix before it in the array, up to room (symbols left in each one's string).

    Where both are preceded by one symbol, the value is that of the position before less one; all others are compared
    eight bytes at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    top = int(room.max())
    padded = np.concatenate([t, np.zeros(top + 16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + top + 8, 8), (1, 1))
    before = np.maximum(phi - 1, 0)
    same = (phi > 0) & (np.arange(n) > 0)
    same[1:] &= (t[:-1] == t[before[1:]]) & (room[:-1] > 0) & (room[before[1:]] > 0)
    head = np.flatnonzero(~same & (phi >= 0))
    out = np.zeros(n, np.int64)
    limit = np.minimum(room[head], room[phi[head]])
    shared, todo = np.zeros(len(head), np.int64), np.flatnonzero(limit > 0)
    while len(todo):
        i = head[todo] + shared[todo]
        j = phi[head[todo]] + shared[todo]
        equal = (np.ascontiguousarray(eight[i]) == eight[j]).cumprod(1).sum(1)
        shared[todo] += equal
        todo = todo[(equal == 8) & (shared[todo] < limit[todo])]
    out[head] = np.minimum(shared, limit)
    lead = np.zeros(n, np.int64)
    lead[head] = head
    lead = np.maximum.accumulate(lead)
    return np.maximum(0, np.minimum(out[lead] - (np.arange(n) - lead), np.where(phi >= 0, np.minimum(room, room[phi]), 0)))


def array_solver(strings: list[bytes], counts: list[int], _docs: list[int], length: int) -> list[np.ndarray]:
    """For each string which of its windows of this length stand at two places or more, one in a string counting as often as it."""
    if not strings:
        return []
    lens = np.array([len(s) for s in strings])
    raw = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
    t = raw.astype(np.int64) + 2
    stops = np.cumsum(lens + 1) - 1
    t[stops] = 1
    t[-1] = 0
    room = np.repeat(stops, lens + 1) - np.arange(len(t))
    sa = suffix_array(t)
    lcp = permuted_lcp(raw, sa, room)
    along = lcp[sa] >= length
    group = np.cumsum(~along)
    owner = np.repeat(np.arange(len(lens)), lens + 1)
    total = np.bincount(group, np.array(counts)[owner[sa]] * (room[sa] >= length))
    hit = np.zeros(len(t), bool)
    hit[sa] = (total[group] > 1) & (room[sa] >= length)
    return [hit[e - n : e - n + max(0, n - length + 1)] for e, n in zip(stops.tolist(), lens.tolist(), strict=True)]


def _apply(batches, length):
    for b in pieces(batches, 100):
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for doc_id, raw, found in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            gone = covered(len(raw), found or [], length)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans = edge.reshape(-1, 2).tolist()
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for c, x in (("doc_id", doc_id), ("n_bytes", len(raw)), ("n_removed", int(gone.sum())), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("spans", spans), ("kept", kept)):
                out[c].append(x)
        yield out


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (bytes) for each row of docs (doc_id, text).

    A byte goes if a string of this many bytes that covers it also starts anywhere else. Every copy goes, the first too.
    A null or shorter text loses nothing; kept bytes need not be whole characters. Repeated rows are documents like others,
    so both lose all that is long enough. Other columns are ignored. Contexts are told apart by 64-bit hashes of their gram
    and of the whole, windows of hot grams by 128-bit digests.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.lit(0).cast("long").alias("doc"), "text")
    found = repeated(rows, scratch, Symbols(words=False), length, gram or max(1, length // 2), array_solver, by_document=False)
    joined = rows.select("doc_id", "text", "row").join(found, "row", "left").select("doc_id", "text", "found")
    return map_arrow(joined, _apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary", length)
