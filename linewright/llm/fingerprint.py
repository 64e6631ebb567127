"""Document fingerprints: invertible Bloom lookup tables of hashed paragraphs.

A text is its words in paragraphs: a paragraph ends at a line's end, and within a line after each word whose hash says so
(one in eight), so that an edit moves no other boundary. Equal paragraphs of a text are told apart by their number. A table
has cells of (count, xor of digests, xor of checks); each digest goes to three cells. The table of one version less that of
another holds only what differs, and peeling cells with a single digest lists it. If that gets stuck, both versions are
tabled again with four times the cells. Likeness is 2 * shared / (all of one + all of the other).
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, map_arrow, texts

CELLS, HASHES, GROW = 18, 3, 4
RUN = 128
_U = np.uint64
_MARK = b" \x00 "
_ODD = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible order."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Hashes of words, kept for a bounded number of them."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        m = max(1024, 2 * n)
        _POWERS = np.concatenate([np.ones(1, _U), np.full(m - 1, _U(0xD1342543DE82EF95))]).cumprod(dtype=_U)
    return _POWERS[:n]


def paragraphs(raw: bytes, words: Words) -> np.ndarray:
    """Digests of a text's paragraphs, distinct within the text."""
    h = words.of(raw.replace(b"\n", _MARK).split())
    if not len(h):
        return h
    mark = _U(xxhash.xxh3_64_intdigest(b"\x00"))
    ends = np.flatnonzero((h == mark) | ((h >> _U(59)) < _U(4)))
    ends = np.append(ends, len(h) - 1) if not len(ends) or ends[-1] != len(h) - 1 else ends
    starts = np.concatenate([[0], ends[:-1] + 1])
    # sum of word * power of its place in the paragraph
    place = np.arange(len(h)) - np.repeat(starts, ends - starts + 1)
    sums = np.add.reduceat(np.where(h == mark, _U(0), mix(h ^ _ODD) * _powers(int(place.max()) + 1)[place]), starts)
    sums = mix(sums[sums != 0])
    if not len(sums):
        return sums
    order = np.argsort(sums, kind="stable")
    s = sums[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return mix(s + nth.astype(_U) * _ODD)


def _cells(d: np.ndarray, salt: int, m: np.ndarray) -> np.ndarray:
    """Three different cells of each digest, one in each third of its table of m cells."""
    third = (m // HASHES).astype(_U)
    return np.stack([(mix(d + _U((salt * HASHES + k + 1) * int(_ODD) % 2**64)) % third + _U(k) * third).astype(np.int64) for k in range(HASHES)], 1)


def _fill(doc: np.ndarray, d: np.ndarray, sign: np.ndarray, m: np.ndarray, salt: int):
    """Tables of all documents of a run, one after another; m: cells of each document."""
    at = np.concatenate([[0], np.cumsum(m)])
    cell = (_cells(d, salt, m[doc]) + at[doc][:, None]).ravel()
    count = np.bincount(cell, np.repeat(sign, HASHES), at[-1]).astype(np.int64)
    key, check = np.zeros(at[-1], _U), np.zeros(at[-1], _U)
    np.bitwise_xor.at(key, cell, np.repeat(d, HASHES))
    np.bitwise_xor.at(check, cell, np.repeat(mix(d ^ _U(0x5851F42D4C957F2D)), HASHES))
    return at, count, key, check


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of versions the number of digests only in one of them, and whether peeling was complete, at any size."""
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    diff, todo, salt = np.full(n, -1, np.int64), np.arange(n), 0
    m = np.full(n, CELLS)
    while len(todo):
        doc = np.repeat(np.concatenate([np.arange(len(todo))] * 2), np.concatenate([la[todo], lb[todo]]))
        d = np.concatenate([a[i] for i in todo] + [b[i] for i in todo] + [np.zeros(0, _U)])
        sign = np.repeat([1, -1], [la[todo].sum(), lb[todo].sum()])
        at, count, key, check = _fill(doc, d, sign, m[todo], salt)
        owner = np.repeat(np.arange(len(todo)), m[todo])
        peeled = np.zeros(len(todo), np.int64)
        look = np.arange(len(count))
        while len(look):
            pure = look[(abs(count[look]) == 1)]
            pure = pure[check[pure] == mix(key[pure] ^ _U(0x5851F42D4C957F2D))]
            if not len(pure):
                break
            pair = np.stack([owner[pure].astype(_U), key[pure]], 1)
            _, first = np.unique(pair, axis=0, return_index=True) if len(pure) > 1 else (0, [0])
            pure = pure[first]
            o, k, s = owner[pure], key[pure], count[pure].copy()
            peeled += np.bincount(o, minlength=len(todo))
            cell = (_cells(k, salt, m[todo][o]) + at[o][:, None]).ravel()
            np.subtract.at(count, cell, np.repeat(s, HASHES))
            np.bitwise_xor.at(key, cell, np.repeat(k, HASHES))
            np.bitwise_xor.at(check, cell, np.repeat(mix(k ^ _U(0x5851F42D4C957F2D)), HASHES))
            look = np.unique(cell)
        left = np.bincount(owner[(count != 0) | (key != 0)], minlength=len(todo)) > 0
        good = ~left & (peeled <= la[todo] + lb[todo])
        diff[todo[good]] = peeled[good]
        todo = todo[~good]
        m[todo] *= GROW
        salt += 1
    return diff


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return np.where(both == 0, 1.0, (both - differing(a, b)) / np.maximum(both, 1))


def serialize(sets: list[np.ndarray]) -> list[str]:
    """Hex of the number of paragraphs and the smallest table: count, digest, check of each cell."""
    n = len(sets)
    if not n:
        return []
    lens = np.array([len(s) for s in sets])
    _, count, key, check = _fill(np.repeat(np.arange(n), lens), np.concatenate([*sets, np.zeros(0, _U)]), np.ones(lens.sum(), np.int64), np.full(n, CELLS), 0)
    rows = np.concatenate([np.stack([lens, lens], 1).astype("<u4").view(np.uint8)[:, :4]] + [x.reshape(n, CELLS).astype(t).view(np.uint8).reshape(n, -1) for x, t in ((count, "<u4"), (key, "<u8"), (check & _U(0xFFFF), "<u2"))], 1)
    return [r.tobytes().hex() for r in rows]


def _edit(this: str, following: str) -> str:
    k = len(this) // 3
    return this[: len(this) - k] + following[:k] if k else this


def _pairs(batches):
    """Yields runs of (doc_id, text, next text); the rows come in order, a bucket's last row only closes it."""
    run, last = [], None
    for b in batches:
        for bucket, doc_id, text, closes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if last and last[0] == bucket and not last[3]:
                run.append((last[1], last[2], text))
                if len(run) >= RUN:
                    yield run
                    run = []
            if not (closes and last and last[0] == bucket and last[3]):
                last = (bucket, doc_id, text, closes)
    if run:
        yield run


def _compare(batches):
    words = Words()
    for run in _pairs(batches):
        own = [t for _, t, _ in run]
        edited = [_edit(t, n) for _, t, n in run]
        a, e = ([paragraphs(t.encode(), words) for t in x] for x in (own, edited))
        following = [a[i + 1] if i + 1 < len(run) and run[i + 1][1] is n else paragraphs(n.encode(), words) for i, (_, _, n) in enumerate(run)]
        yield {
            "doc_id": [i for i, _, _ in run], "n_chars": [len(t) for t in own], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": serialize(a), "edited_fingerprint": serialize(e), "near_edited": likeness(a, e), "near_next": likeness(a, following),
        }


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text) and of its edited text, and their likenesses.

    The next document is that of the next smaller doc_id, and after the last the first; rows of one doc_id follow each other
    by text, null ids come last, a null text is empty. A document alone is its own next. Two texts without words are alike
    (1.0). Rows are dealt to buckets of doc_id, whose number follows the shuffle's; the first row of a bucket also closes
    the one before, so a task reads its own bucket once and in order. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select("doc_id", "text")
    ids = rows.select("doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    # buckets count from the largest ids; n + 1 holds the null ids
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1))
    bucket = bucket.otherwise(F.lit(len(cuts)) - _rank(F.col("doc_id"), cuts)).cast("int")
    heads = {r.bucket: r.head for r in ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # a row per bucket
    if not heads:
        return map_arrow(rows.select(F.lit(0).alias("b"), "doc_id", "text", F.lit(False).alias("c")), _compare, OUT)
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    of = lambda values, kind: F.element_at(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(order[-1] + 1)]), F.col("bucket") + 1)
    own, closing = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("closes")), F.struct(of(before, "int").alias("bucket"), F.lit(True).alias("closes"))
    placed = rows.withColumn("bucket", bucket)
    placed = placed.withColumn("b", F.explode(F.when(F.col("doc_id").eqNullSafe(of(heads, "long")), F.array(own, closing)).otherwise(F.array(own))))
    dealt = placed.select(F.col("b.bucket").alias("bucket"), "doc_id", "text", F.col("b.closes").alias("closes"))
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("closes"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return map_arrow(dealt, _compare, OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rank(x, cuts: list[int]):
    """How many of the sorted cuts are at most x: first which run of cuts, then how many in it."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    upto = lambda values: F.size(F.filter(values, lambda c: c <= x))
    longs = lambda values: F.array(*[F.lit(c).cast("long") for c in values])
    run = upto(longs(r[0] for r in runs))
    return F.when(run == 0, 0).otherwise((run - 1) * step + upto(F.element_at(F.array(*[longs(r) for r in runs]), F.greatest(run, F.lit(1)))))
