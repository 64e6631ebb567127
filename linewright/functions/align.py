"""Alignment of two versions of a line by longest common blocks, and measures that walk along it.

Catalyst has no operator for this, so these run in Python: over the flat code points of Arrow batches, all lines of a batch at
once, equal lines taking a short way. align, adjusted_distance and edit_outcomes say the same of a single pair.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions.codes import HELD, codes, count_runs, prefixes, spread, starts, sums
from linewright.functions.text import COMBINING_E, GAP
from linewright.functions.workers import map_batches, reach_workers

# Fixed value: letters that count as one with a base letter and a combining e.
PLAIN = {"ä": "a", "ö": "o", "ü": "u"}
#: Places of the matrix that rectangles of one chunk have side by side.
CELLS = 1 << 16
#: Longer ones go one by one, as a few side by side take longer than one after another.
LONG = 1 << 11
NONE = -1

Pairs = list[tuple[str | None, str | None]]


def align(a: str, b: str) -> Pairs:
    """Pairs of characters, None for a gap; unlike stretches pair from their left, the longer one's rest facing gaps."""
    if a == b:
        return list(zip(a, b, strict=True))
    out: Pairs = []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        left, right = a[i:j], b[k:m]
        if kind != "equal":
            width = max(len(left), len(right))
            left, right = [*left, *[None] * (width - len(left))], [*right, *[None] * (width - len(right))]
        out.extend(zip(left, right, strict=True))
    return out


def adjusted_distance(a: str, b: str) -> int:
    """Edits between a and b, where an umlaut against base letter and combining e is one edit and not two."""
    cost, open_side = 0, None
    for x, y in align(a, b):
        if open_side is not None:
            mark, other = (y, x) if open_side == "a" else (x, y)
            cost += 1 if x == y or (other is None and mark == COMBINING_E) else 2
            open_side = None
        elif x != y:
            if x in PLAIN and PLAIN[x] == y:
                open_side = "a"
            elif y in PLAIN and PLAIN[y] == x:
                open_side = "b"
            else:
                cost += 1
    return cost + (open_side is not None)


def edit_outcomes(ocr: str, cor: str, truth: str) -> tuple[int, int, int, int]:
    """True positives, true negatives, false positives, false negatives of the edits from ocr to cor.

    Both are aligned with truth and walked along it together, until either ends. A character of ocr that truth lacks counts
    as a right deletion, one of cor as a wrong insertion.
    """
    first, second = align(ocr, truth), align(cor, truth)
    right_change = right_same = wrong_change = wrong_same = i = j = 0
    while i < len(first) and j < len(second):
        (was, t), (now, u) = first[i], second[j]
        if t is None:
            right_change, i = right_change + 1, i + 1
            continue
        if u is None:
            wrong_change, j = wrong_change + 1, j + 1
            continue
        if now == u:
            right_change, right_same = right_change + (now != was), right_same + (now == was)
        else:
            wrong_change, wrong_same = wrong_change + (now != was), wrong_same + (now == was)
        i, j = i + 1, j + 1
    return right_change, right_same, wrong_change, wrong_same


def _longest(a: np.ndarray, b: np.ndarray, at: np.ndarray, high: np.ndarray, to: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and end in a, from at, of the longest common run of a[at : at + high] and b[to : to + wide] for like rectangles.

    Of equally long ones it is the first in a. a and b are numbers from 1 on.
    """
    rows, cols, n = int(high.max()), int(wide.max()), len(at)
    pick = lambda x, first, size, k, none: np.where(np.arange(k)[:, None] < size, x[np.minimum(first + np.arange(k)[:, None], len(x) - 1)], none).astype(x.dtype)
    x, y = pick(a, at, high, rows, 0), pick(b, to, wide, cols, np.iinfo(b.dtype).max)
    room = min(rows, cols)
    kind = np.uint8 if room < 255 else np.uint16 if room < 65535 else np.uint32
    before, now, equal = np.zeros((cols + 1, n), kind), np.zeros((cols + 1, n), kind), np.empty((cols, n), bool)
    size, end = np.zeros(n, kind), np.zeros(n, np.int64)
    for i in range(rows):
        np.equal(y, x[i], out=equal)
        np.add(before[:-1], kind(1), out=now[1:])
        np.multiply(now[1:], equal, out=now[1:])
        most = now.max(0)
        np.copyto(end, i + 1, where=most > size)
        np.maximum(size, most, out=size)
        before, now = now, before
    return size.astype(np.int64), end


def _blocks(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in a, place in b and size of the blocks that SequenceMatcher would match, in order, and an empty one at each row's end."""
    (_, a_codes, a_start), (text, b_codes, b_start) = a, b
    rows = np.arange(len(a_start) - 1)
    both, kinds = pd.factorize(np.concatenate([a_codes, b_codes]))
    both = (both + 1).astype(np.uint8 if len(kinds) < 254 else np.uint32)
    x, y = both[: len(a_codes)], both[len(a_codes) :]
    a_len, b_len = np.diff(a_start), np.diff(b_start)
    like = a_len == b_len
    of = spread(a_start)
    mine = np.flatnonzero(like[of])
    other = mine - a_start[of[mine]] + b_start[of[mine]]
    like &= np.bincount(of[mine], x[mine] != y[other], len(rows)) == 0
    found = [(rows[like], a_start[:-1][like], b_start[:-1][like], a_len[like]), (rows, a_start[1:], b_start[1:], np.zeros(len(rows), np.int64))]
    row, at, high, to, wide = (v[~like] for v in (rows, a_start[:-1], a_len, b_start[:-1], b_len))
    while len(row):
        keep = (high > 0) & (wide > 0)
        row, at, high, to, wide = (v[keep] for v in (row, at, high, to, wide))
        order = np.lexsort((wide, high))
        row, at, high, to, wide = (v[order] for v in (row, at, high, to, wide))
        size, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        i = 0
        while i < len(row):
            most = max(int(high[i]), int(wide[i]))
            j = i + (CELLS // most if most <= LONG else 1)
            size[i:j], end[i:j] = _longest(x, y, at[i:j], high[i:j], to[i:j], wide[i:j])
            i = j
        keep = size > 0
        row, at, high, to, wide, size, end = (v[keep] for v in (row, at, high, to, wide, size, end))
        i = at + end - size
        j = np.array([text.find(a[0][p : p + n], q, r) for p, n, q, r in zip(i.tolist(), size.tolist(), to.tolist(), (to + wide).tolist(), strict=True)], np.int64)
        found.append((row, i, j, size))
        row, high, wide = np.tile(row, 2), np.concatenate([i - at, at + high - i - size]), np.concatenate([j - to, to + wide - j - size])
        at, to = np.concatenate([at, i + size]), np.concatenate([to, j + size])
    row, i, j, size = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((size == 0, i, row))
    return row[order], i[order], j[order], size[order]


def align_batch(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of all pairs as align has them, one after another, NONE for a gap, and where each pair begins; null is empty."""
    first, second = codes(a), codes(b)
    row, i, j, size = _blocks(first, second)
    opens = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    behind = lambda place, begin: np.where(opens, begin[row], np.concatenate([[0], (place + size)[:-1]])) if len(row) else place
    gaps = [i - behind(i, first[2]), j - behind(j, second[2])]
    widths = np.stack([np.maximum(*gaps), size], 1).ravel()
    begin = starts(widths)
    sides = []
    for (_, points, _), gap in zip((first, second), gaps, strict=True):
        own = np.stack([gap, size], 1).ravel()
        side = np.full(begin[-1], NONE, np.int64)
        side[np.arange(len(points)) + np.repeat(begin[:-1] - starts(own)[:-1], own)] = points
        sides.append(side)
    return *sides, np.append(begin[:-1][0::2][opens], begin[-1])


def _nulls(*columns: pa.Array) -> np.ndarray:
    return np.logical_or.reduce([pc.is_null(c).to_numpy(zero_copy_only=False) for c in columns])


def _letters(side: np.ndarray) -> pa.Array:
    """One text per element, null for NONE."""
    kinds, which = np.unique(side, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(which.ravel(), pa.int32()), pa.array([None if k == NONE else chr(k) for k in kinds.tolist()], pa.string())).cast(pa.string())


def _align(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right, start = align_batch(a, b)
    pairs = pa.StructArray.from_arrays([_letters(left), _letters(right)], ["l", "r"])
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pairs, mask=pa.array(_nulls(a, b)))


def _distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """adjusted_distance of all pairs."""
    left, right, start = align_batch(a, b)
    cost = (left != right).astype(np.int64)
    plain = lambda x, y: np.logical_or.reduce([(x == ord(k)) & (y == ord(v)) for k, v in PLAIN.items()])
    by_left, by_right = plain(left, right), plain(right, left)
    opens = by_left | by_right
    if opens.any():
        # the place after one that opens is settled with it and opens nothing, so of a stretch of such places every other one does
        place, row = np.arange(len(opens)), spread(start)
        first = opens & ~(np.concatenate([[False], opens[:-1]]) & np.concatenate([[False], row[1:] == row[:-1]]))
        opens &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
        at = np.flatnonzero(opens)
        cost[at] = 0
        last = at + 1 == start[row[at] + 1]
        cost[at[last]] = 1
        at = at[~last]
        mark, other = np.where(by_left[at], right[at + 1], left[at + 1]), np.where(by_left[at], left[at + 1], right[at + 1])
        cost[at + 1] = np.where((mark == other) | ((other == NONE) & (mark == ord(COMBINING_E))), 1, 2)
    return sums(cost, start)


def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_distances(a, b), pa.int64(), mask=_nulls(a, b))


def _opposite(version: pa.Array, truth: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What faces each character of truth, and of each row the characters that face none: before truth's last, and behind it."""
    side, facing, start = align_batch(version, truth)
    there, row = facing != NONE, spread(start)
    reached = np.full(len(start) - 1, -1, np.int64)
    reached[row[there]] = np.flatnonzero(there)
    behind = ~there & (np.arange(len(there)) > reached[row])
    return side[there], sums(~there & ~behind, start), sums(behind, start)


def _outcomes(ocr: pa.Array, cor: pa.Array, truth: pa.Array) -> pa.Array:
    null = pa.array(_nulls(ocr, cor, truth))
    ocr, cor, truth = (pc.if_else(null, "", c) for c in (ocr, cor, truth))
    _, points, start = codes(truth)
    was, deleted, behind = _opposite(ocr, truth)
    now, inserted, rest = _opposite(cor, truth)
    right, changed = now == points, now != was
    tp = sums(right & changed, start) + deleted + np.where(rest > 0, behind, 0)
    fp = sums(~right & changed, start) + inserted
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (tp, sums(right & ~changed, start), fp, sums(~right & ~changed, start))], ["tp", "tn", "fp", "fn"])


def with_alignment(df: DataFrame, a: str, b: str, out: str = "alignment") -> DataFrame:
    """df with out, an array of (l, r), null for a gap; null if either text is."""
    reach_workers(df.sparkSession)
    return df.withColumn(out, F.arrow_udf(_align, "array<struct<l:string,r:string>>")(a, b))


def with_adjusted_distance(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    reach_workers(df.sparkSession)
    return df.withColumn(out, F.arrow_udf(_distance, "long")(a, b))


def with_outcomes(df: DataFrame, ocr: str, cor: str, truth: str) -> DataFrame:
    """df with the longs tp, tn, fp, fn; all 0 if any text is null."""
    reach_workers(df.sparkSession)
    return df.withColumn("_outcomes", F.arrow_udf(_outcomes, "struct<tp:long,tn:long,fp:long,fn:long>")(ocr, cor, truth)).select(*df.columns, "_outcomes.*")


def counted(batches, count, *args):
    """Rows n, raw, gt, cnt of what count(held, batch, *args) counts, handed on whenever much is held."""
    held: Counter = Counter()

    def rows():
        pairs, counts = zip(*prefixes(held).items(), strict=True)
        raw, truth = zip(*pairs, strict=True)
        return {"n": [len(r) for r in raw], "raw": raw, "gt": truth, "cnt": counts}

    for b in batches:
        count(held, b, *args)
        if len(held) > HELD:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _aligned(held: Counter, batch: pa.RecordBatch, max_n: int) -> None:
    *sides, start = align_batch(batch.column(0), batch.column(1))
    count_runs(held, [np.where(side == NONE, ord(GAP), side) for side in sides], start, max_n)


def count_confusions(pairs: DataFrame, max_n: int) -> DataFrame:
    """n, raw, gt, cnt: aligned n-grams of pairs (ocr, gt), each task handing on sums."""
    return map_batches(pairs.select("ocr", "gt"), counted, "n int, raw string, gt string, cnt long", _aligned, max_n).groupBy("n", "raw", "gt").agg(F.sum("cnt").alias("cnt"))
