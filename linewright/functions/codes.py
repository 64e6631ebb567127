"""Text columns as flat arrays of code points, a batch at a time, and counts of runs over them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct runs that a task holds before it hands its counts on.
HELD = 200_000
#: What keys of runs stay below, in bits.
KEY_BITS = 62


def spread(start: np.ndarray) -> np.ndarray:
    """Of every element, the row it is in; start: where rows begin, the end being last."""
    return np.repeat(np.arange(len(start) - 1), np.diff(start))


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where rows of these sizes begin, the end being last."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of whole numbers or truth values by row."""
    return np.diff(starts(values)[start])


def codes(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, its code points, and where each text begins, the end being last; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = data.slice(at[0], at[-1] - at[0]).to_pybytes().decode() if data is not None else ""
    return whole, np.frombuffer(whole.encode("utf-32-le"), np.uint32), starts(pc.utf8_length(column).to_numpy(zero_copy_only=False))


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def runs(elements: np.ndarray, start: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element the number of the run of up to max_n that begins there; of each run one place and its length.

    Runs end with their row.
    """
    if not len(elements):
        return (np.zeros(0, np.int64),) * 3
    room = np.repeat(start[1:], np.diff(start)) - np.arange(len(elements))
    element, kinds = pd.factorize(elements)
    element, base = element + 1, len(kinds) + 1
    key, bound = element, base
    for n in range(1, max_n):
        ahead = np.zeros_like(element)
        ahead[:-n] = element[n:]
        ahead[room <= n] = 0
        if (bound * base).bit_length() > KEY_BITS:
            key, kinds = pd.factorize(key)
            bound = len(kinds)
        key, bound = key * base + ahead, bound * base
    number, distinct = pd.factorize(key)
    place = np.empty(len(distinct), np.int64)
    place[number[::-1]] = np.arange(len(key))[::-1]
    return number, place, np.minimum(room[place], max_n)


def prefixes(held: Counter) -> Counter:
    """Counts of the runs that held ones begin with, these included; a run is a tuple of texts of like length."""
    out: Counter = Counter()
    for run, times in held.items():
        for n in range(1, len(run[0]) + 1):
            out[tuple(t[:n] for t in run)] += times
    return out


def count_runs(held: Counter, sides: list[np.ndarray], start: np.ndarray, max_n: int) -> None:
    """Adds to held how often each run of up to max_n begins somewhere, sides being read side by side."""
    elements = sides[0].astype(np.int64)
    for side in sides[1:]:
        elements = (elements << 21) | side
    number, place, length = runs(elements, start, max_n)
    texts = [as_text(side) for side in sides]
    for p, n, times in zip(place.tolist(), length.tolist(), np.bincount(number, minlength=len(place)).tolist(), strict=True):
        held[tuple(t[p : p + n] for t in texts)] += times
