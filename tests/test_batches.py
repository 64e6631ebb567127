"""What is done to whole batches against the same done pair by pair."""

from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.functions import align, text
from linewright.functions.text import GAP

TEXTS = st.text(alphabet="abäoöͤ e\U0001f600", max_size=14)
TRIPLES = st.lists(st.tuples(TEXTS, TEXTS, TEXTS) | TEXTS.map(lambda s: (s, s, s)) | st.tuples(TEXTS, st.none(), TEXTS), max_size=8)


def columns(rows):
    return [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]


@settings(max_examples=600, deadline=None)
@given(TRIPLES)
def test_alignment_of_batches(rows):
    a, b, c = columns(rows)
    whole = [None if None in r[:2] else align.align(*r[:2]) for r in rows]
    assert [None if x is None else [(p["l"], p["r"]) for p in x] for x in align._align(a, b).to_pylist()] == whole
    assert align._distance(a, b).to_pylist() == [None if None in r[:2] else align.adjusted_distance(*r[:2]) for r in rows]
    assert [tuple(x.values()) for x in align._outcomes(a, b, c).to_pylist()] == [(0, 0, 0, 0) if None in r else align.edit_outcomes(*r) for r in rows]


@settings(max_examples=200, deadline=None)
@given(TRIPLES)
def test_confusions_of_batches(rows):
    want: Counter = Counter()
    for a, b, _ in rows:
        pairs = align.align(a or "", b or "")
        left, right = ("".join(p[side] or GAP for p in pairs) for side in (0, 1))
        want.update((n, left[i : i + n], right[i : i + n]) for n in range(1, 4) for i in range(len(pairs) - n + 1))
    got: Counter = Counter()
    for out in align.counted([pa.record_batch(columns(rows), ["ocr", "gt", "x"])] * 2, align._aligned, 3):
        for *key, cnt in zip(*(out[k] for k in ("n", "raw", "gt", "cnt")), strict=True):
            got[tuple(key)] += cnt
    assert got == {k: 2 * v for k, v in want.items()}


def test_long_pairs_are_aligned_fast():
    """Two texts of 14,000 characters took difflib over 20 seconds."""
    import random
    import time

    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh ") for _ in range(14_000))
    b = "".join(rng.choice("xyz") if rng.random() < 0.02 else x for x in a)
    began = time.time()
    left, right, _ = align.align_batch(pa.array([a]), pa.array([b]))
    assert time.time() - began < 10
    assert ["".join(chr(c) for c in side if c != align.NONE) for side in (left, right)] == [a, b]


@settings(max_examples=200, deadline=None)
@given(TRIPLES, st.booleans())
def test_ratios_of_batches(rows, dense):
    from difflib import SequenceMatcher

    text.DENSE = 1 << 22 if dense else 0
    a, b, _ = columns(rows)
    assert text._ratios(a, b).to_pylist() == [None if None in r[:2] else SequenceMatcher(None, *r[:2], autojunk=False).quick_ratio() for r in rows]
    text.DENSE = 1 << 22


def test_runs_of_many_kinds():
    """Keys of runs that would not fit in 62 bits are made small again on the way."""
    import numpy as np

    from linewright.functions import codes

    texts = ["".join(chr(0x4E00 + (7 * i * i + j) % 2000) for j in range(i)) for i in range(60)] * 2
    held: Counter = Counter()
    _, points, start = codes.codes(pa.array(texts))
    codes.count_runs(held, [points], start, 9)
    assert codes.prefixes(held) == Counter((t[i : i + n],) for t in texts for n in range(1, 10) for i in range(len(t) - n + 1))
    assert codes.runs(np.zeros(0, np.int64), np.zeros(1, np.int64), 3)[0].size == 0


def test_counts_hold_one_row_per_text(spark):
    """Places are not exploded, so nothing but texts and sums goes from task to task."""
    from linewright.operators import errors, ngrams

    rows = spark.createDataFrame([("a", "tbe", "the"), ("b", "", "x"), ("c", "ab", "abc"), ("c", None, "y"), ("a", "tbe", "the")], "line_id string, ocr string, gt string")
    counts, places = ngrams.count(rows, ["ocr", "gt"], 2), errors.positional_confusions(rows, 2)
    vocab = spark.createDataFrame([("t", 0), ("b", 1), ("tb", 2)], "ngram string, id int")
    sums = ngrams.id_sums(rows, "ocr", vocab, 2, "line_id")
    assert not any("Generate" in df._jdf.queryExecution().executedPlan().toString() for df in (counts, places))
    assert {r.ngram: r.cnt for r in counts.collect()} == {"t": 4, "b": 4, "e": 4, "h": 2, "a": 2, "c": 1, "x": 1, "y": 1, "tb": 2, "be": 2, "th": 2, "he": 2, "ab": 2, "bc": 1}
    assert {(r.raw, r.gt): r.cnt for r in places.collect()} == {("t", "t"): 2, ("b", "h"): 2, ("e", "e"): 2, ("tb", "th"): 2, ("be", "he"): 2, ("a", "a"): 1, ("b", "b"): 1, (GAP, "c"): 1, ("ab", "ab"): 1, ("b" + GAP, "bc"): 1}
    ids = ngrams.ids(rows, "ocr", vocab, 2, "line_id").groupBy("line_id", "n").agg({"id": "count"})
    assert {(r.line_id, r.n) for r in ids.collect()} == {(r.line_id, r.n) for r in sums.collect()}
    assert {(r.line_id, r.n): (r.known, r.id_sum) for r in sums.collect()}["a", 1] == (4, 2 * (0 + 2 * 1 - 3)) and ("b", 1) not in {(r.line_id, r.n) for r in sums.collect()}


def test_ties_do_not_hang_on_the_order_of_sums(spark):
    """63281.25 is what "éou. Du éément." has; its entropy, summed in another order, gave 6.32812e+04."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(63281.25000000008,), (63281.2499999999,), (63281.2,)], "x double")
    assert [r.s for r in rows.select(text.scientific(F.col("x")).alias("s")).collect()] == ["6.32813e+04", "6.32813e+04", "6.32812e+04"]


def test_regions_come_together_once(spark):
    from linewright.operators import page

    rows = spark.createDataFrame([(1, 0, 1, 1, 0, "d"), (1, 0, 0, 0, 1, "b"), (1, 0, 0, 0, 0, "a"), (1, 0, 0, 1, 0, None), (1, 0, 1, 0, 0, "c"), (1, 1, 2, 0, 0, ""), (2, 0, 0, 0, 0, "x")], "page_id int, region int, line int, word int, glyph int, text string")
    found = page.roll_up(rows, "glyph")
    assert {(r.page_id, r.region): r.text for r in found.collect()} == {(1, 0): "ab \nc d", (1, 1): "", (2, 0): "x"}
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1
