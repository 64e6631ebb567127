import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm import mixing, queries, topk


def brute(rows, k, every=50):
    """All products in whole numbers; each row is a candidate for every row but itself."""
    own = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(Fraction(float(x)) * 256) for x in v]))
    out = []
    for at, (q, a) in enumerate(own):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(own) if n != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "copies", "lengths", "huge"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 300)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)) * (1e6 if kind == "huge" else 0.3)
    if kind == "copies":
        base[100:220] = base[7]
    if kind == "lengths":
        base *= np.exp(rng.normal(size=(300, 1)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [1.0, None]), (1050, [float("nan")] * 8), (1051, [float("inf")] * 8), (None, [1.0] * 8), (1100, []), (1150, [0.0] * 8), (50, rows[50][1]), (100, [9.0] * 8), (1200, [-0.5, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, lambda i: i % 50 == 0).collect())
    assert got == brute(rows, 5)


def test_floor_of_tiny_and_huge_components(spark):
    tiny = [(50, [-1e-20, 1.0]), (51, [1.0, 0.5]), (52, [0.5, 0.5]), (100, [-5e-324, 0.0]), (101, [-1e-3, 0.25])]
    edge = [(150, [2.0**45, 0.0]), (151, [-(2.0**45), 1 / 256]), (152, [2.0**45 - 2**-8, -1 / 512]), (153, [1.0, 1.0])]
    for rows in (tiny, edge):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, lambda i: i % 50 == 0).collect())
        limit = 2**63
        assert got == [(q, n, i, max(-limit, min(limit - 1, s))) for q, n, i, s in brute(rows, 5)]


def test_rows_that_share_a_vec_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (3, [1.0, 1.0]), (3, [0.5, 0.0]), (4, [0.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect())
    assert got == brute(rows, 5) and len(got) == 15


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(df, lambda i: i % 50 == 0).collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), lambda i: i % 50 == 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.01, 30))
def test_pruning_keeps_what_reaches_theta(seed, spread):
    rng = np.random.default_rng(seed)
    q = np.floor(rng.normal(size=(4, 5)) * spread * 20)
    v = np.concatenate([np.floor(rng.normal(size=(40, 5)) * 20), q[:2], q[:1] + 1])
    v = v[np.argsort(-(v * v).sum(1), kind="stable")]
    ids, q_ids = np.arange(len(v)), np.arange(1000, 1004)
    s = q @ v.T
    theta = np.sort(s, 1)[:, -3].astype(float)
    got = sorted(zip(*topk.retrieve(q_ids, q, theta, ids, v, 3), strict=True))
    want = sorted((1000 + i, int(j), int(s[i, j])) for i in range(4) for j in sorted(range(len(v)), key=lambda j: (-s[i, j], j))[:3])
    assert got == want


def water(sizes, weights, share=1.5, limit=2):
    """Targets by closing sources until none is above its limit."""
    total, shut = share * sum(sizes), set()
    while True:
        left = total - sum(limit * sizes[i] for i in shut)
        w = sum(x for i, x in enumerate(weights) if i not in shut)
        out = [limit * s if i in shut else (x * left / w if w else 0) for i, (s, x) in enumerate(zip(sizes, weights, strict=True))]
        new = {i for i, t in enumerate(out) if t > limit * sizes[i]} - shut
        if not new:
            return out
        shut |= new


def test_mix(hard, empty):
    rows = hard.collect()
    got = mixing.mix(hard, keep=("kept",)).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, water([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    for s in order:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size[s]} and all(r.target == pytest.approx(want[s]) for r in own)
        assert sum(r.taken for r in own) == int(want[s] + 1e-9)
    assert all(0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.schedule(empty).count() == 0


def test_mix_is_the_same_in_blocks(spark, hard, monkeypatch):
    many = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 11)) as source")
    whole = sorted(mixing.mix(many).collect())
    monkeypatch.setattr(mixing, "BLOCK", 10)
    assert sorted(mixing.mix(many.repartition(9)).collect()) == whole


def test_number_sources(spark):
    names = ["b", "a", "ab", "abc", "abd", "", "é", "z", "漢", "😀", "￿", None]
    got = mixing.number_sources(spark.createDataFrame([(n, 1) for n in names], "source string, size long")).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.place)] == [*sorted(n for n in names if n is not None), None]


def test_schedule(hard):
    got = mixing.schedule(hard)
    assert got.columns == hard.columns
    words = {}
    for r in got.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    mixed = {r.source: r for r in mixing.mix(hard).collect()}
    for s, n in words.items():
        assert abs(n - mixed[s].target) <= 3000 and n <= 2 * mixed[s].source_size


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.5])
def test_due_inverts_the_integral(spark, slope):
    from pyspark.sql import functions as F

    rows = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.due(F.col("u"), F.lit(slope))).collect()
    assert all(abs(r.t + slope * (r.t**2 - r.t) - r.u) < 1e-8 for r in rows)


def test_query_sorts_by_position(spark, sf_dir):
    got = [r.position for r in queries.op8_mixing(spark, sf_dir).collect()]
    assert None in got and len({x for x in got if x is not None}) > 10
    assert got == sorted(got, key=lambda x: (x is None, x or 0))
