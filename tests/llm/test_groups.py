"""Connected groups and near-duplicates against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm import graph, neardup
from linewright.llm.common import Scratch


def union(ids, links):
    """id -> smallest id reachable."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near(rows, size, num, den):
    """(doc_id, n_shingles, component_id) by comparing all."""
    sets = [shingles(t, size) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    group = union(range(len(rows)), links)
    low = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            low[g] = min(rows[i][0], low.get(g, rows[i][0]))
    return sorted((str(rows[i][0]), len(sets[i]), str(low.get(group[i]) if sets[i] else rows[i][0])) for i in group)


@pytest.mark.parametrize("kind", ["star", "path", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {
        "star": [(0, i) for i in range(1, 200)] + [(500, 501)],
        "path": [(i, i + 1) for i in range(120)] + [(300, 299), (299, 300), (7, 7)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(140)],
        "none": [],
    }[kind]
    scratch = Scratch(spark)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    want = union({i for e in edges for i in e if e[0] != e[1]}, edges)
    assert {r.id for r in got} == set(want)
    pairs = {(want[r.id], r.label) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_connect_tries_every_pair_that_can_matter(spark):
    rng = random.Random(2)
    lists = {(v, i) for v in range(6) for i in rng.sample(range(60), 14)}
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.06}
    together = {(i, j) for i, j in links if any((v, i) in lists and (v, j) in lists for v in range(6))}
    good = spark.createDataFrame(sorted(links), "a long, b long")
    verify = lambda pairs: pairs.select(*[f(c) for c, f in ()] or ["a", "b"]).join(good, ["a", "b"])
    groups = graph.connect(spark.createDataFrame(sorted(lists), "v long, id long"), verify, Scratch(spark))
    want = union(range(60), together)
    got = {r.id: r.label for r in groups.collect()}
    for i in range(60):
        for j in range(i):
            assert (want[i] == want[j]) == (i in got and j in got and got[i] == got[j])


def make(seed, n=120):
    """Families of edited texts, chains, short ones, copies and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 or not rows:
            t = [word() for _ in range(rng.choice([1, 2, 4, 30, 90, 200]))]
        elif kind < 0.35:
            t = passage + [word() for _ in range(rng.randint(5, 40))]
        else:
            t = list(rng.choice(rows)[1].split())
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if t:
                    t[rng.randrange(len(t))] = word()
        rows.append((i + 1, rng.choice([" ", "\n", "  "]).join(t).upper() if rng.random() < 0.1 else " ".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size", "num", "den", "k"), [(1, 3, 85, 100, 64), (1, 3, 85, 100, 300), (2, 5, 4, 5, 48), (3, 1, 1, 2, 64)])
def test_near_duplicates(spark, seed, size, num, den, k):
    rows = make(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, num, den, k).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near(rows, size, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_rows(spark, hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = neardup.near_duplicates(hard, 3, 85, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near(rows, 3, 85, 100)
    assert neardup.near_duplicates(empty).count() == 0


def test_documents_of_the_smallest_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = neardup.near_duplicates(docs, 3, 85, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near([(r.doc_id, r.text) for r in docs.collect()], 3, 85, 100)


def test_very_long_texts(spark):
    rng = random.Random(9)
    a = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    b = list(a)
    for i in range(0, len(a), 100):  # three shingles of each hundred go
        b[i] = "x"
    c = [x if i % 20 else "y" for i, x in enumerate(a)]  # three of each twenty
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(a))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_parity_counts_unlike_shingles_at_most():
    rng = random.Random(3)
    for n in (1, 40, 700, 5000):
        a = neardup.np.unique(neardup.np.array([rng.getrandbits(64) for _ in range(n)], neardup._U))
        b = neardup.np.unique(neardup.np.concatenate([a[n // 10 :], neardup.np.array([rng.getrandbits(64) for _ in range(n // 7)], neardup._U)]))
        flipped = sum((int(x) ^ int(y)).bit_count() for x, y in zip(neardup.parity(a).view(neardup._U), neardup.parity(b).view(neardup._U), strict=True))
        assert flipped <= len(neardup.np.setxor1d(a, b))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 99), st.integers(1, 200))
def test_bound_on_sketches(percent, k):
    c = neardup.least_shared(k, percent, 100)
    assert 1 <= c <= max(1, k * percent / 100)
