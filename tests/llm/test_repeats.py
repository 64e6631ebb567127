"""Suffix arrays, suffix trees and the two dedups that use them, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewright.llm import repeats, subtree, suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60) | st.lists(st.sampled_from([1, 1, 1, 2]), max_size=200))
def test_suffix_array(s):
    t = np.array([*s, 0])
    want = sorted(range(len(t)), key=lambda i: [*s, 0][i:])
    assert suffix.suffix_array(t).tolist() == want == suffix._order_names(t).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30) | st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=6), st.integers(1, 12), st.data())
def test_solvers(strings, length, data):
    counts = [data.draw(st.integers(1, 3)) for _ in strings]
    docs = [data.draw(st.integers(0, 4)) for _ in strings]
    seen, least = Counter(), {}
    for s, c, d in zip(strings, counts, docs, strict=True):
        for i in range(len(s) - length + 1):
            w = s[i : i + length]
            seen[w] += c
            least[w] = min(d, least.get(w, d))
    got = suffix.array_solver(strings, counts, docs, length)
    assert [g.tolist() for g in got] == [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
    as_words = [np.frombuffer(s, np.uint8).astype(np.uint64).tobytes() for s in strings]
    got = subtree.tree_solver(as_words, counts, docs, length)
    assert [g.tolist() for g in got] == [[least[s[i : i + length]] < d for i in range(len(s) - length + 1)] for s, d in zip(strings, docs, strict=True)]


def test_groups_by_prefix(monkeypatch):
    monkeypatch.setattr(subtree, "SUFFIXES", 5)
    monkeypatch.setattr(subtree, "STEP", 2)
    rng = random.Random(0)
    strings = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(12)]
    strings += strings[:3]
    test_solvers.hypothesis.inner_test(strings, 6, type("D", (), {"draw": staticmethod(lambda _: rng.randrange(1, 4))}))


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=12, max_size=300), st.integers(1, 12))
def test_contexts_cover_all_windows_and_follow_content(text, gram):
    values = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    found = [(int(h), i, j) for hs, a, b in repeats.contexts(values, 12, gram) for h, i, j in zip(hs, a, b, strict=True)]
    assert [k for _, i, j in found for k in range(i, j + 1)] == list(range(len(text) - 11))
    of = defaultdict(set)
    for h, i, j in found:
        for k in range(i, j + 1):
            of[text[k : k + 12]].add(h)
    assert all(len(x) == 1 for x in of.values())


def bytes_brute(rows, n):
    seen = Counter(t[i : i + n] for _, t in rows for i in range(len(t) - n + 1))
    out = []
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((str(d), len(t), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def words_brute(rows, n):
    least = {}
    key = lambda d: 2**63 if d is None else d
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(key(d), least.get(k, key(d)))
    out = []
    for d, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < key(d):
                gone[i : i + n] = [True] * n
        out.append((str(d), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = [[word() for _ in range(30)] for _ in range(3)]
    rows = []
    for i in range(90):
        t = [word() for _ in range(rng.randint(0, 60))]
        kind = rng.random()
        if kind < 0.4:
            k = rng.randint(0, len(t))
            t[k:k] = rng.choice(passage)[rng.randint(0, 8) :]
        elif kind < 0.6 and rows:
            t = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
        elif kind < 0.65:
            t = [rng.choice(["a", "ab"])] * rng.randint(1, 80)
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    return rows


ROWS = {"arrays": ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), "trees": ("doc_id", "n_words", "n_removed", "kept_sha256")}


def run(kind, df, length):
    out = (suffix.substring_dedup if kind == "arrays" else subtree.word_dedup)(df, length)
    return sorted((str(r[0]), *r[1:]) for r in out.select(*ROWS[kind]).collect())


def brute(kind, rows, length):
    rows = [(d, (t or "").encode()) for d, t in rows]
    return (bytes_brute if kind == "arrays" else words_brute)(rows, length)


@pytest.mark.parametrize("kind", ROWS)
@pytest.mark.parametrize("group", [256, 1])
def test_dedup(spark, monkeypatch, kind, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SHARD", 200)
    rows = make(group)
    length = 40 if kind == "arrays" else 12
    want = brute(kind, rows, length)
    assert sum(r[2] for r in want) > 500
    assert run(kind, spark.createDataFrame(rows, "doc_id long, text string"), length) == want


@pytest.mark.parametrize("kind", ROWS)
def test_rows(spark, hard, empty, kind):
    length = 400 if kind == "arrays" else 50
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert run(kind, hard, length) == brute(kind, rows, length)
    assert run(kind, hard, 5) == brute(kind, rows, 5)
    assert run(kind, empty, length) == []


@pytest.mark.parametrize("kind", ROWS)
def test_documents_of_the_smallest_table(spark, sf_dir, kind):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    length = 400 if kind == "arrays" else 50
    got = run(kind, docs, length)
    assert got == brute(kind, [(r.doc_id, r.text) for r in docs.collect()], length) and sum(r[2] for r in got)
