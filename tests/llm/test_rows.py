"""Operators that look at one document, or a document and its neighbour: BPE, token counts, quality, fingerprints."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from linewright.llm import bpe, fingerprint, quality, queries, tokencount

RAW = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
BPE = bpe.Bpe.of(RAW, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})
PIECES = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
COUNTER = tokencount.Counter(PIECES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abein rst's\n\t ?!12"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_bpe_is_tiktokens(texts):
    got = BPE.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    assert [BPE.decode(x).decode() for x in got] == texts


@pytest.mark.parametrize("text", ["ab" * 4000, "q" * 20_001, " " * 3000, "the" * 171])
def test_bpe_long_pieces(text):
    assert np.frombuffer(BPE.encode_batch([text])[0], "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


def test_bpe_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    b = bpe.Bpe({base64.b64decode(a): int(x) for a, x in map(bytes.split, RAW.splitlines())}, public_tokenizers.PATTERN)
    for t in ("one two three four five", "two six", "one seven eight nine two"):
        assert np.frombuffer(b.encode_batch([t])[0], "<u4").tolist() == TIKTOKEN.encode_ordinary(t)


def test_bpe_rows(hard, empty):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    for r in zip(hard.collect(), bpe.encode(hard, *args).collect(), strict=True):
        text = r[0].text or ""
        ids = TIKTOKEN.encode_ordinary(text)
        assert (r[1].doc_id, r[1].n_tokens, r[1].ids, r[1].decoded) == (r[0].doc_id, len(ids), ids, text)
        assert r[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(empty, *args).count() == 0


def test_vocabulary_has_a_bound(tmp_path, monkeypatch):
    (tmp_path / "v").write_bytes(b"x" * 100)
    monkeypatch.setattr(bpe, "MAX_VOCABULARY", 99)
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(tmp_path / "v"))


UNIGRAM = Tokenizer(models.Unigram([("<unk>", 0.0), *PIECES], unk_id=0, byte_fallback=False))
UNIGRAM.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.SPACE, prepend_scheme="always", split=True)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abein rst's\n ▁▁?!12ꙮꙮ"), st.characters(exclude_categories=["Cs"]))))
def test_counts_are_the_tokenizers(text):
    want = UNIGRAM.encode(text, add_special_tokens=False).ids
    assert COUNTER.text(text) == (len(want), want.count(0))


def test_count_ties_keep_the_earliest_start():
    own = [("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁a", -2.0)]
    tk = Tokenizer(models.Unigram([("<unk>", 0.0), *own], unk_id=0))
    tk.pre_tokenizer = UNIGRAM.pre_tokenizer
    c = tokencount.Counter(own)
    for n in range(1, 12):
        for text in ("a" * n, "a" * n + "?", "?a" * n, "? ?" * n):
            assert c.text(text)[0] == len(tk.encode(text, add_special_tokens=False).ids), text


def test_count_rows(hard, empty):
    got = tokencount.token_counts(hard, PIECES).collect()
    assert [(r.doc_id, r.n_chars) for r in got] == [(r.doc_id, len(r.text or "")) for r in hard.collect()]
    assert [r.n_tokens for r in got] == [len(UNIGRAM.encode(r.text or "", add_special_tokens=False).ids) for r in hard.collect()]
    assert tokencount.token_counts(empty, PIECES).count() == 0


def test_quality_held_out(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    got = {r.doc_id: r for r in queries.op10_quality(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert len(held) > 500
    for c in (0, 1):
        own = [p == y for p, y in held if y == c]
        print(c, len(own), sum(own) / len(own))
        assert sum(own) / len(own) > 0.95


def test_quality_rows(spark, hard, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 11)] + [(None, 1, 1), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, x int")
    for some in (labels, labels.limit(0)):
        got = quality.classify(hard, some).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in hard.collect())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in got} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = {c: rng.normal(c, 1 + c, (400, 3)) @ rng.normal(size=(3, 3)) for c in (0, 1)}
    sums = {c: np.concatenate([[400], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()}
    model = quality.Discriminant(sums, 3)
    pooled = (np.cov(x[0].T, bias=True) + np.cov(x[1].T, bias=True)) / 2
    scale = np.sqrt(np.diag(pooled))
    point, log = x[1][:50], []
    for c in (0, 1):
        cov = (0.8 * np.cov(x[c].T, bias=True) + 0.2 * pooled) / scale / scale[:, None]
        cov = 0.98 * cov + 0.02 * np.trace(cov) / 3 * np.eye(3)
        z = (point - x[c].mean(0)) / scale
        log.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])))


def _sets(*texts):
    words = fingerprint.Words()
    return [fingerprint.paragraphs(t.encode(), words) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300))), max_size=8))
def test_peeling_finds_the_difference(pairs):
    as_digests = lambda s: fingerprint.mix(np.array(sorted(s), np.uint64))
    a, b = [as_digests(x) for x, _ in pairs], [as_digests(y) for _, y in pairs]
    assert fingerprint.differing(a, b).tolist() == [len(x ^ y) for x, y in pairs]


def test_fingerprints_against_brute_force(spark, sf_dir):
    for rows in (spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1)):
        docs = sorted(((r.doc_id, r.text) for r in rows.collect()), reverse=True)
        got = {r.doc_id: r for r in fingerprint.fingerprints(rows).collect()}
        assert len(got) == len(docs)
        for n, (i, text) in enumerate(docs):
            following = docs[(n + 1) % len(docs)][1]
            k = len(text) // 3
            edited = text[: len(text) - k] + following[:k]
            a, e, f = _sets(text, edited, following)
            share = lambda x, y: 1.0 if not len(x) + len(y) else 2 * len({*x.tolist()} & {*y.tolist()}) / (len(x) + len(y))
            assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert (got[i].near_edited, got[i].near_next) == (pytest.approx(share(a, e)), pytest.approx(share(a, f)))
            assert got[i].fingerprint == fingerprint.serialize([a])[0] and got[i].edited_fingerprint == fingerprint.serialize([e])[0]


def test_fingerprint_rows(hard, empty):
    got = fingerprint.fingerprints(hard).collect()
    key = lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or "")
    rows = sorted(hard.collect(), key=key)
    want = []
    for n, r in enumerate(rows):
        t, f = r.text or "", rows[(n + 1) % len(rows)].text or ""
        want.append((str(r.doc_id), len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 1
    assert fingerprint.fingerprints(empty).count() == 0
