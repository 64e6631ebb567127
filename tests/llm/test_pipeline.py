"""The corpus pipeline, stage by stage, against brute force on the smallest table and on rows that are hard to bear."""

import hashlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest

from linewright.llm import neardup, quality
from tests.llm.test_groups import near, shingles, union
from tests.llm.test_lines import brute as lines_brute
from tests.llm.test_lines import normal
from tests.llm.test_rows import TIKTOKEN

STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(r):
    return str(r.doc_id), r.text


def test_quality(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels, pipeline.QUALITY).where("predicted = 1").collect()}
    out = STAGE["quality classifier"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in good)
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean & good) >= 0.9 * len(clean & {r.doc_id for r in docs.collect()}) and len(good) < docs.count()


def test_lines(spark, sf_dir, docs):
    some = [r for r in docs.collect() if r.text is not None and len(r.text) < 800][:60]
    df = spark.createDataFrame(some, docs.schema)
    gone, _ = lines_brute(spark, [(r.doc_id, r.text) for r in some])
    want = {}
    for i, r in enumerate(some):
        left = "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone[i])
        if normal(left) or not gone[i]:
            want[r.doc_id] = left
    out = STAGE["line dedup"](spark, df, sf_dir)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_near_duplicates(spark, sf_dir, docs):
    rows = docs.collect()
    first = {i: c for i, _, c in near([(r.doc_id, r.text) for r in rows], 5, 4, 5)}
    out = STAGE["MinHash near-dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in rows if first[str(r.doc_id)] == str(r.doc_id))


def test_one_of_each_group_stays(spark, hard, empty):
    rows, out = hard.collect(), neardup.representatives(hard)
    assert out.columns == hard.columns
    sets = [shingles(r.text, 5) for r in rows]
    group = union(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[i] == sets[j]])
    assert Counter(key(r) for r in out.collect()) == Counter(key(rows[i]) for i in range(len(rows)) if not sets[i]) + Counter(min((key(rows[j]) for j in group if group[j] == g), key=lambda k: (k[0] == "None", k[0])) for g in {group[i] for i in range(len(rows)) if sets[i]})
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "A B C d e f"), (4, "x")], "doc_id long, text string")
    assert neardup.representatives(nulls).count() == 2
    assert neardup.representatives(empty).count() == 0


def test_mixing(spark, sf_dir, docs):
    from linewright.llm import mixing

    out = STAGE["mixing"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    got, rows = Counter(map(tuple, out.collect())), {r.doc_id: tuple(r) for r in docs.collect()}
    assert set(got) <= set(rows.values())
    for r in mixing.mix(docs).collect():
        times = got[rows[r.doc_id]]
        assert abs(times * r["size"] - r.taken) <= r["size"] / 2 and times <= 2


def test_encoding(spark, sf_dir, hard):
    out = STAGE["BPE encoding"](spark, hard, sf_dir).collect()
    assert out[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    for r, x in zip(hard.collect(), out, strict=True):
        ids = TIKTOKEN.encode_ordinary(r.text or "")
        assert x.ids == ids and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_rows(spark, sf_dir, hard, empty):
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf_dir).count() == 0, name
        out = stage(spark, hard, sf_dir)
        assert out.columns == hard.columns, name
        assert {key(r) for r in out.collect()} <= {key(r) for r in hard.collect()}, name


def test_whole(spark, sf_dir, docs):
    want = docs
    for _, stage in pipeline.STAGES:
        want = stage(spark, want, sf_dir)
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, want.collect()))
