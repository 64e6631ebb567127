"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document's text.

Features come from the text alone. Per class the mean and covariance are sums over all labelled training rows, added up on
the executors; the covariance is shrunk towards the pooled one and towards a scaled identity, factored once (Cholesky), and
a score is the logistic of the difference of log densities (Mahalanobis distance plus log determinant) and log priors.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, map_arrow, pieces, reach_workers, texts

N_FEATURES = 16
#: Shares of the pooled covariance and of the scaled identity in a class's covariance.
POOLED, SPHERE = 0.2, 0.02

_UPPER, _LOWER, _DIGIT, _SPACE, _MARKS, _HIGH = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH[128:] = True
_MARKS[33:127] = True
_MARKS &= ~(_UPPER | _LOWER | _DIGIT)
_PLAIN = [ord(c) for c in ".,;:'\"()-?"]
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _MARKS, _HIGH]).astype(float)


def features(raw: bytes) -> list[float]:
    """Transformed statistics of one text; an empty text has those of length 0."""
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, space, marks, high = (_CLASSES @ counts).tolist()
    plain = float(counts[_PLAIN].sum())
    odd = counts.copy()
    odd[_PLAIN] = 0
    top = float((odd * _MARKS).max())
    words = raw.split()
    w = len(words)
    kinds = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    short = sum(1 for x in words if len(x) < 4)
    lines = int(counts[10]) + 1
    d, dw = n + 10.0, w + 5.0
    share = counts[counts > 0] / max(n, 1)
    return [
        np.log1p(n), np.log1p(w / lines), np.sqrt(upper / d), lower / d, np.sqrt(digit / d), space / d, np.sqrt((marks - plain) / d), np.sqrt(plain / d),
        np.sqrt(high / d), np.sqrt(top / d), np.log(kinds + 5.0) - np.log(dw), np.sqrt(repeats / dw), short / dw, np.log1p((n - space) / max(w, 1)), float(-(share * np.log(share)).sum()), np.log1p(lines) / np.log(dw),
    ]


def _features(batches):
    for b in pieces(batches):
        yield {"doc_id": b.column(0), "x": [features(t) for t in texts(b.column(1))]}


def featurize(docs: DataFrame) -> DataFrame:
    return map_arrow(docs.select("doc_id", "text"), _features, "doc_id long, x array<double>")


def _moments(batches):
    sums = {}
    for b in batches:
        y = np.array(b.column(0).to_pylist())
        x = np.array(b.column(1).to_pylist(), float).reshape(len(y), -1)
        for c in (0, 1):
            if len(own := x[y == c]):
                one = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                sums[c] = sums.get(c, 0) + one
    for c, s in sums.items():
        yield {"label": [c], "s": [s]}


class Discriminant:
    """Means, Cholesky factors and log priors of both classes; None where a class has under two rows."""

    def __init__(self, sums: dict[int, np.ndarray], d: int = N_FEATURES):
        n = [float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)]
        self.prior = (n[1] + 1) / (n[0] + n[1] + 2)
        self.classes = None
        if min(n) < 2:
            return
        means = [sums[c][1 : d + 1] / n[c] for c in (0, 1)]
        covs = [sums[c][d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.scale = scale
        self.classes = []
        for c in (0, 1):
            cov = (1 - POOLED) * covs[c] + POOLED * pooled
            cov = cov / scale / scale[:, None]
            cov = np.round((1 - SPHERE) * cov + SPHERE * max(np.trace(cov) / d, 1e-3) * np.eye(d), 10)
            low = np.linalg.cholesky(cov)
            self.classes.append((np.round(means[c] / scale, 10), np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        if self.classes is None:
            return np.full(len(x), self.prior)
        log = [-0.5 * ((((x / self.scale) - m) @ inv.T) ** 2).sum(1) - 0.5 * det for m, inv, det in self.classes]
        z = np.clip(log[1] - log[0] + np.log(self.prior / (1 - self.prior)), -700, 700)
        return 1 / (1 + np.exp(-z))


def fit(features_: DataFrame, labels: DataFrame, scratch: Scratch) -> Discriminant:
    """labels: doc_id, label (0 or 1; others and nulls are left out). Only sums of a fixed number reach the driver."""
    rows = labels.where("label in (0, 1) and doc_id is not null").join(features_, "doc_id").select(F.col("label").cast("int"), "x")
    sums = map_arrow(rows, _moments, "label int, s array<double>").select("label", F.posexplode("s").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.label, np.zeros(1 + N_FEATURES + N_FEATURES**2))[r.i] = r.v
    return Discriminant(out)


def _scores(batches, model, threshold):
    for b in batches:
        s = model.score(np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)) if b.num_rows else np.zeros(0)
        yield {"doc_id": b.column(0), "score": s, "predicted": (s >= threshold).astype(np.int32)}


def score(features_: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    return map_arrow(features_.select("doc_id", "x"), _scores, "doc_id long, score double, predicted int", model, threshold)


def _scorer(model: Discriminant):
    """Scores of a text column; only texts and scores pass between the JVM and Python, rows stay where they are."""

    def scores(column: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for i in range(0, len(column), 500):
            out.append(model.score(np.array([features(t) for t in texts(column.slice(i, 500))], float).reshape(-1, N_FEATURES)))
        return pa.array(np.concatenate(out))

    return scores


def accept(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores threshold or more, as they are; a null text is empty, repeated rows share a fate.

    Columns other than text are not looked at, so nulls and clashing names in them do not matter. Rows never meet.
    """
    reach_workers(docs.sparkSession)
    return docs.where(F.arrow_udf(_scorer(model), "double")("text") >= threshold)


def held_out(doc_id):
    """Rows that no label is learnt from: crc32 of the id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), learning from labels (doc_id, quality).

    A null text is empty and scored like any; a null doc_id is scored, matches no label and is not held out. Repeated
    labels each count. With fewer than two training rows of a class every score is the smoothed share of label 1. Other
    columns are ignored. The text is read once; only features (fixed width) are joined with labels.
    """
    scratch = Scratch(docs.sparkSession)
    x = scratch.save(featurize(docs))
    train = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = fit(x, train, scratch)
    return score(x, model, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
