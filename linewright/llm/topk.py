"""Exact top-k inner products by buckets of vector length.

Vectors are range-sorted by length and cut into buckets of bounded size, longest first. Queries come in blocks. The longest
bucket gives every query a first k-th best score, theta. For a bucket whose longest vector has length l, a product of theta
needs the cosine theta / (|q| * l) at least: above 1 the bucket is skipped for that query. Otherwise the bucket's vectors are
pruned by length (a prefix of the bucket, as it is sorted), or, where the cosine is high, by coordinates: for the query's
largest coordinates only a range of values of a unit vector can reach the cosine. What is left is verified by its product.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, map_arrow

#: Numbers in a bucket of vectors and in a block of queries.
BUCKET, QUERIES = 1 << 17, 1 << 14
FOCUS = 4
#: Local cosines from which coordinates are looked at; below, they prune next to nothing.
COORDINATES_FROM = 0.85
LONGS = 2**63


def _as_matrix(vectors: list) -> np.ndarray:
    dim = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _blocks(batches, numbers):
    """Rows in runs of bounded size; the rows of a partition come in order."""
    ids, vectors, size, n, task = [], [], 0, 0, TaskContext.get().partitionId()

    def block():
        m = _as_matrix(vectors)
        length = np.sqrt((m * m).sum(1)) * (1 + 1e-9)
        order = np.argsort(-length, kind="stable")
        return {"block": [task << 32 | n], "top": [float(length.max())], "n": [len(ids)], "dim": [m.shape[1]], "ids": [np.array(ids, "<i8")[order].tobytes()], "data": [m[order].astype("<f8").tobytes()]}

    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            vectors.append(v)
            size += max(1, len(v))
            if size >= numbers:
                yield block()
                ids, vectors, size, n = [], [], 0, n + 1
    if ids:
        yield block()


BLOCK = "block long, top double, n int, dim int, ids binary, data binary"


def _open(n, dim, ids, data):
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(n, dim)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: floats while no partial sum can pass 2**53, else integers of any size, held to a long's range."""
    dim = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, v))
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * dim < 2.0**53:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.clip(exact, -LONGS, LONGS - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[-k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near].astype(object) if scores.min() == -LONGS else -scores[near]))[:k]]
    return np.array(sorted(range(len(ids)), key=lambda i: (-int(scores[i]), int(ids[i])))[:k], np.int64)


def survivors(q, q_len, unit, length, theta):
    """For each query the places in the bucket that can reach its theta: all of a prefix (length) or chosen ones (coordinates)."""
    cosine = theta / np.maximum(q_len * length[0], 1e-300)
    prefix = np.searchsorted(-length, -np.maximum(theta, 0) / np.maximum(q_len, 1e-300), side="right")
    prefix = np.where(theta <= 0, len(length), np.where(cosine > 1, 0, prefix))
    chosen = {}
    for i in np.flatnonzero((cosine >= COORDINATES_FROM) & (prefix > 0)):
        x = q[i] / q_len[i]
        focus = np.argsort(-np.abs(x))[:FOCUS]
        ok = np.ones(prefix[i], bool)
        t = min(1.0, cosine[i]) - 1e-9
        for f in focus:
            mid, half = x[f] * t, np.sqrt(max(0.0, 1 - x[f] ** 2) * (1 - t * t)) + 1e-9
            low = -1.0 if x[f] < 0 and x[f] <= -t else mid - half
            high = 1.0 if x[f] > 0 and x[f] >= t else mid + half
            ok &= (unit[: prefix[i], f] >= low) & (unit[: prefix[i], f] <= high)
        chosen[i] = np.flatnonzero(ok)
    return prefix, chosen


def retrieve(q_ids, q, theta, ids, v, k):
    """(query id, vector id, score) of each query's k best in one bucket that reach its theta."""
    if not len(ids) or not len(q_ids):
        return [], [], []
    dim = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, v))
    length, q_len = (np.sqrt((x * x).sum(1)) * (1 + 1e-9) for x in (v, q))
    unit = v / np.maximum(length, 1e-300)[:, None]
    prefix, chosen = survivors(q, q_len, unit, length, theta)
    out: tuple[list, list, list] = ([], [], [])

    def take(i, places, scores):
        ok = (scores >= theta[i]) & (ids[places] != q_ids[i])
        places, scores = places[ok], scores[ok]
        best = _best(ids[places], scores, k)
        out[0].extend([int(q_ids[i])] * len(best))
        out[1].extend(ids[places[best]].tolist())
        out[2].extend(scores[best].tolist())

    for i, places in chosen.items():
        take(i, places, products(q[i : i + 1], v[places])[0])
    rest = np.array([i for i in np.flatnonzero(prefix > 0) if i not in chosen], np.int64)
    for j in range(0, len(rest), 64):
        some = rest[j : j + 64]
        upto = int(prefix[some].max())
        scores = products(q[some], v[:upto])
        for i, s in zip(some, scores, strict=True):
            take(i, np.arange(prefix[i]), s[: prefix[i]])
    return out


def _seed(batches, k):
    """Query blocks with each query's theta: its k-th best score in the given bucket, or no bound where that has too few."""
    for b in batches:
        for r in b.to_pylist():
            q_ids, q = _open(r["n"], r["dim"], r["ids"], r["data"])
            ids, v = _open(r["v_n"], r["v_dim"], r["v_ids"], r["v_data"])
            theta = np.full(len(q_ids), -np.inf)
            for j in range(0, len(q_ids), 64):
                for i, s in enumerate(products(q[j : j + 64], v), j):
                    s = s[ids != q_ids[i]]
                    if len(s) >= k:
                        theta[i] = np.partition(s, len(s) - k)[-k]
            theta = np.where(np.abs(theta) > 2.0**53, np.nextafter(theta, -np.inf), theta)  # a long may have been rounded up
            need = theta / np.maximum(np.sqrt((q * q).sum(1)) * (1 + 1e-9), 1e-300)  # least length of a vector that can matter
            yield {"q_block": [r["block"]], "need": [float(np.where(theta <= 0, 0.0, need).min())], "q_n": [r["n"]], "q_dim": [r["dim"]], "q_ids": [r["ids"]], "q_data": [r["data"]], "theta": [theta.astype("<f8").tobytes()]}


def _search(batches, k):
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            q_ids, q = _open(r["q_n"], r["q_dim"], r["q_ids"], r["q_data"])
            ids, v = _open(r["n"], r["dim"], r["ids"], r["data"])
            found = retrieve(q_ids, q, np.frombuffer(r["theta"], "<f8"), ids, v, k)
            yield {"query_no": found[0], "no": found[1], "score": found[2]}


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k vectors of highest integer inner product, ties to smaller vec_id.

    vectors: vec_id, embedding; components become floor(scale * x). A query never finds its own row. Null vectors, those with a
    null or non-finite component (also once scaled) and null ids take no part. Rows that share a vec_id are rows like others:
    each is a candidate, also of the other, and each that is a query has ranks of its own. A shorter vector is padded with
    zeros; products beyond a long are held to its range. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    # from 2**53 on a double is whole, and floor() would have to be a long
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", whole.alias("v"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows are numbered in the order of vec_id, so a smaller number is a smaller vec_id
    placed = rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    rows = scratch.save(placed.select(F.monotonically_increasing_id().alias("no"), "vec_id", "v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sorted_ = rows.withColumn("squares", squares).repartitionByRange(parts, F.col("squares").desc(), "no").sortWithinPartitions(F.col("squares").desc(), "no")
    buckets = scratch.save(map_arrow(sorted_.select("no", "v"), _blocks, BLOCK, BUCKET))
    queries = map_arrow(rows.where(is_query(F.col("vec_id"))).select("no", "v").repartition(parts, "no"), _blocks, BLOCK, QUERIES)
    longest = buckets.orderBy(F.col("top").desc(), "block").limit(1).select(F.lit(1).alias("one"), *[F.col(c).alias(f"v_{c}") for c in ("n", "dim", "ids", "data")])
    # one bucket, of bounded size by construction
    seeded = scratch.save(map_arrow(queries.withColumn("one", F.lit(1)).join(F.broadcast(longest), "one"), _seed, "q_block long, need double, q_n int, q_dim int, q_ids binary, q_data binary, theta binary", k))
    # blocks against buckets, by their numbers alone; rows follow by equality
    pairs = seeded.select("q_block", "need").join(buckets.select("block", "top"), F.col("top") >= F.col("need")).select("q_block", "block")
    full = pairs.join(seeded, "q_block").repartition(parts, "block").join(buckets, "block").select(*seeded.columns, *buckets.columns)
    hits = map_arrow(full, _search, "query_no long, no long, score long", k)
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.col("score").desc(), "no"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    name = lambda no, vec_id: rows.select(F.col("no").alias(no), F.col("vec_id").alias(vec_id))
    return best.join(name("query_no", "query_id"), "query_no").join(name("no", "vec_id"), "no").select("query_id", "rank", "vec_id", "score")
