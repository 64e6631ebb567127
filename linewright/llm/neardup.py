"""MinHash near-duplicates by bottom-k sketches of one hash function.

A text's set is its distinct word shingles; equal sets, by a 128-bit digest, are one node. A node's sketch is its K smallest
shingle hashes, which is its whole set if that is no larger. The inverted lists of the retained values, rarest values first,
generate overlaps: two sets with the wanted similarity share so many retained values that they meet in one of each other's
rarest ones (a prefix). Pairs are left out, before they become rows, whose parities differ in more bits than sets with the
wanted similarity have unlike shingles: a parity is one bit per class of hashes, odd or even number of shingles, so each
unlike shingle flips one bit. The bottom-k of the union then estimates the similarity, and pairs that may pass are verified
on their whole sets. Bounds on sketches come from the binomial law at a miss chance of MISS for a pair right at the threshold;
sets that are retained whole, with all that they may be similar to, are bounded without chance.
"""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, map_arrow, pieces, texts
from linewright.llm.fingerprint import Words, mix
from linewright.llm.graph import connect

K = 64
#: Longs of a set's parity.
PARITY = 8
MISS = 1e-9
_U = np.uint64


def shingle_set(raw: bytes, size: int, words: Words) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    h = words.of(raw.lower().split())
    n = len(h)
    if not n:
        return h
    w = min(n, size)
    out = np.full(n - w + 1, _U(w * 0x9E3779B97F4A7C15 % 2**64))
    for j in range(w):
        out = mix(out + h[j : n - w + 1 + j])
    return np.unique(out)


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest as two longs."""
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - 2**63, d % 2**64 - 2**63


def least_shared(k: int, num: int, den: int) -> int:
    """Values of a union's bottom-k that both sets hold, at least, but for a chance of MISS."""
    t, below = num / den, 0.0
    for c in range(k + 1):
        below += comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > MISS:
            break
    return max(1, min(c, k * num // den))


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each class of hashes whether the set has an odd number of them, as longs."""
    return np.packbits(np.bincount((shingles >> _U(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) % 2 == 1).view(np.int64)


PARITIES = [f"x{i}" for i in range(PARITY)]


def _sketch(batches, size, k):
    words = Words()
    for b in pieces(batches, 200):
        sets = [shingle_set(t, size, words) for t in texts(b.column(1))]
        nodes = [node_of(s) if len(s) else (None, None) for s in sets]
        odd = np.array([parity(s) for s in sets], np.int64).reshape(-1, PARITY)
        yield {"doc_id": b.column(0), "row": b.column(2), "n": [len(s) for s in sets], "d": [x for x, _ in nodes], "e": [x for _, x in nodes], "sketch": [s[:k].view(np.int64) for s in sets]} | dict(zip(PARITIES, odd.T, strict=True))


def _estimate(batches, k, least, num, den):
    """Pairs that the bottom-k of their union leaves possible; a union below k is the sets' own."""
    for b in batches:
        sa, sc = ([x.values.to_numpy().view(_U)] + [x.offsets.to_numpy()] for x in (b.column(2), b.column(3)))
        good = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            both = np.sort(np.concatenate([s[0][s[1][i] : s[1][i + 1]] for s in (sa, sc)]), kind="stable")
            twice = both[1:] == both[:-1]
            single = np.concatenate([[True], ~twice])
            shared = np.concatenate([twice, [False]])[single][:k]
            good[i] = shared.sum() >= least if len(shared) == k else den * shared.sum() >= num * len(shared)
        yield {"a": b.column(0).to_numpy()[good], "b": b.column(1).to_numpy()[good]}


def _sets(batches, size):
    words = Words()
    for b in pieces(batches, 200):
        sets = [shingle_set(t, size, words) for t in texts(b.column(0))]
        want = list(zip(*(b.column(i).to_pylist() for i in (2, 3)), strict=True))
        ok = [i for i, s in enumerate(sets) if len(s) and node_of(s) == want[i]]
        yield {"node": b.column(1).take(ok), "shingles": [sets[i].tobytes() for i in ok]}


def _verify(batches, num, den):
    for b in batches:
        out = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(den * shared >= num * (len(both) - shared))
        ok = np.array(out, bool)
        yield {"a": b.column(0).to_numpy()[ok], "b": b.column(1).to_numpy()[ok]}


def prefixes(nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """v, before, id, n, parities, must, odd, left: each node's rarest retained values that some other node also retains, as many as a pair must meet in.

    before: the node's values before this one. must: retained values that a similar set shares at least. sole: values that no other node retains. left: retained values
    from this one on, in order of rarity, which bounds what a pair first meeting here can share.
    """
    values = nodes.select("node", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    shared = values.join(often, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("s"))  # k values at most
    held = F.least(F.col("n"), F.lit(k))
    whole = F.ceil(F.col("n") * F.lit(num) / F.lit(den) - 1e-9).cast("int")
    must = F.when(F.col("n") * den < k * num, whole).otherwise(F.least(whole, F.lit(least_shared(k, num, den))))
    rows = shared.join(nodes.select("node", "n", *PARITIES), "node").withColumn("must", must).withColumn("sole", held - F.size("s")).withColumn("take", held - F.col("must") + 1 - F.col("sole")).where("take > 0")
    rows = rows.withColumn("odd", -F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["f"]) / held)
    rows = rows.select("node", "n", *PARITIES, "must", "sole", "odd", F.col("s.v").alias("s"), F.posexplode(F.slice("s.v", F.lit(1), F.col("take"))).alias("i", "v"))
    return rows.select("v", F.slice("s", F.lit(1), F.col("i")).alias("before"), F.col("node").alias("id"), "n", *PARITIES, "must", "odd", (held - F.col("sole") - F.col("i")).alias("left"))


def row_key():
    """One long for each text; rows of one doc_id that share it are the same row again."""
    return F.xxhash64("text")


def find_groups(docs: DataFrame, scratch: Scratch, shingle: int, num: int, den: int, k: int) -> DataFrame:
    """doc_id, row, n_shingles, doc, first_row for each row of docs: doc and first_row are those of its group's first row.

    A group's first row is that of the smallest doc_id, nulls last, and then the smallest row key; null for rows without words.
    """
    least = least_shared(k, num, den)
    base = scratch.save(map_arrow(docs.select("doc_id", "text", row_key().alias("row")), _sketch, f"doc_id long, row long, n int, d long, e long, sketch array<long>, {', '.join(f'{x} long' for x in PARITIES)}", shingle, k))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("row"))
    found = base.where("n > 0").groupBy("d", "e").agg(F.min(place).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), *[F.first(x).alias(x) for x in PARITIES])
    nodes = scratch.save(found.withColumn("node", F.monotonically_increasing_id()))
    lists = scratch.save(prefixes(nodes, k, num, den))

    def may(p, q):
        a, b = F.col(f"{p}n"), F.col(f"{q}n")
        shared = F.least(F.col(f"{p}left"), F.col(f"{q}left"))
        exact = F.greatest(a, b) * den < k * num
        flipped = sum(F.bit_count(F.col(f"{p}{x}").bitwiseXOR(F.col(f"{q}{x}"))) for x in PARITIES)
        return (F.least(a, b) * den >= F.greatest(a, b) * num) & (flipped * (den + num) <= (a + b) * (den - num)) & (shared >= F.greatest(F.col(f"{p}must"), F.col(f"{q}must"))) & (~exact | (den * shared >= num * (a + b - shared)))

    def verify(pairs):
        of = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s_{c}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "s_a", "s_b")
        near = scratch.save(map_arrow(both, _estimate, "a long, b long", k, least, num, den))
        ids = near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "rep", "d", "e"), "node")
        ids = ids.select("node", "d", "e", F.col("rep.doc").alias("doc"), F.col("rep.row").alias("row"))
        some = docs.select("doc_id", "text", row_key().alias("_row")).join(ids, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("text", "node", "d", "e")
        sets = scratch.save(map_arrow(some, _sets, "node long, shingles binary", shingle).dropDuplicates(["node"]))
        of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
        whole = near.join(of("b"), "b").join(of("a"), "a").select("a", "b", "s_a", "s_b")
        return map_arrow(whole, _verify, "a long, b long", num, den)

    groups = connect(lists, verify, scratch, may, "odd", "before")
    labelled = nodes.select("node", "d", "e", "rep").join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = scratch.save(labelled.groupBy("label").agg(F.min("rep").alias("first")))
    named = scratch.save(labelled.join(firsts, "label").select("d", "e", "first"))
    scratch.keep_only(base, named)
    rows = base.select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), "d", "e").join(named, ["d", "e"], "left")
    return rows.select("doc_id", "row", "n_shingles", F.col("first.doc").alias("doc"), F.col("first.row").alias("first_row"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); linked: den * shared >= num * union.

    A-Z are lower-cased and words stand between ASCII white space; a text with fewer words than a shingle has its whole
    sequence as one, a text without words none, and is linked with nothing. component_id is the smallest doc_id reachable,
    links of equal sets included, kept says whether it is the row's own. A null doc_id is no component's unless it has no
    other. Repeated rows have equal sets. Sets are told apart by 128-bit digests of their shingles' 64-bit hashes, and compared
    by these hashes. Other columns are ignored.
    """
    rows = find_groups(docs, Scratch(docs.sparkSession), shingle, num, den, k)
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("doc")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, k: int = K) -> DataFrame:
    """The rows of docs that stay: of each group that near_duplicates finds, the one of smallest doc_id (null last).

    Rows without words stay. Of rows that share doc_id and text one stays, whatever their other columns hold. Only keys of
    rows that go are joined with the texts.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(find_groups(docs, scratch, shingle, num, den, k).where("n_shingles > 0"))
    key = {"doc_id": "_lw_doc", "row": "_lw_row"}
    own = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row") == F.col("first_row"))
    gone = scratch.save(rows.where(~own).select("doc_id", "row").distinct().withColumnsRenamed(key))
    again = scratch.save(rows.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumnsRenamed(key))
    scratch.keep_only(gone, again)
    same = lambda t: F.col("doc_id").eqNullSafe(t["_lw_doc"]) & (F.col("_lw_key") == t["_lw_row"])
    kept = docs.withColumn("_lw_key", row_key())
    kept = kept.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        twice = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "_lw_key"])
        kept = kept.join(again, same(again), "left_anti").unionByName(twice)
    return kept.select(*docs.columns)
