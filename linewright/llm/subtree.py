"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes that may repeat are split by what they start with into groups that fit in memory: contexts come together by a gram
of words, and within a shard suffixes are split by prefixes that grow, a group that is small enough or ends alone being
split no further. Small groups are packed together. A tree is built from its root: each step reads the next words of every
suffix that still shares its path with another as one edge, told apart by a 64-bit hash, and branches. Internal nodes as deep
as a window are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, map_arrow, pieces, texts
from linewright.llm.fingerprint import mix
from linewright.llm.repeats import Symbols, covered, powers, repeated

LENGTH, GRAM = 50, 16
#: Suffixes of a group whose tree is built at once, and words of an edge near the root, where most paths part.
SUFFIXES, STEP = 1 << 16, 8


class Paths:
    """Hashes of any run of a shard's words, from prefix sums of a polynomial."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), (mix(words) * up[: len(words)]).cumsum(dtype=np.uint64)])

    def children(self, node: np.ndarray, starts: np.ndarray, depth: int, take: int) -> np.ndarray:
        """Child of each suffix: its node and the next words on its path, numbered from 0."""
        at = starts + depth
        edge = mix((self.sums[at + take] - self.sums[at]) * self.down[at])
        return np.unique(mix(edge + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)[1]


def prefix_groups(paths: Paths, starts: np.ndarray, length: int):
    """(suffixes, node, depth): groups by variable-length prefixes, packed to SUFFIXES at most unless whole windows are equal.

    A prefix that too many suffixes share grows by a word; one that a single suffix has is left out.
    """
    open_ = [(starts, 0)]
    while open_:
        own, depth = open_.pop()
        if len(own) <= SUFFIXES or depth >= length:
            yield own, np.zeros(len(own), np.int64), depth
            continue
        node = paths.children(np.zeros(len(own), np.int64), own, depth, 1)
        order = np.argsort(node, kind="stable")
        own, node = own[order], node[order]
        size = np.bincount(node)
        large = np.flatnonzero(size > SUFFIXES)
        ends = np.cumsum(size)
        open_ += [(own[ends[k] - size[k] : ends[k]], depth + 1) for k in large]
        some = np.flatnonzero((size > 1) & (size <= SUFFIXES))
        pack = np.full(len(size), -1)
        pack[some] = np.cumsum(size[some]) // SUFFIXES
        of = pack[node]
        own, node = own[of >= 0], node[of >= 0]
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(of[of >= 0])) + 1):
            yield own[part], node[part], depth + 1


def deep_nodes(paths: Paths, starts: np.ndarray, node: np.ndarray, depth: int, length: int):
    """(suffixes, node): those that share a node of the wanted depth with another suffix."""
    while depth < length and len(starts):
        take = min(length - depth, STEP if depth < STEP else length)
        node = paths.children(node, starts, depth, take)
        depth += take
        shared = np.bincount(node)[node] > 1
        starts, node = starts[shared], node[shared]
    return starts, node


def tree_solver(strings: list[bytes], _counts: list[int], docs: list[int], length: int) -> list[np.ndarray]:
    """For each string which of its windows also start in a string of a smaller document."""
    arrays = [np.frombuffer(s, np.uint64) for s in strings]
    lens = np.array([len(a) for a in arrays], np.int64)
    words = np.concatenate([*arrays, np.zeros(0, np.uint64)])
    at = np.cumsum(lens) - lens
    room = np.maximum(lens - length + 1, 0)
    owner = np.repeat(np.arange(len(lens)), room)
    starts = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + at[owner]
    whose = np.repeat(np.array(docs, np.int64), lens)
    hit, paths = np.zeros(len(words), bool), Paths(words)
    for own, prefix, depth in prefix_groups(paths, starts, length):
        leaves, node = deep_nodes(paths, own, prefix, depth, length)
        if len(leaves):
            least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, whose[leaves])
            hit[leaves[least[node] < whose[leaves]]] = True
    return [hit[a : a + r] for a, r in zip(at.tolist(), room.tolist(), strict=True)]


def _apply(batches, length):
    for b in pieces(batches, 100):
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
        for doc_id, raw, found in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = raw.split()
            gone = covered(len(words), found or [], length)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
            for c, x in (("doc_id", doc_id), ("n_words", len(words)), ("n_removed", int(gone.sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept.decode())):
                out[c].append(x)
        yield out


def word_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept for each row of docs (doc_id, text).

    A word goes if a window of this many words that covers it also starts in a document of smaller doc_id. Null ids come
    after all others; rows of one doc_id, repeated ones too, take nothing from each other. A null or shorter text loses
    nothing. Other columns are ignored. Words are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "text")
    found = repeated(rows, scratch, Symbols(words=True), length, gram or max(1, length // 3), tree_solver, by_document=True)
    joined = rows.select("doc_id", "text", "row").join(found, "row", "left").select("doc_id", "text", "found")
    return map_arrow(joined, _apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", length)
