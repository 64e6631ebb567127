"""Where a corpus repeats strings of a given length: the plan that suffix arrays and suffix trees share.

A window is `length` symbols (bytes or word hashes) of one document. Of a window's grams of `gram` symbols the one of least
hash (leftmost of equals) is its anchor, so equal windows have equal anchors at equal places, and neighbouring windows mostly
share theirs: windows first to last of one anchor, with all their symbols, are a context. Only anchors whose gram occurs
again can matter. Contexts that are equal as a whole are one class and are settled by counting it. What is left are
different contexts around one gram; they are brought together by gram, as a shard, and a solver (an array or a tree) finds the
windows that stand in several of them. A gram with more classes than GROUP is not gathered: its windows are counted one by one
by 128-bit digests. Texts are shuffled twice, to cut out contexts and to apply what was found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, map_arrow, pieces, texts
from linewright.llm.fingerprint import Words, mix

#: Classes of one gram that a task gathers, symbols that a solver gets at once, windows cut at a time.
GROUP, SHARD, CHUNK = 4096, 1 << 20, 1 << 19
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_TABLES: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a fixed odd number and of its inverse."""
    if len(_TABLES.get("up", ())) < n:
        m = max(1 << 16, 2 * n)
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            _TABLES[name] = np.concatenate([np.ones(1, _U), np.full(m - 1, _U(x))]).cumprod(dtype=_U)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of so many values, from the prefix sums of a polynomial."""
    up, down = powers(len(values))
    sums = np.concatenate([np.zeros(1, _U), (values * up).cumsum(dtype=_U)])
    return mix((sums[size:] - sums[:-size]) * down[: len(values) - size + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    pad = -len(x) % w
    grid = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def contexts(values: np.ndarray, length: int, gram: int):
    """(hash of the anchor's gram, first window, last window) of each context of one document, in order."""
    n = len(values) - length + 1
    w, mask = length - gram + 1, _U((1 << 20) - 1)
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        h = gram_hashes(values[at : end + length - 1], gram)
        anchor = (_sliding_min((h & ~mask) | np.arange(len(h), dtype=_U), w) & mask).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [end - at - 1]])
        yield h[anchor[first]], first + at, last + at


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols: their bytes, or their words' hashes; width is a symbol's bytes in a context."""

    words: bool

    def read(self, raw: bytes, known: Words) -> tuple[np.ndarray, bytes, int]:
        """Values to hash, the buffer that contexts are cut from, bytes of a symbol."""
        if self.words:
            h = known.of(raw.split())
            return mix(h), h.tobytes(), 8
        return _BYTE[np.frombuffer(raw, np.uint8)], raw, 1


def _anchors(batches, symbols, length, gram):
    known = Words()
    for b in pieces(batches, 100):
        out: dict[str, list] = {c: [] for c in ("row", "doc", "gram", "whole", "lo", "hi")}
        for row, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
            values, buffer, width = symbols.read(raw, known)
            for grams, first, last in contexts(values, length, gram):
                whole = [xxhash.xxh3_64_intdigest(buffer[i * width : (j + length) * width]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                out["gram"].append(grams.view(np.int64))
                out["whole"].append(np.array(whole, _U).view(np.int64))
                out["lo"].append(first.astype(np.int32))
                out["hi"].append(last.astype(np.int32))
                out["row"].append(np.full(len(first), row))
                out["doc"].append(np.full(len(first), doc))
        yield {c: np.concatenate(x) if x else np.zeros(0, np.int64 if c in ("row", "doc", "gram", "whole") else np.int32) for c, x in out.items()}


def _cut(batches, symbols, length):
    """The symbols of wanted contexts; wanted: list of (gram, whole, n, doc, many, lo, hi)."""
    known = Words()
    for b in pieces(batches, 100):
        out: dict[str, list] = {c: [] for c in ("gram", "whole", "n", "doc", "many", "symbols")}
        for raw, wanted in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
            _, buffer, width = symbols.read(raw, known)
            for x in wanted:
                for c in ("gram", "whole", "n", "doc", "many"):
                    out[c].append(x[c])
                out["symbols"].append(buffer[x["lo"] * width : (x["hi"] + length) * width])
        yield out


def _solve(batches, solver, width, length):
    """Grams come together and in order; a shard is whole grams of SHARD symbols at least, or what there is."""
    held: list[tuple] = []
    size, last = 0, None

    def solve():
        kept = list({(x[0], x[1]): x for x in held}.values())  # equal rows cut out the same context
        for x, windows in zip(kept, solver([x[4] for x in kept], [x[2] for x in kept], [x[3] for x in kept], length), strict=True):
            if windows.any():
                yield x[0], x[1], np.packbits(windows).tobytes()

    for b in batches:
        out = []
        for x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= SHARD and x[0] != last:
                out += solve()
                held, size = [], 0
            last = x[0]
            held.append(x)
            size += len(x[4]) // width
        if out:
            yield dict(zip(("gram", "whole", "bits"), zip(*out, strict=True), strict=True))
    if held and (out := list(solve())):
        yield dict(zip(("gram", "whole", "bits"), zip(*out, strict=True), strict=True))


def _digests(batches, width, length):
    for b in pieces(batches, 200):
        out: dict[str, list] = {c: [] for c in ("gram", "whole", "n", "doc", "window", "at")}
        for x in b.to_pylist():
            for i in range(len(x["symbols"]) // width - length + 1):
                for c in ("gram", "whole", "n", "doc"):
                    out[c].append(x[c])
                out["window"].append(xxhash.xxh3_128_digest(x["symbols"][i * width : (i + length) * width]))
                out["at"].append(i)
        yield out


def _bits(batches):
    for b in batches:
        yield {"gram": b.column(0), "whole": b.column(1), "bits": [np.packbits(np.bincount(x, minlength=max(x) + 1) > 0).tobytes() for x in b.column(2).to_pylist()]}


Solver = Callable[[list[bytes], list[int], list[int], int], list[np.ndarray]]


def repeated(docs: DataFrame, scratch: Scratch, symbols: Symbols, length: int, gram: int, solver: Solver, by_document: bool) -> DataFrame:
    """row, found (list of lo, hi, bits): per document the runs of windows lo to hi that repeat, bits naming some or null for all.

    docs: row, doc, text; rows that share a row number are equal. A window repeats if it starts elsewhere too, or, by_document,
    in a smaller doc.
    """
    width = 8 if symbols.words else 1
    every = scratch.save(map_arrow(docs.select("row", "doc", "text"), _anchors, "row long, doc long, gram long, whole long, lo int, hi int", symbols, length, gram))
    again = every.groupBy("gram").agg(F.count("*").alias("f")).where("f > 1").drop("f")
    some = scratch.save(every.join(again, "gram"))
    scratch.drop(every)
    classes = scratch.save(some.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc", "row", "lo", "hi")).alias("first")))
    several = classes.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1")
    wanted = classes.join(several, "gram").select(F.col("first.row").alias("row"), F.struct("gram", "whole", "n", F.col("first.doc").alias("doc"), "many", F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi")).alias("x"))
    wanted = wanted.groupBy("row").agg(F.collect_list("x").alias("x"))  # as many as the document has contexts
    cut = scratch.save(map_arrow(docs.select("row", "text").join(wanted, "row").select("text", "x"), _cut, "gram long, whole long, n long, doc long, many long, symbols binary", symbols, length))
    few = cut.where(F.col("many") <= GROUP).select("gram", "whole", "n", "doc", "symbols").repartition("gram").sortWithinPartitions("gram", "whole")
    found = map_arrow(few, _solve, "gram long, whole long, bits binary", solver, width, length)
    # a gram with many contexts: windows by digest, summed up before they are shuffled
    windows = map_arrow(cut.where(F.col("many") > GROUP), _digests, "gram long, whole long, n long, doc long, window binary, at int", width, length).dropDuplicates(["gram", "whole", "at"])
    windows = scratch.save(windows)
    if by_document:
        hit = windows.join(windows.groupBy("window").agg(F.min("doc").alias("least")), "window").where("least < doc")
    else:
        hit = windows.join(windows.groupBy("window").agg(F.sum("n").alias("all")).where("all > 1"), "window")
    single = hit.groupBy("gram", "whole").agg(F.collect_list("at").alias("at"))  # a context's windows at most
    found = scratch.save(found.unionAll(map_arrow(single, _bits, "gram long, whole long, bits binary")))
    scratch.drop(cut, windows)
    known = classes.select("gram", "whole", "n", F.col("first.doc").alias("least")).join(found, ["gram", "whole"], "left")
    settled = F.col("doc") > F.col("least") if by_document else F.col("n") > 1
    known = known.where("bits is not null or n > 1")
    members = some.join(known, ["gram", "whole"]).select("row", "lo", "hi", F.when(~settled, F.col("bits")).alias("bits"), settled.alias("settled")).where("settled or bits is not null")
    return scratch.save(members.groupBy("row").agg(F.collect_set(F.struct("lo", "hi", "bits")).alias("found")))


def covered(n: int, found: list[dict], length: int) -> np.ndarray:
    """Which of a document's n symbols some repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for x in found:
        if x["bits"] is None:
            edge[x["lo"]] += 1
            edge[x["hi"] + length] -= 1
        else:
            at = x["lo"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8)))
            edge[at] += 1
            edge[at + length] -= 1
    return edge[:n].cumsum() > 0
