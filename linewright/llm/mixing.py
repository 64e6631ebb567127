"""Mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

Targets: sources share a total by weight; a target above its source's limit stops there and the excess goes to the others by
weight, until none is above. Positions: a source's weight over training time t in [0, 1] is 1 + slope * (2t - 1); its
integral t + slope * (t*t - t) is the part of its target that is due by t. A document that stands at the part u of its
source's cumulative demand gets the t that solves the integral for u, and the documents are sorted by range of t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import Scratch, word_count

#: By a source's place modulo 3.
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
SHARE, LIMIT = 1.5, 2
#: Rows of one source that one task numbers.
BLOCK = 20_000


def _nth(values, place: Column) -> Column:
    """values[place % len(values)]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values)).cast("int") + 1)


def number_sources(names: DataFrame) -> DataFrame:
    """source, place: the distinct sources from 0 in the order of their code points, null last.

    Sources are counted by their first two bytes, so that no task has to sort all; each group is then numbered by itself.
    """
    key = F.coalesce(F.hex(F.substring(F.col("source").cast("binary"), 1, 2)), F.lit("~"))
    keyed = names.select("source", F.col("size"), key.alias("k"))
    starts = keyed.groupBy("k").agg(F.count("*").alias("n"))
    starts = starts.select("k", (F.sum("n").over(Window.orderBy("k")) - F.col("n")).alias("start"))
    return keyed.join(starts, "k").select("source", "size", (F.row_number().over(Window.partitionBy("k").orderBy("source")) - 1 + F.col("start")).alias("place"))


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, place, source_size, weight, target from sizes (source, size, one row per source).

    The driver sees one row of sums per round; a round closes every source above its limit at once.
    """
    src = number_sources(sizes).select("source", "place", F.col("size").alias("source_size"), _nth(weights, F.col("place")).cast("double").alias("weight"))
    src = scratch.save(src.withColumn("cap", (F.col("source_size") * limit).cast("double")))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, closed = None, -1
    while True:
        shut = F.lit(False) if level is None else F.col("weight") * level[0] / level[1] > F.col("cap")
        c, w, n = src.agg(F.sum(F.when(shut, F.col("cap")).otherwise(0.0)), F.sum(F.when(shut, 0.0).otherwise(F.col("weight"))), F.count_if(shut)).first()
        if n == closed or not w:
            break
        level, closed = (total * share - c, w), n
    open_ = F.lit(0.0) if level is None else F.col("weight") * level[0] / level[1]
    return src.withColumn("target", F.least(F.col("cap"), open_)).drop("cap")


def _order(doc_id: Column) -> Column:
    """A document's turn within its source: by md5 of its id, so that a part of a source is a fair sample of it."""
    return F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.lit("~"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, slopes=SLOPES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (null if nothing is taken) for each row of docs (doc_id, text, source).

    A source is gone through from its first document by md5 of the id, again from the start if its target is above its size,
    until the target's whole words are reached; the document in which it ends is taken in part. So a source's taken words
    miss its target by less than one, and no document exceeds limit times its size. Null sources are one source, a null
    text has size 0, null ids come last in their source. Repeated rows are separate documents. Rows of one id come by size,
    text and then whatever else keep names, so only equal rows change places. Other columns are ignored unless named in keep;
    those may be of any type. A source's running sums come from sums per block of md5, so a hot source is spread over many tasks.
    """
    scratch = Scratch(docs.sparkSession)
    # maps have no order, so what is kept is ordered by a hash of its JSON
    tie = [F.xxhash64("text").alias("tie")] + [F.xxhash64(F.to_json(F.struct(*keep))).alias("tie2")] * bool(keep)
    rows = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *tie, *keep))
    sums, n = rows.agg(F.count("*"), F.max("size")).first(), 1
    while n * BLOCK < sums[0] * 4 and n < 1 << 28:
        n *= 4
    block = F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(F.floor(F.conv(F.substring(_order(F.col("doc_id")), 1, 7), 16, 10).cast("long") * n / (1 << 28)))
    rows = rows.withColumn("turn", _order(F.col("doc_id"))).withColumn("block", block)
    per_block = scratch.save(rows.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    by_source = targets(per_block.groupBy("source").agg(F.sum("block_size").alias("size")), scratch, weights, share, limit)
    starts = per_block.withColumn("start", F.sum("block_size").over(Window.partitionBy("source").orderBy("block")) - F.col("block_size")).alias("b")
    starts = starts.join(by_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.block", "b.start", "place", "source_size", "target")
    starts = scratch.save(starts)
    inner = Window.partitionBy("source", "block").orderBy("turn", "doc_id", "size", "tie", *["tie2"] * bool(keep)).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("end", F.sum("size").over(inner)).alias("r")
    out = summed.join(starts.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.block") == F.col("t.block")))
    words = F.floor(F.col("target")).cast("long")
    before = F.col("start") + F.col("end") - F.col("size")
    passes = sum(F.greatest(F.lit(0), F.least(F.col("size"), words - before - k * F.col("source_size"))) for k in range(limit))
    out = out.select("doc_id", "size", "source_size", "target", passes.cast("long").alias("taken"), before.alias("before"), "place", "r.source", "r.tie", *[f"r.{c}" for c in keep])
    return out.withColumn("position", F.when(F.col("taken") > 0, due(F.col("before") / F.col("target"), _nth(slopes, F.col("place")))))


def due(u: Column, slope: Column) -> Column:
    """The t in [0, 1] with t + slope * (t*t - t) = u, rounded to 9 digits."""
    b = 1 - slope
    root = (F.sqrt(b * b + 4 * slope * u) - b) / F.when(slope == 0, F.lit(1.0)).otherwise(2 * slope)
    return F.round(F.when(slope == 0, u).otherwise(root), 9)


def schedule(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in training order, each as often as it is taken; at a source's end a document counts as a whole one
    if at least half of it is taken.

    Columns are those of docs, of any type, and may hold nulls and names used here. Documents due at the same place (to nine
    digits) come by doc_id, null first, then by a hash of the text, so that reruns agree but for equal rows. Repeated rows
    are separate documents; documents without words are never taken.
    """
    columns = docs.columns
    inner = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(*columns).alias("_lw_row"))
    mixed = mix(inner, keep=("_lw_row",), **options)
    size, src, words = F.col("size"), F.col("source_size"), F.floor(F.col("target"))
    slope = _nth(options.get("slopes", SLOPES), F.col("place"))
    at = F.filter(F.transform(F.sequence(F.lit(0), F.lit(options.get("limit", LIMIT) - 1)), lambda k: F.col("before") + k * src), lambda x: 2 * (words - x) >= size)
    placed = mixed.where(F.col("taken") > 0).select("_lw_row", "doc_id", "tie", F.col("target"), slope.alias("slope"), F.explode(at).alias("at"))
    placed = placed.select("_lw_row", "doc_id", "tie", due(F.col("at") / F.col("target"), F.col("slope")).alias("position"))
    place = ("position", "doc_id", "tie")
    ordered = placed.repartitionByRange(*place).sortWithinPartitions(*place)
    return ordered.select("_lw_row.*")
