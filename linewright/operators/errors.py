"""Character confusions: counts of aligned n-grams, their probabilities, and weighted rewrite rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import text
from linewright.functions.align import count_confusions, counted
from linewright.functions.codes import codes, count_runs, spread, starts
from linewright.functions.tables import saved
from linewright.functions.text import GAP, VISIBLE_GAP, characters, strip_gaps
from linewright.functions.workers import map_batches

#: Rules that weigh more are left out.
RULE_WEIGHT = 7.0


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (ocr, gt) with text on both sides that are not too different; text that holds the gap's character is an error."""
    held = F.col("ocr").contains(GAP) | F.col("gt").contains(GAP)
    checked = F.when(held, F.raise_error("the gap's character U+E000 stands in a text").cast("string")).otherwise(F.col("ocr"))
    return pairs.where((F.col("ocr") != "") & (F.col("gt") != "")).withColumn("ocr", checked).where(~text.too_different(F.col("ocr"), F.col("gt")))


def confusions(pairs: DataFrame, max_n: int = 3) -> DataFrame:
    """n, raw, gt, cnt over the alignments of all usable pairs."""
    return count_confusions(usable_pairs(pairs), max_n)


def _places(held, batch, max_n: int) -> None:
    first, second = codes(batch.column(0)), codes(batch.column(1))
    sizes = [np.diff(first[2]), np.diff(second[2])]
    wide = starts(np.where(np.minimum(*sizes) > 0, np.maximum(*sizes), 0))
    sides = []
    for _, points, start in (first, second):
        side, row = np.full(wide[-1], ord(GAP), np.int64), spread(start)
        used = np.diff(wide)[row] > 0
        side[(np.arange(len(points)) - start[row] + wide[row])[used]] = points[used]
        sides.append(side)
    count_runs(held, sides, wide, max_n)


def positional_confusions(pairs: DataFrame, max_n: int = 3) -> DataFrame:
    """n, raw, gt, cnt place by place from the left, the shorter text followed by gaps; pairs without text on a side are left out."""
    return map_batches(pairs.select("ocr", "gt"), counted, "n int, raw string, gt string, cnt long", _places, max_n).groupBy("n", "raw", "gt").agg(F.sum("cnt").alias("cnt"))


def probabilities(counts: DataFrame) -> DataFrame:
    """n, raw, gt, prob: share of gt among what raw was confused with. Counts are saved, as they are looked at twice.

    No character is also confused with no character, wherever nothing was inserted: so the single gap, if it was ever
    inserted at, has as many occurrences as its n has places.
    """
    counts, gap = saved(counts), F.col("raw") == GAP
    idle = counts.groupBy("n").agg(F.sum("cnt").alias("places"), F.sum(F.when(gap, F.col("cnt"))).alias("inserted")).where("inserted > 0")
    idle = idle.select("n", F.lit(GAP).alias("raw"), F.lit(GAP).alias("gt"), (F.col("places") - F.col("inserted")).alias("cnt"))
    every = counts.select("n", "raw", "gt", "cnt").unionByName(idle)
    return every.select("n", "raw", "gt", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy("n", "raw"))).alias("prob"))


def rules(probs: DataFrame, max_weight: float = RULE_WEIGHT, identity: bool = False, keep_punctuation: bool = False) -> DataFrame:
    """n, raw, gt, weight from (n, raw, gt, prob): -ln of the probability, gaps removed.

    Left out are rules that weigh more than max_weight, that change nothing (unless identity), that are empty on both sides,
    and, with keep_punctuation, that would put or change punctuation.
    """
    some = probs.where(text.no_punctuation_edits(F.col("raw"), F.col("gt"))) if keep_punctuation else probs
    some = some.where("prob > 0").select("n", strip_gaps(F.col("raw")).alias("raw"), strip_gaps(F.col("gt")).alias("gt"), (-F.ln("prob")).alias("weight"))
    some = some.where((F.col("weight") <= max_weight) & ((F.col("raw") != "") | (F.col("gt") != "")))
    return some if identity else some.where("raw <> gt")


def combine(rules_: DataFrame, min_context: int = 1, max_context: int = 3) -> DataFrame:
    """raw, gt, weight: the rules of a range of n-gram lengths, the lightest of equal ones."""
    return rules_.where(F.col("n").between(min_context, max_context)).groupBy("raw", "gt").agg(F.min("weight").alias("weight"))


def contexts(max_context: int = 3) -> list[tuple[int, int]]:
    """Every range of n-gram lengths that combine() may be asked for."""
    return [(low, high) for high in range(1, max_context + 1) for low in range(1, high + 1)]


def train(pairs: DataFrame, min_context: int = 1, max_context: int = 3, keep_punctuation: bool = False, max_weight: float = RULE_WEIGHT) -> DataFrame:
    """raw, gt, weight learnt from pairs (ocr, gt)."""
    return combine(rules(probabilities(confusions(pairs, max_context)), max_weight, keep_punctuation=keep_punctuation), min_context, max_context)


def alphabet(rules_: DataFrame) -> DataFrame:
    """symbol: the characters that rules (raw, gt) know."""
    return rules_.select(F.explode(F.array_union(characters(F.col("raw")), characters(F.col("gt")))).alias("symbol")).distinct()


def show_gaps(rows: DataFrame) -> DataFrame:
    """raw, gt, prob as frequency list files have them."""
    swap = lambda c: F.replace(F.col(c), F.lit(GAP), F.lit(VISIBLE_GAP)).alias(c)
    return rows.select(swap("raw"), swap("gt"), "prob")
