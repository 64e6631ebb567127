"""Measuring corrections: joins of the three versions of each line, error rates, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.align import with_adjusted_distance, with_outcomes
from linewright.functions.text import strip

METRICS = ("Levenshtein", "combining-e-umlauts", "precision-recall")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key with the value of the highest order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def join_pairs(ocr: DataFrame, gt: DataFrame) -> DataFrame:
    """line_id, ocr, gt for the lines that both (line_id, text) have."""
    return ocr.select("line_id", F.col("text").alias("ocr")).join(gt.select("line_id", F.col("text").alias("gt")), "line_id")


def missing_lines(gt: DataFrame, other: DataFrame) -> DataFrame:
    """line_id of ground truth that the other lacks."""
    return gt.select("line_id").join(other.select("line_id"), "line_id", "left_anti")


def _there(c: str, key: str) -> Column:
    return F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"no {c} line for "), F.col(key).cast("string"))).cast("string"))


def join_triples(ocr: DataFrame, cor: DataFrame, gt: DataFrame, strict: bool = True) -> DataFrame:
    """line_id, ocr, cor, gt, stripped, for every ground truth line; a missing version is an error, or, not strict, drops the line.

    The three are joined on one key, so they are shuffled once each.
    """
    how = "left" if strict else "inner"
    of = lambda df, c: df.select("line_id", strip(F.col("text")).alias(c))
    rows = of(gt, "gt").join(of(ocr, "ocr"), "line_id", how).join(of(cor, "cor"), "line_id", how)
    return rows.select("line_id", *[_there(c, "line_id").alias(c) if strict else c for c in ("ocr", "cor")], "gt")


def line_edits(triples: DataFrame, metric: str = "combining-e-umlauts") -> DataFrame:
    """triples with edits_ocr, edits_cor, len_gt, and the rates cer_ocr, cer_cor, null for an empty ground truth."""
    if metric == "Levenshtein":
        rows = triples.withColumns({"edits_ocr": F.levenshtein("ocr", "gt").cast("long"), "edits_cor": F.levenshtein("cor", "gt").cast("long")})
    else:
        rows = with_adjusted_distance(with_adjusted_distance(triples, "ocr", "gt", "edits_ocr"), "cor", "gt", "edits_cor")
    rows = rows.withColumn("len_gt", F.length("gt").cast("long"))
    return rows.withColumns({f"cer_{x}": F.try_divide(f"edits_{x}", "len_gt") for x in ("ocr", "cor")})


def error_rates(triples: DataFrame, metric: str = "combining-e-umlauts") -> DataFrame:
    """One row: edits_ocr, len_ocr, edits_cor, len_cor (both the ground truth's), cer_ocr, cer_cor over all characters."""
    sums = line_edits(triples, metric).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("edits_ocr", "edits_cor", "len_gt")])
    return sums.select("edits_ocr", F.col("len_gt").alias("len_ocr"), "edits_cor", F.col("len_gt").alias("len_cor"), F.try_divide("edits_ocr", "len_gt").alias("cer_ocr"), F.try_divide("edits_cor", "len_gt").alias("cer_cor"))


def rates(counts: DataFrame) -> DataFrame:
    """counts (tp, tn, fp, fn) with precision, recall, f1, tpr, fpr, auc.

    Nothing found and nothing to find make 1, no negatives a false positive rate of 0; f1 is null without positives.
    """
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    part = lambda x, whole, empty: F.coalesce(F.try_divide(x, whole), F.lit(float(empty)))
    precision, recall, miss = part(tp, tp + fp, 1), part(tp, tp + fn, 1), part(fp, fp + tn, 0)
    area = 0.5 * recall * miss + recall * (1 - miss) + 0.5 * (1 - recall) * (1 - miss)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "tpr": recall, "fpr": miss, "auc": area})


def line_outcomes(triples: DataFrame) -> DataFrame:
    """triples with tp, tn, fp, fn and the rates of each line."""
    return rates(with_outcomes(triples, "ocr", "cor", "gt"))


def precision_recall(triples: DataFrame) -> DataFrame:
    """One row: summed tp, tn, fp, fn and their rates."""
    return rates(with_outcomes(triples, "ocr", "cor", "gt").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "tn", "fp", "fn")]))
