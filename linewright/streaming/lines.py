"""Streams of lines: the same operators over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from linewright.operators import evaluate, lattice


def measure(triples: DataFrame, metric: str = "Levenshtein") -> DataFrame:
    """Edits of each line of a stream of triples (ocr, cor, gt); a line needs no other, so nothing is kept."""
    return evaluate.line_edits(triples, metric)


def correct(lines: DataFrame, rules: DataFrame, lexicon: DataFrame, path: str, **options) -> DataStreamWriter:
    """A writer that corrects lines (line_id, text) of each micro-batch into Parquet, one folder per batch.

    A batch that runs again after a failure replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        lattice.correct(batch, rules, lexicon, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(write)
