"""Defaults of all commands, and models as folders of Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from linewright.operators import em


@dataclass(frozen=True)
class Config:
    """Every parameter that results depend on."""

    error_model: str = "simple"  # or "st", the stochastic transducer
    preserve_punctuation: bool = False
    punctuation: str = "bracket"
    min_context: int = 1
    max_context: int = 3
    max_errors: int = 3
    max_ngrams: int = 1000
    rule_weight: float = 7.0  # of simple rules, at most
    mapping_weight: float = 5.0  # of mappings of the stochastic transducer, less than
    convergence: float = 1e-3
    added_word_cost: float = 0.0
    unweighted_lexicon: bool = False
    max_window: int = 2
    words_per_window: int = 3
    pruning_weight: float = 5.0
    rejection_weight: float = 1.5
    lm_weight: float = 1.0
    lm_beam: int = 3
    page_lm_weight: float = 0.5
    page_lm_beam: int = 100
    lm_order: int = 4
    lm_ngrams: int = 50_000


def save(table: DataFrame, model: str, name: str) -> None:
    table.write.mode("overwrite").parquet(f"{model}/{name}")


def load(spark: SparkSession, model: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{model}/{name}")


def save_transducer(spark: SparkSession, vocab: DataFrame, fitted: em.Transducer, model: str) -> None:
    matrix, lengths = em.to_rows(spark, fitted)
    for name, table in (("vocabulary", vocab), ("matrix", matrix), ("lengths", lengths)):
        save(table, model, name)


def load_transducer(spark: SparkSession, model: str) -> em.Transducer:
    return em.from_rows(*(load(spark, model, name) for name in ("vocabulary", "matrix", "lengths")))
