"""Lines with made-up recognition errors from the documents table: what the queries run over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions.text import whitespace_tokens

TOKENS_PER_LINE = 8
#: What a text is misread as, in this order.
MISREAD = [("th", "tb"), ("ch", "<h"), ("nn", "un"), ("en ", "cn ")]
#: What a correction puts right again.
REPAIRED = [("tb", "th"), ("<h", "ch")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _chain(c: Column, changes: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), changes, c)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, doc_id, chunk, gt: every document's tokens, eight to a line; each document is cut where it is read."""
    docs = documents(spark, sf_dir).select("doc_id", whitespace_tokens(F.col("text")).alias("t")).where("size(t) > 0")
    count = F.ceil(F.size("t") / F.lit(TOKENS_PER_LINE)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk"), F.array_join(F.slice("t", i * TOKENS_PER_LINE + 1, TOKENS_PER_LINE), " ").alias("gt")))
    rows = docs.select("doc_id", F.inline(cut))
    return rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk").cast("string")).alias("line_id"), "doc_id", "chunk", "gt")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, ocr, cor, gt; every fourth line of a document is without errors."""
    rows = lines(spark, sf_dir)
    ocr = F.when(F.col("chunk") % 4 == 0, F.col("gt")).otherwise(_chain(F.col("gt"), MISREAD))
    return rows.select("line_id", ocr.alias("ocr"), _chain(ocr, REPAIRED).alias("cor"), "gt")


def keyed(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """line_id, text of one version."""
    return triples(spark, sf_dir).select("line_id", F.col(column).alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, ocr, gt."""
    return triples(spark, sf_dir).select("line_id", "ocr", "gt")
