"""Lexicons: forms of words, punctuation and brackets with counts and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions import text

#: Forms that are rarer than both are left out.
RARE_COUNT, RARE_SHARE = 3, 2e-6


def tokens(lines: DataFrame) -> DataFrame:
    """token, class of every language token of lines (line) that are long enough."""
    some = lines.where(text.long_enough(F.col("line"))).select(F.explode(text.language_tokens(F.col("line"))).alias("token"))
    return some.select("token", text.token_class(F.col("token")).alias("class"))


def token_problems(lines: DataFrame) -> DataFrame:
    """token, cnt of language tokens of lines (line) that were probably cut wrongly."""
    return problems(tokens(lines))


def problems(tokens_: DataFrame) -> DataFrame:
    """token, cnt of tokens (token) with white space at an end, or with a dash left on."""
    t = F.col("token")
    return tokens_.where(text.outer_whitespace(t) | text.trailing_dash(t)).groupBy("token").agg(F.count("*").alias("cnt"))


def build(lines: DataFrame, word_list: DataFrame | None = None) -> DataFrame:
    """class, form, cnt: counts of lines (line), and of a word list (word, freq), whose words are taken as they are.

    A word also counts for its form with the other case. Tokens are counted before their forms are made, so that every
    distinct token is normalised once.
    """
    counted = tokens(lines).groupBy("class", "token").agg(F.count("*").alias("cnt"))
    form = text.word_form(F.col("token"))
    forms = F.when(F.col("class") == "word", F.array_distinct(F.array(form, text.case_variant(form)))).otherwise(F.array("token"))
    rows = counted.select("class", F.explode(forms).alias("form"), "cnt")
    if word_list is not None:
        rows = rows.unionByName(word_list.select(F.lit("word").alias("class"), F.col("word").alias("form"), F.col("freq").cast("long").alias("cnt")))
    return rows.groupBy("class", "form").agg(F.sum("cnt").alias("cnt"))


def weigh(lexicon: DataFrame, added_word_cost: float = 0.0, unweighted: bool = False, rare_count: int = RARE_COUNT, rare_share: float = RARE_SHARE) -> DataFrame:
    """class, form, weight: -ln of a form's share of its class, rare forms left out after shares are taken.

    Words cost so much more; without weights all are 0, that cost too. Totals are one row per class, four at most, and so
    broadcast.
    """
    totals = lexicon.groupBy("class").agg(F.sum("cnt").alias("total"))
    rows = lexicon.join(F.broadcast(totals), "class").withColumn("share", F.col("cnt") / F.col("total"))
    rows = rows.where(~((F.col("cnt") <= rare_count) & (F.col("share") < rare_share)))
    weight = -F.ln("share") + F.when(F.col("class") == "word", added_word_cost).otherwise(0.0)
    return rows.select("class", "form", (F.lit(0.0) if unweighted else weight).alias("weight"))


def expand_digits(lexicon: DataFrame) -> DataFrame:
    """Weighted forms with every single masked digit replaced by each digit; longer numbers stay masked."""
    digit = F.when((F.col("class") == "word") & (F.col("form") == "1"), F.array(*map(F.lit, text.digits()))).otherwise(F.array("form"))
    return lexicon.select("class", F.explode(digit).alias("form"), "weight")
