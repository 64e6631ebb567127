"""Text primitives and alignment: small cases by hand, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewright.functions import align, text

WORDS = st.text(alphabet="abäoöͤ en", max_size=12)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_alignment_projects_back(a, b):
    pairs = align.align(a, b)
    assert "".join(x for x, _ in pairs if x is not None) == a and "".join(y for _, y in pairs if y is not None) == b
    assert (None, None) not in pairs


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_distances(a, b):
    assert align.adjusted_distance(a, a) == 0
    assert 0 <= align.adjusted_distance(a, b) <= 2 * max(len(a), len(b))
    assert align.edit_outcomes(a, b, a)[0] == 0 and align.edit_outcomes(a, a, a) == (0, len(a), 0, 0)


@pytest.mark.parametrize(("a", "b", "d"), [
    ("schön", "schoͤn", 1), ("schoͤn", "schön", 1), ("schön", "schon", 1), ("ä", "a", 1), ("äb", "ac", 2), ("Haus", "Haua", 1), ("abc", "", 3), ("", "", 0),
])
def test_umlaut_distance(a, b, d):
    assert align.adjusted_distance(a, b) == d


def test_outcomes_of_spurious_characters():
    # the character that both versions have and truth lacks is deleted rightly by one and inserted wrongly by the other
    assert align.edit_outcomes("axb", "axb", "ab") == (1, 2, 1, 0)
    assert align.edit_outcomes("tbe", "the", "the") == (1, 2, 0, 0)
    assert align.edit_outcomes("tbe", "tbe", "the") == (0, 2, 0, 1)
    assert align.edit_outcomes("", "", "abc") == (0, 0, 0, 3)


def column(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_words(spark):
    assert column(spark, text.whitespace_tokens, " a  b c\n", "", None) == [["a", "b", "c"], [], None]
    assert column(spark, text.language_tokens, "Die «3.000» Häuser—und/oder 1st's, e-mail... (ja)") == [["Die", "«", "3.000", "»", "Häuser", "—", "und", "/", "oder", "1st's", ",", "e-mail", "...", "(", "ja", ")"]]
    assert column(spark, text.token_class, "\"", "»", "«", "'", ",", "—", "a", "3") == ["open", "open", "close", "close", "punct", "word", "word", "word"]
    assert column(spark, text.mask_number, "1st", "12,5", "x1", "٣٤") == ["111", "1111", "x1", "11"]
    assert column(spark, text.case_variant, "Haus", "haus", "ßa", "HAUS", "é") == ["haus", "Haus", "Ssa", "haus", "É"]
    assert column(spark, text.decompose_umlauts, "Äö") == ["Aͤoͤ"]
    assert column(spark, text.escape_automaton, "a[b]\\c") == ["a\\[b\\]\\\\c"]
    assert column(spark, text.strip, "  a b \t\n") == ["a b"] and column(spark, text.rstrip, " a ") == [" a"]
    assert column(spark, text.identifier_decade, "x/kant_1784", "x/kant", "a_17/b", "", None) == [179, 0, 0, 0, 0]
    assert column(spark, text.long_enough, "ab", "abc") == [False, True]


def test_punctuation_edits(spark):
    g = text.GAP
    cases = [("a", "a", False), (g, " ", False), (" ", g, False), (",", "a", False), ("a", g, False), ("a", " ", False), ("a", ",", True), (",", ".", True), (",", g, True), (g, ",", True), ("ͤ", g, False), (",", "ͤ", False)]
    rows = spark.createDataFrame(cases, "r string, t string, want boolean")
    assert rows.where(text.is_punctuation_edit(F.col("r"), F.col("t")) != F.col("want")).count() == 0
    two = spark.createDataFrame([("ab", "a,"), ("a,", "ab")], "r string, t string")
    assert [r.x for r in two.select(text.no_punctuation_edits(F.col("r"), F.col("t")).alias("x")).collect()] == [False, True]


def test_ratio(spark):
    from difflib import SequenceMatcher

    pairs = [("abc", "abd"), ("", ""), ("aab", "ab"), ("xyz", "abcdefg")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r.x for r in rows.select(text.quick_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([SequenceMatcher(None, a, b, autojunk=False).quick_ratio() for a, b in pairs])
