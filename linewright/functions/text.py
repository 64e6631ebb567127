"""Text primitives as column expressions: tokens, token classes, normal forms, predicates on single characters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linewright.functions.codes import codes, spread
from linewright.functions.workers import reach_workers

# Lists and letters that results depend on.
MIN_LINE_LENGTH = 3
OPENING_BRACKETS = ["\"", "»", "(", "„"]
CLOSING_BRACKETS = ["\"", "«", ")", "“", "‘", "'"]
DASH = "—"
COMBINING_E = "\u0364"
UMLAUTS = {c: base + COMBINING_E for c, base in zip("äöüÄÖÜ", "aouAOU")}

#: Stands for no character in aligned n-grams; a private-use code point, so that no-break spaces stay ordinary text.
GAP = "\ue000"
#: What a gap is written as in frequency list files.
VISIBLE_GAP = "□"

#: Cells that rows by characters may have to be counted as a matrix.
DENSE = 1 << 22

#: Numbers with inner separators; words with inner hyphens or apostrophes; runs of full stops or dashes; any other sign.
#: Em dashes and slashes always stand alone.
TOKEN = r"[0-9]+(?:[.,][0-9]+)+|[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*|\.\.+|--+|[^\s\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def whitespace_tokens(c: Column) -> Column:
    """Array of what stands between Unicode white space; no empty ones; null for null."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def language_tokens(c: Column) -> Column:
    """Array of words, numbers and signs."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def escape_automaton(c: Column) -> Column:
    """Backslash before backslash and square brackets."""
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("\\" + s)), "\\[]", c)


def characters(c: Column) -> Column:
    """Array of code points; empty for an empty text."""
    return F.array_remove(F.split(c, ""), "")


def long_enough(line: Column) -> Column:
    return F.length(line) >= MIN_LINE_LENGTH


def is_opening(c: Column) -> Column:
    return c.isin(OPENING_BRACKETS)


def is_closing(c: Column) -> Column:
    return c.isin(CLOSING_BRACKETS)


def is_punctuation(c: Column) -> Column:
    """Neither letter nor number in it, and not the em dash, which counts as a word."""
    return c.rlike(r"^[^\p{L}\p{N}]+$") & (c != DASH)


def token_class(c: Column) -> Column:
    return F.when(is_opening(c), "open").when(is_closing(c), "close").when(is_punctuation(c), "punct").otherwise("word")


def outer_whitespace(c: Column) -> Column:
    """Whether a token has white space at an end."""
    return strip(c) != c


def trailing_dash(c: Column) -> Column:
    """Whether an em dash was left on a longer token."""
    return (F.length(c) > 1) & c.endswith(DASH)


def decompose_umlauts(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), UMLAUTS.items(), c)


def mask_number(c: Column) -> Column:
    """As many 1s as characters, if it starts with an ASCII digit or has only digits."""
    return F.when(c.rlike(r"^[0-9]|^\p{Nd}+$"), F.repeat(F.lit("1"), F.length(c))).otherwise(c)


def case_variant(c: Column) -> Column:
    """Lower case if it starts upper case, else capitalised; of a letter that has two for a capital only the first is one."""
    capital = F.upper(F.substring(c, 1, 1))
    rest = F.concat(capital.substr(F.lit(2), F.length(capital)), c.substr(F.lit(2), F.length(c)))
    return F.when(c.rlike(r"^\p{Lu}"), F.lower(c)).otherwise(F.concat(F.substring(capital, 1, 1), F.lower(rest)))


def word_form(token: Column) -> Column:
    """The form that a word token is counted as."""
    return mask_number(decompose_umlauts(token))


def _alphanumeric(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}]$")


def is_punctuation_edit(raw: Column, truth: Column) -> Column:
    """Whether replacing raw by truth (characters or GAP) would put or change punctuation.

    Not so for no edit, edits between gap and space, edits to a letter, number or combining e, and edits from these to gap
    or space.
    """
    letter = lambda c: (c == COMBINING_E) | ((c != GAP) & _alphanumeric(c))
    blank = lambda c: c.isin(GAP, " ")
    harmless = (raw == truth) | (blank(raw) & blank(truth)) | letter(truth) | (blank(truth) & letter(raw))
    return ~harmless


def no_punctuation_edits(raw: Column, truth: Column) -> Column:
    """Whether no place of two aligned n-grams is a punctuation edit."""
    return F.forall(F.arrays_zip(characters(raw).alias("r"), characters(truth).alias("t")), lambda p: ~is_punctuation_edit(p["r"], p["t"]))


def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    first, second = codes(a), codes(b)
    rows = len(a)
    kinds, which = np.unique(np.concatenate([first[1], second[1]]), return_inverse=True)
    # of each row and character, how often it stands on each side
    keys = np.concatenate([spread(first[2]), spread(second[2])]) * max(1, len(kinds)) + which.ravel()
    cells, cell = (None, keys) if rows * len(kinds) <= DENSE else np.unique(keys, return_inverse=True)
    n = rows * len(kinds) if cells is None else len(cells)
    left, right = np.bincount(cell[: len(first[1])], minlength=n), np.bincount(cell[len(first[1]) :], minlength=n)
    least = np.minimum(left, right)
    common = least.reshape(rows, len(kinds)).sum(1) if cells is None else np.bincount(cells // len(kinds), least, rows)
    both = np.diff(first[2]) + np.diff(second[2])
    null = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return pa.array(np.where(both == 0, 1.0, 2.0 * common / np.maximum(both, 1)), pa.float64(), mask=null)


def quick_ratio(a: Column, b: Column) -> Column:
    """2 * common characters, counted with repeats and wherever they stand, / all characters; 1 for two empty texts."""
    reach_workers(SparkSession.active())
    return F.arrow_udf(_ratios, "double")(a, b)


def too_different(raw: Column, truth: Column) -> Column:
    """Pairs that are hardly the same line."""
    return (quick_ratio(raw, truth) < 0.1) & (F.length(truth) > 5)


def confidence(weight: Column) -> Column:
    return F.pow(F.lit(2.0), -weight)


def identifier_decade(identifier: Column) -> Column:
    """Decade of the year that a path's last part ends in after an underscore, rounded up; 0 without one."""
    year = F.element_at(F.split(F.element_at(F.split(identifier, "/"), -1), "_"), -1)
    return F.coalesce(F.ceil(F.when(year.rlike(r"^[0-9]{1,9}$"), year).try_cast("long") / 10).cast("long"), F.lit(0))


def perplexities(entropy: Column, n_chars: Column, n_elements: Column) -> dict[str, Column]:
    """From a path's total entropy in bits: mean probability and perplexity of a character, perplexity of an element.

    Null where there is nothing to divide by or the result has no double."""
    per = F.try_divide(entropy, n_chars)
    finite = lambda c: F.when(c < F.lit(float("inf")), c)
    return {"avg": F.pow(F.lit(2.0), -per), "char_ppl": finite(F.pow(F.lit(2.0), per)), "element_ppl": finite(F.pow(F.lit(2.0), F.try_divide(per * n_chars, n_elements)))}


def scientific(c: Column) -> Column:
    """Six digits and an exponent, halves up. What differs after eleven digits, as sums do by their order, makes no difference."""
    return F.format_string("%.5e", F.format_string("%.10e", c).cast("double"))


def digits() -> list[str]:
    """What a masked digit may stand for."""
    return [str(i) for i in range(10)]


def strip_gaps(c: Column) -> Column:
    return F.replace(c, F.lit(GAP), F.lit(""))
