"""Column builders for texts. White space is Unicode's, by one explicit class that Spark and other engines read alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

# The characters that count as white space, the letters that names keep, and the list in an answer.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_LETTERS = "[^a-zA-ZÀ-ÿ ]"
NOT_ALNUM = "[^a-zA-ZÀ-ÿ0-9 ]"
JSON_LIST = r'\[(".*",\s*)*".*"\]'
NAME_LENGTH = 32
BLOCKED = ("fun", "Fun")


def stripped(text: Column) -> Column:
    """text without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def non_empty(text: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(stripped(text), F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased runs without white space."""
    clean = stripped(F.lower(text))
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, f"{SPACE}+"))


def padded(tokens: Column, size: int, pad: str | int, left: bool = True) -> Column:
    """(tokens, mask): the first size tokens, and pad up to that size on the left, as generation needs it, or on the right;
    mask is 1 where a token is and 0 where pad is. Null tokens count as none."""

    def filled(kept: Column) -> Column:
        room = F.lit(size) - F.size(kept)
        marks, blanks = F.transform(kept, lambda t: F.lit(1)), F.array_repeat(F.lit(0), room)
        pads = F.array_repeat(F.lit(pad), room)
        one, two = (F.concat(pads, kept), F.concat(blanks, marks)) if left else (F.concat(kept, pads), F.concat(marks, blanks))
        return F.struct(one.alias("tokens"), two.alias("mask"))

    return let(F.slice(F.coalesce(tokens, F.array()), 1, size), filled)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, NOT_LETTERS, "")


def alnum_only(text: Column) -> Column:
    return F.regexp_replace(text, NOT_ALNUM, "")


def is_full_name(text: Column) -> Column:
    return F.contains(text, F.lit(" ")) & (F.length(text) < NAME_LENGTH)


def is_serious(text: Column) -> Column:
    blocked = F.lit(False)
    for word in BLOCKED:
        blocked = blocked | F.contains(text, F.lit(word))
    return ~blocked


def json_list(text: Column) -> Column:
    """The first JSON array of strings in a text; null if there is none or it doesn't parse."""
    return F.from_json(F.regexp_extract(text, JSON_LIST, 0), "array<string>", {"mode": "PERMISSIVE"})


def preview(text: Column, n: int) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence; a bit for each place of b, a step for each of a."""
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << i)
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & every
    return len(b) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of texts; null if one is null. Arrow batches go to
    common_length(), as no expression does this in less than a step for each pair of places."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(a, b)


def rouge_l(hypothesis: Column, reference: Column) -> Column:
    """F1 of ROUGE-L over words; 0 if either is empty or nothing is common."""
    h, r = words(hypothesis), words(reference)
    return rouge_l_of(lcs_length(h, r), F.size(h), F.size(r))


def rouge_l_of(common: Column, n_hypothesis: Column, n_reference: Column) -> Column:
    total = n_hypothesis + n_reference
    return F.when(total > 0, 2.0 * common / F.when(total > 0, total).otherwise(1)).otherwise(0.0)
