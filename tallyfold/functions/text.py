"""Column expressions over text: trimming, n-gram sets, set similarity, rounding as Python does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character Python's ``str.strip`` drops.
WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends; only the ends are looked at."""
    return F.trim(text, F.lit(WHITE_SPACE))


def ngrams(text: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the whole text; empty for a text shorter than n.

    One regular expression walks over the text a character at a time and looks n characters ahead,
    so the work is linear in the length of the text.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def jaccard(left: Column, right: Column) -> Column:
    """Size of the intersection over size of the union of two sets; 0 if either is empty."""
    shared, sizes = F.size(F.array_intersect(left, right)), (F.size(left), F.size(right))
    return F.when((sizes[0] == 0) | (sizes[1] == 0), F.lit(0.0)).otherwise(shared / (sizes[0] + sizes[1] - shared))


def python_round(number: Column, digits: int) -> Column:
    """Round the binary value half to even, as Python's ``round`` does.

    ``round`` and ``bround`` look at the shortest decimal text of a double and so see ties that the
    binary value does not have; ``format_number`` rounds the value itself.
    """
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit("")).cast("double")
