"""Text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at its ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def folded_spaces(c: Column) -> Column:
    """Lower case with every run of white space as one space: the key under which texts count as repeated."""
    return F.lower(F.trim(F.regexp_replace(c, F.lit(r"\s+"), F.lit(" "))))


def tokens(c: Column) -> Column:
    """Lower-case words parted by white space, without empty ones; null gives an empty list."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-case text holds any of the (lower-case) words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out
