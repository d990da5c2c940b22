"""Opt-in secret columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaksieve.functions.text import group_of_match


def secret_of(line: Column, pattern: Column, group: Column, match: Column) -> Column:
    """Capture ``group`` of the first match; the whole match where no group is set."""
    return F.when(group.isNull() | (group == 0), match).otherwise(
        group_of_match(line, pattern, group)
    )


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text.

    Each distinct character is counted by what its removal does to the length,
    so the work stays in built-in expressions.
    """
    n = F.length(text)
    p = lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n
    return F.aggregate(
        F.array_distinct(F.split(text, "")),
        F.lit(0.0),
        lambda acc, ch: F.when(ch == "", acc).otherwise(acc - p(ch) * F.log2(p(ch))),
    )
