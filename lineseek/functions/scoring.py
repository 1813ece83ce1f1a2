"""Score formulas. A score depends on the query length and the edit, never on the line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Penalty by 1-based position; the last one holds for every later position.
SUBSTITUTION_PENALTIES = (5, 4, 3, 2, 1)
INDEL_PENALTIES = (10, 8, 6, 4, 2)
# From this position on the penalty no longer changes.
LAST_POSITION = 5
# Different scores that one query can have: unchanged, substituted, missing and surplus.
SCORES = 1 + len(SUBSTITUTION_PENALTIES) + 2 * len(INDEL_PENALTIES)


def _penalty(table: tuple[int, ...], position: Column) -> Column:
    by_position = F.element_at(
        F.array(*[F.lit(value) for value in table]), F.least(position, F.lit(len(table)))
    )
    refused = F.raise_error(
        F.concat(F.lit("a place in a text counts from 1, not "), position.cast("string"))
    ).cast("int")
    return F.when(position >= 1, by_position).otherwise(refused)


def substitution_penalty(position: Column) -> Column:
    return _penalty(SUBSTITUTION_PENALTIES, position)


def indel_penalty(position: Column) -> Column:
    return _penalty(INDEL_PENALTIES, position)


def edit_penalty(indel: Column, position: Column) -> Column:
    """Penalty of an edit at a position already known to lie in 1..LAST_POSITION."""
    both = F.array(*[F.lit(value) for value in SUBSTITUTION_PENALTIES + INDEL_PENALTIES])
    return F.element_at(both, F.when(indel, position + len(SUBSTITUTION_PENALTIES)).otherwise(position))


def score_exact(length: Column) -> Column:
    return length * 2


def score_substitution(length: Column, position: Column) -> Column:
    return (length - 1) * 2 - substitution_penalty(position)


def score_extra_char(length: Column, position: Column) -> Column:
    """`position` is the place of the surplus character in the query."""
    return (length - 1) * 2 - indel_penalty(position)


def score_missing_char(length: Column, position: Column) -> Column:
    """`position` is the place the inserted character takes in the corrected text."""
    return length * 2 - indel_penalty(position)


def edit_position(window: Column, query: Column) -> Column:
    """First position where two texts differ, with all from LAST_POSITION on as one.

    When `window` is `query` with one edit, this is the latest place the edit can be
    said to sit, and so the one with the lowest penalty.
    """
    shared = F.lit(1)
    for size in range(1, LAST_POSITION):
        same = F.left(window, F.lit(size)) == F.left(query, F.lit(size))
        shared = shared + (same & (F.length(query) >= size)).cast("int")
    return shared
