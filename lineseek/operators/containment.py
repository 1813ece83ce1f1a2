"""Exact substring search: all pairs of a pattern and a line that contains it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.operators import seeding
from lineseek.runtime import broadcast_if_small, materialize


# Patterns of so few characters stand at so many places that each line is asked for each of them
# instead, where no more than so many are looked for.
BRIEF, BRIEF_ROWS = 2, 64


def find_containing(
    lines: DataFrame,
    patterns: DataFrame,
    *,
    text: str = "normalized_sentence",
    keep: tuple[str, ...] | None = None,
    seed_rows: int = seeding.SEED_ROWS,
) -> DataFrame:
    """Join `patterns` (`pattern` and any other columns) to the lines whose `text` contains the pattern.

    Returns the `keep` columns of `lines` (all by default) and those of `patterns`, each pair of a
    line and a distinct row of `patterns` once, however often the line holds it. Empty patterns
    match nothing. Nothing of the lines is shuffled. Few patterns are broadcast, and so are the
    short ones among many, which stand nearly everywhere. Of the others, the texts that stand in
    lines are stored; only the patterns that are among these are moved. For many patterns, the
    lines are read up to three times.
    """
    keep = tuple(lines.columns) if keep is None else keep
    named = patterns.where(F.col("pattern") != "")
    if _are_few(named, seed_rows):
        return _meet_few(lines, named, text, keep)
    is_short = F.length("pattern") < seeding.SEED_WIDTHS[-1]
    short = named.where(is_short)
    if not _are_few(short, seed_rows):
        return _meet_many(lines, named, text, keep)
    found = _meet_many(lines, named.where(~is_short), text, keep)
    short = materialize(short.distinct())
    is_brief = F.length("pattern") <= BRIEF
    if 0 < short.where(is_brief).count() <= BRIEF_ROWS:
        found = found.unionByName(_meet_each(lines, short.where(is_brief), text, keep))
        short = short.where(~is_brief)
    return found.unionByName(_meet_few(lines, short, text, keep))


def _are_few(patterns: DataFrame, seed_rows: int) -> bool:
    """Whether the patterns may be broadcast; no more than that many are counted."""
    size = patterns.limit(seed_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars")
    )
    found = size.first()
    return found["rows"] <= seed_rows and found["chars"] <= seeding.SEED_CHARS


def _meet_few(lines: DataFrame, patterns: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    seeds = materialize(seeding.choose_seeds(patterns.distinct(), "pattern"))
    widths = seeding.measure(seeds, "pattern").widths
    if not widths:
        return _no_pairs(lines, patterns, keep)
    start = F.col("_pos") - F.col("seed_offset")
    here = seeding.cut(start, F.length("pattern")) == F.col("pattern")
    met = seeding.meet(lines, text, seeds, "pattern", seeding.Measured(True, widths)).where(here)
    return met.where(_is_first(F.col("pattern"), start)).select(*keep, *patterns.columns)


def _meet_each(lines: DataFrame, patterns: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    met = lines.join(F.broadcast(patterns), F.contains(F.col(text), F.col("pattern")))
    return met.select(*keep, *patterns.columns)


def _meet_many(lines: DataFrame, patterns: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    lengths = patterns.agg(F.collect_set(F.length("pattern")).alias("lengths")).first()["lengths"]
    if not lengths:
        return _no_pairs(lines, patterns, keep)
    places = seeding.stand(lines, text, patterns, "pattern", tuple(lengths), _is_first)
    # Each text that stands in a line once, and a few that are no pattern.
    stored = materialize(places.select(*keep, F.col("_text").alias("pattern")))
    texts = broadcast_if_small(materialize(stored.select("pattern").distinct()))
    wanted = materialize(patterns.join(texts, "pattern", "left_semi").distinct())
    return stored.join(broadcast_if_small(wanted), "pattern").select(*keep, *patterns.columns)


def _no_pairs(lines: DataFrame, patterns: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return lines.select(*keep).limit(0).crossJoin(patterns.limit(0))


def _is_first(pattern: Column, start: Column) -> Column:
    """Whether `pattern`, which stands at `start` of its line, stands nowhere before.

    In a long line the places of one run are compared among themselves first, so that it is
    looked through once for each run and not once for each place. (The text before is cut out
    and asked whether it contains the pattern: `locate` compares at every place, this only
    where the first character is the same.)
    """
    run = seeding.POSITION_RUN
    begin = start - (start - 1) % run
    before = lambda first: F.contains(seeding.cut(first, start - first + F.length(pattern) - 1), pattern)
    return ((F.col("_length") <= run) | ~before(begin)) & ~before(F.lit(1))
