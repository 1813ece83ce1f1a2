"""Finding many short texts inside many lines with one hash lookup per character.

A text longer than a few characters is looked up by one *seed*: a piece of it of a
fixed width. Every line offers the pieces at all its positions; pieces and seeds meet
on a 64-bit key and the rest of the text is then compared at the position the meeting
gives. Work grows with the characters of the lines plus the meetings, not with lines
times texts.

The lines are read once, however many texts there are. Few seeds are measured and
broadcast. Of many seeds only a membership filter of fixed size is: pieces that it lets
through are sent on, with as much of the line as their seeds could need, and meet the
seeds in a salted shuffle join.

Where the texts themselves are looked for, two such filters do without seeds: one of the
texts' beginnings says where in a line a text may begin and how long it may be, one of the
whole texts whether it stands there (`stand`). Neither the texts nor the lines are moved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED_WIDTHS = (1, 2, 3, 4, 6, 8)
POSITION_RUN = 4096
# About as many windows of a text are compared when its seed is chosen.
WINDOWS = 8
# Seeds up to this many rows and characters of text are broadcast as they are.
SEED_ROWS = 200_000
SEED_CHARS = 64_000_000
# Bits of the membership filter, and how many words of 64 of them are broadcast as one row.
FILTER_BITS = 1 << 26
WORDS_PER_ROW = 1 << 10
# Parts that the pieces of one key are dealt to.
SALTS = 4
# Bits that a text sets in its word of a filter of texts, and how many such a filter has for each of
# them: as few as will do, since a small filter stays in the processor's cache.
TEXT_BITS = 4
BITS_PER_TEXT = 12


def seed_width(length: Column) -> Column:
    """Widest seed that fits in a piece of `length` characters."""
    width = F.when(length >= SEED_WIDTHS[-1], F.lit(SEED_WIDTHS[-1]))
    for candidate in reversed(SEED_WIDTHS[:-1]):
        width = width.when(length >= candidate, F.lit(candidate))
    return width


def seed_key(width: Column, piece: Column) -> Column:
    """Join key of a piece. A hash clash costs one comparison and never a wrong row."""
    return F.xxhash64(width, piece)


def choose_seeds(pieces: DataFrame, text: str) -> DataFrame:
    """Add `seed_width`, `seed_key` and `seed_offset` (from 0) to each distinct row.

    The seed is the window of `text` which fewest of the other rows share, so that a phrase
    common to many texts does not put them all behind one key. Of a long text only some
    windows, evenly spaced, are considered; any window gives the same results.
    """
    columns = pieces.columns
    last = F.length(text) - F.col("seed_width")
    step = F.greatest(F.lit(1), F.expr(f"int((length({text}) - seed_width) div {WINDOWS})"))
    windows = (
        pieces.withColumn("seed_width", seed_width(F.length(text)))
        .withColumn("_offset", F.explode(F.sequence(F.lit(0), last, step)))
        .withColumn(
            "seed_key",
            seed_key(
                F.col("seed_width"),
                F.substring(F.col(text).cast("binary"), F.col("_offset") + 1, F.col("seed_width")),
            ),
        )
    )
    shared = windows.groupBy("seed_key").agg(F.count(F.lit(1)).alias("_shared"))
    # Planned from the size of `pieces`, which says nothing of its windows, all counts would be broadcast.
    return (
        windows.join(shared.hint("merge"), "seed_key")
        .groupBy(*columns, "seed_width")
        .agg(F.min(F.struct("_shared", "_offset", "seed_key")).alias("_pick"))
        .select(
            *columns,
            "seed_width",
            F.col("_pick.seed_key").alias("seed_key"),
            F.col("_pick._offset").alias("seed_offset"),
        )
    )


@dataclass(frozen=True)
class Measured:
    """Whether a table of seeds is small enough to broadcast, and the seed widths it needs."""

    small: bool
    widths: tuple[int, ...]


def measure(
    seeds: DataFrame, text: str, seed_rows: int = SEED_ROWS, seed_chars: int = SEED_CHARS
) -> Measured:
    """Measure `seeds` (columns `text`, `seed_width`) with one small aggregate."""
    found = seeds.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"),
        F.collect_set("seed_width").alias("widths"),
    ).first()
    small = found["rows"] <= seed_rows and found["chars"] <= seed_chars
    return Measured(small, tuple(sorted(found["widths"])))


def pieces_of(lines: DataFrame, text: str, widths: tuple[int, ...]) -> DataFrame:
    """One row per (line, position, width) with the piece's key.

    Normalized text is ASCII, so it is cut as bytes: cutting bytes at a position takes
    constant time, cutting a string walks to the position first and would make a long
    line cost the square of its length.
    """
    sized = lines.withColumn("_bytes", F.col(text).cast("binary")).withColumn(
        "_length", F.length(text)
    )
    narrowest = min(widths)
    last = F.col("_length") - (narrowest - 1)
    # Positions come in runs, so that no list of them grows with the line.
    run_end = F.least(F.col("_run") + (POSITION_RUN - 1), last)
    placed = (
        sized.where(last >= 1)
        .withColumn("_run", F.explode(F.sequence(F.lit(1), last, F.lit(POSITION_RUN))))
        .withColumn("_pos", F.explode(F.sequence(F.col("_run"), run_end)))
        .drop("_run")
    )
    if len(widths) == 1:
        width = F.lit(narrowest)
    else:
        placed = placed.withColumn("_width", F.explode(F.array(*[F.lit(w) for w in widths])))
        width = F.col("_width")
        placed = placed.where(F.col("_pos") + width <= F.col("_length") + 1)
    return placed.withColumn(
        "_key", seed_key(width, F.substring(F.col("_bytes"), F.col("_pos"), width))
    )


def cut(start: Column, length: Column) -> Column:
    """Text at a position of the line; NULL where the start lies before the line."""
    return F.when(
        start >= 1, F.substring(F.col("_bytes"), start, length).cast("string")
    )


def meet(
    lines: DataFrame, line_text: str, seeds: DataFrame, text: str, measured: Measured
) -> DataFrame:
    """Every place of a line where a seed of `seeds` may stand, with the seed's columns.

    The lines' columns stay, and `_bytes` and `_pos` say where: a part of the line that is
    wide enough for the seed's whole `text` with one character more on either side.
    """
    pieces = pieces_of(lines, line_text, measured.widths)
    on_key = F.col("_key") == F.col("seed_key")
    if measured.small:
        return pieces.join(F.broadcast(seeds), on_key)
    # In turn, so that no key and no place in a line decides.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    sent = _let_through(pieces, seeds, text).withColumn("_salt", salt)
    dealt = seeds.withColumn("_seed_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = sent.join(dealt, on_key & (F.col("_salt") == F.col("_seed_salt")))
    return met.drop("_salt", "_seed_salt")


def _let_through(pieces: DataFrame, seeds: DataFrame, text: str) -> DataFrame:
    """Pieces whose key may be a seed's; `_bytes` is cut to what those seeds could need.

    One bit per key, 64 to a word and WORDS_PER_ROW words to a row, so that what is broadcast is
    a thousand rows of plain numbers, some 16 MB, however many seeds there are. A bit set by other
    keys lets a piece through in vain and never keeps one back.
    """
    bit = lambda key: F.pmod(F.col(key), F.lit(FILTER_BITS))
    words = (
        seeds.withColumn("_bit", bit("seed_key"))
        .groupBy(F.expr("shiftright(_bit, 6)").alias("_word"))
        .agg(
            F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("bits"),
            (F.max("seed_offset") + 1).alias("before"),
            (F.max(F.length(text) - F.col("seed_offset")) + 1).alias("after"),
        )
    )
    # Words without a seed are there too, so that a word is found by its place.
    empty = seeds.sparkSession.range(FILTER_BITS // 64).select(
        F.col("id").alias("_word"), F.lit(0).cast("long").alias("bits"), F.lit(0).alias("before"), F.lit(0).alias("after")
    )
    filled = words.unionByName(empty).groupBy("_word").agg(*[F.max_by(c, F.col("after")).alias(c) for c in ("bits", "before", "after")])
    known = (
        filled.groupBy(F.expr(f"_word div {WORDS_PER_ROW}").alias("_row"))
        .agg(F.sort_array(F.collect_list(F.struct("_word", "bits", "before", "after"))).alias("_w"))
        .select("_row", *[F.col(f"_w.{c}").alias(f"_{c}") for c in ("bits", "before", "after")])
    )
    met = pieces.withColumn("_bit", bit("_key")).withColumn("_at", F.expr("shiftright(_bit, 6)"))
    met = met.withColumn("_in_row", (F.col("_at") % WORDS_PER_ROW).cast("int"))
    met = met.join(F.broadcast(known), F.expr(f"_at div {WORDS_PER_ROW}") == F.col("_row")).where(
        F.expr("shiftright(_bits[_in_row], cast(_bit & 63 as int)) & 1L = 1L")
    )
    met = met.withColumn("_before", F.expr("_before[_in_row]")).withColumn("_after", F.expr("_after[_in_row]"))
    begin = F.greatest(F.lit(1), F.col("_pos") - F.col("_before"))
    return (
        met.withColumn("_begin", begin)
        .withColumn(
            "_bytes",
            F.substring(F.col("_bytes"), F.col("_begin"), F.col("_pos") - F.col("_begin") + F.col("_after")),
        )
        .withColumn("_pos", F.col("_pos") - F.col("_begin") + 1)
        .drop("_bit", "_at", "_in_row", "_row", "_bits", "_before", "_after", "_begin", "_length", "_width")
    )


def stand(
    lines: DataFrame, line_text: str, texts: DataFrame, text: str, lengths: tuple[int, ...], also: Callable[[Column, Column], Column]
) -> DataFrame:
    """Every place `_pos` of a line where one of many `texts` may stand, as `_text`, with the columns of `pieces_of`.

    `lengths` are those of the texts. Of a text and its place `also` is asked, once the filters let
    them through. A text that is none of them may come too, about once in a thousand
    places; none that is one of them is kept back.
    """
    whole = F.col(text).cast("binary")
    width = seed_width(F.length(text))
    begins = texts.select(
        seed_key(width, F.substring(whole, F.lit(1), width)).alias("_key"),
        F.expr(f"shiftleft(1L, length({text}) & 63)").alias("_lengths"),
    )
    widths = {n: max(w for w in SEED_WIDTHS if w <= n) for n in lengths}
    used = tuple(sorted(set(widths.values())))
    begun = _members(pieces_of(lines, line_text, used), filter_of(begins, "_lengths"))
    # By a place whose beginning fits, only the lengths that are there with such a beginning.
    sizes = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(w).alias("width")) for n, w in sorted(widths.items())])
    sized = begun.select("*", F.inline(sizes)).where(
        F.expr("shiftright(_lengths, size & 63) & 1L = 1L") & (F.col("_pos") + F.col("size") <= F.col("_length") + 1)
    )
    if len(used) > 1:
        sized = sized.where(F.col("width") == F.col("_width"))
    piece = F.substring(F.col("_bytes"), F.col("_pos"), F.col("size"))
    cut_out = sized.drop("_key", "_lengths").withColumn("_key", F.xxhash64(piece))
    wholes = filter_of(texts.select(F.xxhash64(whole).alias("_key")))
    found = _members(cut_out, wholes, also(piece.cast("string"), F.col("_pos")))
    return found.withColumn("_text", piece.cast("string")).drop("_key", "size", "width")


@dataclass(frozen=True)
class Filter:
    """A membership filter: rows of WORDS_PER_ROW words of 64 bits, and how many words there are."""

    rows: DataFrame
    words: int


def filter_of(keys: DataFrame, *masks: str) -> Filter:
    """The membership filter of `_key`, of FILTER_BITS at most; `masks` of a word's keys are joined.

    A key sets up to TEXT_BITS bits of one word. The words without a key are there too, so that a word is found by its place.
    """
    distinct = keys.agg(F.approx_count_distinct("_key")).first()[0]
    count = WORDS_PER_ROW
    while count < FILTER_BITS // 64 and count * 64 < distinct * BITS_PER_TEXT:
        count *= 2
    words = keys.select(F.expr(f"_key & {count - 1}L").alias("_word"), F.expr(_own_bits()).alias("bits"), *masks)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("bits", *masks)]
    empty = keys.sparkSession.range(count).select(F.col("id").alias("_word"), *nothing)
    filled = words.unionByName(empty).groupBy("_word").agg(*[F.bit_or(c).alias(c) for c in ("bits", *masks)])
    rows = (
        filled.groupBy(F.expr(f"_word div {WORDS_PER_ROW}").alias("_row"))
        .agg(F.sort_array(F.collect_list(F.struct("_word", "bits", *masks))).alias("_w"))
        .select("_row", *[F.col(f"_w.{c}").alias(f"{c}_of") for c in ("bits", *masks)])
    )
    return Filter(rows, count)


def _own_bits() -> str:
    """The bits that a `_key` sets. Its lowest bits name the word, others the bits in it."""
    return " | ".join(f"shiftleft(1L, cast(shiftright(_key, {20 + 6 * n}) & 63 as int))" for n in range(TEXT_BITS))


def _members(rows: DataFrame, members: Filter, also: Column | None = None) -> DataFrame:
    """The rows whose `_key` the filter lets through and of which `also` is true, with the joined masks of its word.

    What is asked besides is one condition with the filter's, or Spark would ask it of all rows before.
    """
    masks = [c.removesuffix("_of") for c in members.rows.columns if c not in ("_row", "bits_of")]
    place = f"cast(_key & {WORDS_PER_ROW - 1}L as int)"
    here = F.expr(f"(_key & {members.words - 1}L) div {WORDS_PER_ROW}") == F.col("_row")
    let_through = F.expr(f"~bits_of[{place}] & ({_own_bits()}) = 0L")
    if also is not None:
        let_through = F.when(let_through, also).otherwise(False)
    met = rows.join(F.broadcast(members.rows), here).where(let_through)
    return met.select(*rows.columns, *[F.expr(f"coalesce({m}_of[{place}], 0L)").alias(m) for m in masks])
