"""Column expressions on text: normalization, tokens, edit pairs, session chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points counted as whitespace besides the space itself, as ranges.
_ODD_WHITESPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x1F),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
ODD_WHITESPACE = "".join(
    chr(point) for first, last in _ODD_WHITESPACE_RANGES for point in range(first, last + 1)
)
# The characters a normalized line may hold besides the space. They are listed
# one by one because Java tests a listed Latin-1 character with one bit lookup, while a
# class of ranges is tested range by range and makes normalizing several times slower.
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789"
# Line terminators: \r\n, a lone \r, or \n.
LINE_TERMINATOR = "\r\n?|\n"
# Fixed value: the marker that clears a typed session.
RESET_MARKER = "#"


def _plain_spaces(text: Column) -> Column:
    return F.translate(text, ODD_WHITESPACE, " " * len(ODD_WHITESPACE))


def normalize(text: Column) -> Column:
    """Lower-case, delete everything but letters, digits and whitespace, squeeze whitespace.

    Deleting before squeezing gives the same text as squeezing on both sides of the
    deletion, with one pass less over every line.
    """
    spaced = _plain_spaces(F.lower(text))
    kept = F.regexp_replace(spaced, f"[^{KEPT} ]", "")
    return F.trim(F.regexp_replace(kept, " {2,}", " "))


def has_content(text: Column) -> Column:
    """True when normalizing the text leaves something; cheaper than doing it."""
    return F.rlike(F.lower(text), F.lit(f"[{KEPT}]"))


def is_blank(text: Column) -> Column:
    """True when the text holds nothing but whitespace."""
    return F.trim(_plain_spaces(text)) == ""


def strip(text: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.trim(text, F.lit(" " + ODD_WHITESPACE))


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_TERMINATOR)


def token_structs(pattern: Column) -> Column:
    """Non-empty tokens of a pattern with their position and boundary class.

    A space on both sides makes a token a whole word, one only before it a word
    prefix, one only after it a word suffix, none an infix.
    """
    words = F.split(pattern, " ")
    last = F.size(words) - 1

    def describe(token: Column, index: Column) -> Column:
        return F.struct(
            index.alias("token_pos"),
            token.alias("token"),
            F.when((index > 0) & (index < last), F.lit("whole"))
            .when(index > 0, F.lit("prefix"))
            .when(index < last, F.lit("suffix"))
            .otherwise(F.lit("infix"))
            .alias("token_class"),
        )

    return F.filter(F.transform(words, describe), lambda item: item["token"] != "")


def interior_tokens(pattern: Column) -> Column:
    """Tokens with a literal space on both sides."""
    return F.regexp_extract_all(pattern, F.lit("(?<= )[^ ]+(?= )"), F.lit(0))


def edit_pairs(mistyped: Column, corrected: Column) -> Column:
    """Array of (typo, correction): the differing words, or both texts whole.

    The whole texts are used when the word counts differ. Empty or equal texts
    give an empty array.
    """
    before, after = F.split(mistyped, " "), F.split(corrected, " ")
    pair_type = "array<struct<typo:string,correction:string>>"
    nothing = F.array().cast(pair_type)
    whole = F.array(F.struct(mistyped.alias("typo"), corrected.alias("correction")))
    by_word = F.filter(
        F.zip_with(before, after, lambda a, b: F.struct(a.alias("typo"), b.alias("correction"))),
        lambda pair: pair["typo"] != pair["correction"],
    )
    return (
        F.when((mistyped == "") | (corrected == "") | (mistyped == corrected), nothing)
        .when(F.size(before) == F.size(after), by_word)
        .otherwise(whole)
        .cast(pair_type)
    )


def has_reset(chunk: Column) -> Column:
    return F.contains(chunk, F.lit(RESET_MARKER))


def after_reset(chunk: Column) -> Column:
    """The part of a chunk behind its last reset marker (the whole chunk without one)."""
    return F.substring_index(chunk, RESET_MARKER, -1)
