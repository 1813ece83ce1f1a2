"""Quality of texts by weak supervision: rules vote or abstain, EM weighs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import WHITE, let, whole, words
from lineseek.runtime import materialize

ROUNDS = 12
START_GOOD = 0.8
# How often a rule that votes is right on a good text, and on a bad one. Bad texts are bad in one
# or two ways, and most rules have nothing against them; a vote against a good text is rare.
START_RIGHT = (0.97, 0.3)
RIGHT_RANGE = (0.5, 0.999)
GOOD_RANGE = (0.01, 0.99)
SMOOTHING = 10.0

# Name, when it votes good, when it votes bad; neither is an abstention.
RULES = (
    ("length", "n_words >= 100", "n_words < 50"),
    ("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("symbols", "n_symbols * 50 <= n_words", "n_symbols * 10 > n_words"),
    ("lines", "n_dup_lines * 20 <= n_lines", "n_dup_lines * 10 > 3 * n_lines"),
    ("repeats", "n_repeat_words * 5 <= n_words", "n_repeat_words * 5 > 2 * n_words"),
    ("letters", "n_letters * 100 >= word_chars * 92", "n_letters * 100 < word_chars * 90"),
    ("capitals", "n_capitals * 5 <= n_letters", "n_capitals * 2 > n_letters"),
    ("sentences", "n_ends * 100 >= n_words", "n_ends = 0 and n_words >= 50"),
)


def repeated_words(tokens: Column) -> Column:
    """Words in three-word windows found twice or more, in time of one sort of the text."""
    triples = F.transform(tokens, lambda w, i: F.struct(F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")))
    ordered = F.array_sort(F.slice(triples, F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(0))))

    def count(found: Column) -> Column:
        h = lambda k: F.get(found, k)["h"]
        again = F.filter(found, lambda t, k: F.coalesce(h(k + 1) == t["h"], F.lit(False)) | F.coalesce((k > 0) & (h(k - 1) == t["h"]), F.lit(False)))
        covered = F.flatten(F.transform(again, lambda t: F.array(t["i"], t["i"] + 1, t["i"] + 2)))
        return F.size(F.array_distinct(covered))

    return let(ordered, count)


def measures(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, the five base measures, and what the rules look at besides, of whole texts."""
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    remove = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    about = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    line_counts = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("d")))
    return docs.select(
        "doc_id",
        *extra,
        about.alias("_w"),
        line_counts.alias("_l"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        remove(r"\P{L}+").alias("n_letters"),
        remove(r"\P{Lu}+").alias("n_capitals"),
        remove(r"[^.!?]+").alias("n_ends"),
    ).select(
        "doc_id",
        *extra,
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.d").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
        "n_letters",
        "n_capitals",
        "n_ends",
    )


def votes() -> list[Column]:
    """One column per rule: 1 good, 0 bad, null for an abstention."""
    return [F.when(F.expr(good), 1).when(F.expr(bad), 0).alias(f"v_{name}") for name, good, bad in RULES]


def log_odds(good: float, right: list[tuple[float, float]]) -> Column:
    total = F.lit(math.log(good / (1 - good)))
    for (name, _, _), (on_good, on_bad) in zip(RULES, right):
        for_it, against = math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)
        total = total + F.coalesce(F.when(F.col(f"v_{name}") == 1, for_it).when(F.col(f"v_{name}") == 0, against), F.lit(0.0))
    return total


def posterior(good: float, right: list[tuple[float, float]]) -> Column:
    return 1 / (1 + F.exp(-log_odds(good, right)))


def clamp(x: float, low: float, high: float) -> float:
    return round(min(max(x, low), high), 6)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """EM over vote patterns with counts: the share of good texts and each rule's two accuracies.

    The second accuracy is at least one less the first, so a vote never speaks against what it
    says, and the classes can't swap; a rule that votes alike on both weighs nothing. There are at
    most 3 ** len(RULES) patterns however many texts there are. Pseudo-votes at the starting
    values (SMOOTHING) make an empty table return those values.
    """
    good, right = START_GOOD, [START_RIGHT] * len(RULES)
    for _ in range(rounds):
        p, n = F.col("_p"), F.col("_n")
        sums = [F.sum("_n").alias("n"), F.sum(p * n).alias("g")]
        for name, _, _ in RULES:
            vote = F.col(f"v_{name}")
            for key, share, correct in (("g", p, 1), ("b", 1 - p, 0)):
                sums += [
                    F.sum(F.when(vote == correct, share * n)).alias(f"r_{key}_{name}"),
                    F.sum(F.when(vote.isNotNull(), share * n)).alias(f"c_{key}_{name}"),
                ]
        got = patterns.withColumn("_p", posterior(good, right)).agg(*sums).first().asDict()
        part = lambda hits, cases, start: ((hits or 0.0) + SMOOTHING * start) / ((cases or 0) + SMOOTHING)
        # Rounded, as sums of doubles depend on the order in which tasks end.
        good, right = clamp(part(got["g"], got["n"], START_GOOD), *GOOD_RANGE), []
        for name, _, _ in RULES:
            one, two = (part(got[f"r_{k}_{name}"], got[f"c_{k}_{name}"], s) for k, s in zip("gb", START_RIGHT))
            on_good = clamp(one, *RIGHT_RANGE)
            right.append((on_good, clamp(two, 1 - on_good, RIGHT_RANGE[1])))
    return good, right


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Return doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    `quality` is the posterior probability of a good text; kept means at least a half, and
    that the base did not fail. A null or empty text has no words and fails the base.
    Repeated rows are judged each; an empty table returns no rows.
    """
    measured = materialize(
        measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *votes())
    )
    patterns = materialize(measured.groupBy(*(f"v_{name}" for name, _, _ in RULES)).agg(F.count("*").alias("_n")))
    good, right = estimate(patterns, rounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (posterior(good, right) >= 0.5)).alias("kept"),
        posterior(good, right).alias("quality"),
    )
