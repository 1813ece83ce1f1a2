"""The word index: which words exist, which lines hold them, and what a token costs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions.text import token_structs
from lineseek.operators.containment import find_containing
from lineseek.runtime import BROADCAST_ROWS, broadcast_if_small, materialize

# Words are looked up and priced by their first or last characters, up to this many.
EDGE_MOST = 32
# Candidate lines taken from postings in one search, over all its patterns together.
INDEX_ROWS = BROADCAST_ROWS
# So many lines are fetched by a filter that names them.
FEW_LINES = 64


def build_postings(lines: DataFrame) -> DataFrame:
    """One row per distinct word of a line: (word, line_id).

    The long form is kept on purpose: the list of a frequent word would be one row as
    large as the table.
    """
    return line_words(lines, "line_id")


def line_words(lines: DataFrame, *keep: str) -> DataFrame:
    """(word, keep...): every distinct word of each line."""
    return lines.select(F.explode(F.array_distinct(F.split("normalized_sentence", " "))).alias("word"), *keep)


def build_vocabulary(postings: DataFrame) -> DataFrame:
    """Every word with the number of lines holding it, from `build_postings` or `line_words`."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def pattern_tokens(patterns: DataFrame) -> DataFrame:
    """(pattern, token_pos, token, token_class) for every non-empty token of `pattern`."""
    return patterns.select("pattern", F.inline(token_structs(F.col("pattern"))))


def _edges(words: DataFrame, *keep: str) -> DataFrame:
    """(keep..., token_class, edge): every beginning and end of every `word`, up to EDGE_MOST characters."""
    sizes = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(EDGE_MOST)))

    def ends(kind: str, cut) -> Column:
        named = lambda size: F.struct(F.lit(kind).alias("token_class"), cut("word", size).alias("edge"))
        return F.transform(sizes, named)

    both = F.concat(ends("prefix", F.left), ends("suffix", F.right))
    return words.where(F.col("word") != "").select(*keep, F.inline(both))


def edge_costs(vocabulary: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(token_class, edge, words, cost): in how many words an edge stands, and in how many lines these.

    The price of a token is one row of it, however many words begin or end with the token.
    Lines are counted once for each of their words. With `tokens` (token, token_class) only
    their edges are counted: for a single search, which would not look at the others.
    """
    whole = vocabulary.select(
        F.lit("whole").alias("token_class"), F.col("word").alias("edge"), F.lit(1).cast("long").alias("words"),
        F.col("df").alias("cost"),
    )
    edges = _edges(vocabulary, "df")
    if tokens is not None:
        asked = tokens.select("token_class", F.col("token").alias("edge")).distinct()
        asked = broadcast_if_small(materialize(asked))
        whole, edges = (side.join(asked, ["token_class", "edge"], "left_semi") for side in (whole, edges))
    return whole.unionByName(
        edges.groupBy("token_class", "edge")
        .agg(F.count(F.lit(1)).alias("words"), F.sum("df").alias("cost"))
    )


def edge_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("edge"), F.lit(buckets)).cast("int")


def _edge_words(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, token_class, word, df) of prefix and suffix tokens, met on the token itself."""
    width = F.lit(EDGE_MOST)
    is_prefix = F.col("token_class") == "prefix"
    wanted = tokens.where(F.col("token_class").isin("prefix", "suffix")).withColumn(
        "edge", F.when(is_prefix, F.left("token", width)).otherwise(F.right("token", width))
    )
    holds = F.when(is_prefix, F.startswith("word", "token")).otherwise(F.endswith("word", "token"))
    met = _edges(vocabulary, "word", "df").join(broadcast_if_small(wanted), ["token_class", "edge"])
    # Only of a token longer than an edge is there anything left to compare.
    return met.where((F.length("token") <= width) | holds).select("token", "token_class", "word", "df")


def _infix_words(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    return find_containing(
        vocabulary.select("word", "df"),
        tokens.where(F.col("token_class") == "infix").select(F.col("token").alias("pattern")),
        text="word",
    ).select(F.col("pattern").alias("token"), F.lit("infix").alias("token_class"), "word", "df")


def token_words(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """All words a token can stand in: (token, token_class, word, df), each once."""
    distinct = materialize(tokens.select("token", "token_class").distinct())
    whole = (
        vocabulary.join(
            broadcast_if_small(distinct.where(F.col("token_class") == "whole")),
            F.col("word") == F.col("token"),
        ).select("token", "token_class", "word", "df")
    )
    return whole.unionByName(_edge_words(vocabulary, distinct)).unionByName(
        _infix_words(vocabulary, distinct)
    )


def token_costs(
    tokens: DataFrame, vocabulary: DataFrame, edges: DataFrame, buckets: int | None = None
) -> DataFrame:
    """Tokens with the number of words they stand in and the lines these lead to.

    Whole words, prefixes and suffixes are priced by one row of `edges` each. Infixes, and
    tokens longer than an edge, are priced from the words; their pairs are summed and not kept.
    """
    distinct = materialize(tokens.select("token", "token_class").distinct())
    of_word = F.col("token_class") == "whole"
    by_edge = of_word | (
        F.col("token_class").isin("prefix", "suffix") & (F.length("token") <= EDGE_MOST)
    )
    wanted = distinct.where(by_edge).withColumnRenamed("token", "edge")
    keys = ["token_class", "edge"]
    if buckets:
        wanted = wanted.withColumn("edge_bucket", edge_bucket(buckets)).where(F.col("edge") != "")
        keys.append("edge_bucket")
    priced = edges.join(broadcast_if_small(wanted), keys).select(
        F.col("edge").alias("token"), "token_class", "words", "cost"
    )
    # Only words that are longer than an edge too can begin or end with such a token.
    long = _edge_words(vocabulary.where(F.length("word") > EDGE_MOST), distinct.where(~by_edge))
    spelled = (
        long.unionByName(_infix_words(vocabulary, distinct))
        .groupBy("token", "token_class")
        .agg(F.count(F.lit(1)).alias("words"), F.sum("df").alias("cost"))
    )
    return tokens.join(priced.unionByName(spelled), ["token", "token_class"], "left").select(
        "pattern",
        "token_pos",
        "token",
        "token_class",
        F.coalesce("words", F.lit(0)).alias("words"),
        F.coalesce("cost", F.lit(0)).alias("cost"),
    )


def cheapest_tokens(costs: DataFrame) -> DataFrame:
    """The token of each pattern that leads to the fewest lines, from `token_costs`.

    A pattern with a token that stands in no word matches nothing and is left out.
    """
    return (
        costs.groupBy("pattern")
        .agg(
            F.min("words").alias("_least"),
            F.min(F.struct("cost", "token_pos", "token", "token_class")).alias("_pick"),
        )
        .where(F.col("_least") > 0)
        .select("pattern", "_pick.token_pos", "_pick.token", "_pick.token_class", "_pick.cost")
    )


def affordable(costs: DataFrame, budget: int) -> int:
    """The highest `cost` so that all rows up to it together stay within the budget; -1 for none.

    The running sum is over distinct costs within the budget, never more rows than that.
    """
    sums = costs.where(F.col("cost") <= budget).groupBy("cost").agg((F.sum("cost")).alias("_sum"))
    running = F.sum("_sum").over(Window.orderBy("cost"))
    most = sums.withColumn("_all", running).where(F.col("_all") <= budget).agg(F.max("cost")).first()[0]
    return -1 if most is None else most


def word_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")


def candidate_lines(
    choice: DataFrame, vocabulary: DataFrame, postings: DataFrame, word_buckets: int | None = None
) -> DataFrame:
    """(pattern, line_id) of the lines the chosen tokens lead to, each once.

    Only the tokens of `choice` are spelled out as words. Postings stored in buckets are
    joined on the bucket too, so that only the buckets of the words asked for are read.
    """
    words = token_words(vocabulary, choice.select("token", "token_class"))
    wanted = choice.join(words, ["token", "token_class"]).select("pattern", "word")
    keys = ["word"]
    if word_buckets:
        wanted = wanted.withColumn("word_bucket", word_bucket(word_buckets))
        keys.append("word_bucket")
    return postings.join(broadcast_if_small(wanted), keys).select("pattern", "line_id").distinct()


def line_block(block_lines: int) -> Column:
    return F.expr(f"int(line_id div {block_lines})")


def fetch_lines(
    lines: DataFrame, wanted: DataFrame, block_lines: int | None = None
) -> DataFrame:
    """Join rows that name a `line_id` to their lines.

    Up to FEW_LINES different numbers are put into the scan's own filter: lines lie in the
    order of their numbers, so it reads the row groups that hold them. More numbers
    read the blocks they lie in. (The comparison, true of every row, is there because Spark
    prunes blocks only by a side that is filtered.)
    """
    asked = wanted.select("line_id").distinct().limit(FEW_LINES + 1).collect()
    ids = sorted(r["line_id"] for r in asked if r["line_id"] is not None)
    if len(asked) <= FEW_LINES:
        here = reduce(or_, (F.col("line_id") == n for n in ids), F.lit(False))
        if block_lines:
            lines = lines.where(F.col("line_block").isin(sorted({n // block_lines for n in ids}))).drop("line_block")
        return wanted.join(lines.where(here), "line_id")
    if not block_lines:
        return wanted.join(lines, "line_id")
    placed = wanted.where(F.col("line_id") >= 0).withColumn(
        "line_block", line_block(block_lines)
    )
    return placed.join(lines, ["line_id", "line_block"]).drop("line_block")


@dataclass(frozen=True)
class TokenChoice:
    """Distinct patterns, and the cheapest token of each that may occur."""

    patterns: DataFrame
    choice: DataFrame


def choose_tokens(
    patterns: DataFrame, vocabulary: DataFrame, edges: DataFrame, buckets: int | None = None
) -> TokenChoice:
    distinct = materialize(patterns.select("pattern").where(F.col("pattern") != "").distinct())
    costs = token_costs(pattern_tokens(distinct), vocabulary, edges, buckets)
    return TokenChoice(distinct, materialize(cheapest_tokens(costs)))


def tokenless(patterns: DataFrame) -> DataFrame:
    """Patterns of spaces only, which no word leads to."""
    return patterns.where(F.replace(F.col("pattern"), F.lit(" "), F.lit("")) == "")


def search_patterns(
    lines: DataFrame,
    postings: DataFrame,
    vocabulary: DataFrame,
    edges: DataFrame,
    patterns: DataFrame,
    *,
    index_rows: int = INDEX_ROWS,
    word_buckets: int | None = None,
    block_lines: int | None = None,
) -> DataFrame:
    """(pattern, line_id) for exactly the lines that contain each distinct `pattern`.

    Where the postings of all patterns' cheapest tokens lead to no more than `index_rows`
    lines together, only these are read. Otherwise the lines are scanned once, for all
    patterns: what a scan costs hardly depends on how many look on. The choice changes the
    work and not the result: the text decides in both.
    """
    chosen = choose_tokens(patterns, vocabulary, edges, word_buckets)
    blank = tokenless(chosen.patterns)
    light = lines.drop("original_sentence", "source_text", "offset")
    needed = chosen.choice.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    if needed > index_rows or blank.limit(1).count():
        # Patterns with a token that stands in no word are left out in both ways.
        scanned = chosen.choice.select("pattern").unionByName(blank)
        return find_containing(lines.select("line_id", "normalized_sentence"), scanned).select("pattern", "line_id")
    candidates = materialize(candidate_lines(chosen.choice, vocabulary, postings, word_buckets))
    # At most `index_rows` numbers are broadcast; patterns stay where they are.
    numbers = materialize(candidates.select("line_id").distinct())
    found = fetch_lines(light, F.broadcast(numbers), block_lines)
    return (
        candidates.join(found, "line_id")
        .where(F.contains("normalized_sentence", "pattern"))
        .select("pattern", "line_id")
    )
