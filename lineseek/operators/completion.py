"""Best-k lines per query with at most one edit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions import scoring
from lineseek.functions.text import KEPT, has_content, normalize
from lineseek.operators import ladder, seeding
from lineseek.operators.postings import (
    INDEX_ROWS,
    affordable,
    candidate_lines,
    choose_tokens,
    fetch_lines,
)
from lineseek.operators.ranking import top_k
from lineseek.operators.sessions import NO_MATCHES
from lineseek.runtime import broadcast_if_small, materialize, spread

DEFAULT_K = 5
# Size of the part of the lines searched first: a share of them within bounds.
HEAD_SHARE, HEAD_LEAST, HEAD_MOST = 32, 1_000, 4_000_000
# Lines that are not sorted are divided by their first characters: at most 37^3 different ones.
BOUND_LENGTH = 3
# Queries up to this length are looked for by their spelled edits: a half of two or three
# characters stands at every hundredth place of the lines, and hardly any is a match.
SPELLED_LENGTH = 6


def admit(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Add the normalized `query` and keep the rows where something is left of it."""
    return queries.where(has_content(F.col(text))).withColumn("query", normalize(F.col(text)))


def one_edit_seeds(queries: DataFrame) -> DataFrame:
    """Pieces of each distinct `query` that a matching line must hold.

    A query of up to SPELLED_LENGTH characters is spelled out with every edit; where such a
    text stands its `known` score is reached. A longer one is cut in two (`half_seeds`). All
    are looked for together.
    """
    short = F.length("query") <= SPELLED_LENGTH
    columns = ("query", "reach", "from_floor", "half", "half_length", "extra_shift", "missing_shift", "half_start", "known")
    pieces = half_pieces(queries.where(~short)).select(*columns).unionByName(spelled_pieces(queries.where(short)).select(*columns))
    return seeding.choose_seeds(pieces, "half").select(
        "query",
        "reach",
        "from_floor",
        "half",
        "half_length",
        "known",
        "seed_width",
        "seed_key",
        # Places in the query, as distances from its start.
        (F.col("half_start") - 1 + F.col("seed_offset")).alias("seed_offset"),
        (F.col("half_start") - 1).alias("half_offset"),
        "extra_shift",
        "missing_shift",
    )


def spelled_pieces(queries: DataFrame) -> DataFrame:
    """Every text of a score above zero that one edit makes of `query`, at its best score."""
    spelled = ladder.sane(ladder.edit_variants(queries, " " + KEPT))
    return (
        spelled.groupBy("query", F.col("text").alias("half"))
        .agg(F.max("score").alias("known"))
        .select(
            "query",
            "half",
            F.length("half").alias("half_length"),
            F.lit(1).alias("half_start"),
            "known",
            F.col("known").alias("reach"),
            F.lit(0).alias("from_floor"),
            F.lit(0).alias("extra_shift"),
            F.lit(0).alias("missing_shift"),
        )
    )


def half_pieces(queries: DataFrame) -> DataFrame:
    """The halves of each distinct `query`, and the whole of it.

    The query is cut in two. An edit in the right half leaves the left half whole and an
    edit in the left half the right one, so a line matches only where one half occurs. The
    whole query is a third piece, for the case that only an unchanged match is of use.

    A piece is looked for when the score to exceed is below its `reach`, the best score it
    can lead to, and not below `from_floor`. For a query without a score to exceed (0) that
    leaves out the right half up to three characters, and both halves up to two.
    """
    length = F.length("query")
    half = F.expr("int((length(query) + 1) div 2)")

    def best_edit(until: Column) -> Column:
        """Best score of an edit at or before a position: penalties only fall with it."""
        return F.greatest(
            scoring.score_substitution(length, until), scoring.score_missing_char(length, until)
        )

    def piece(start: Column, size: Column, reach: Column, from_floor: Column, right: bool):
        return F.struct(
            start.alias("half_start"),
            size.alias("half_length"),
            reach.alias("reach"),
            from_floor.alias("from_floor"),
            F.lit(right).alias("is_right"),
        )

    nothing, first = F.lit(0), F.lit(1)
    any_edit = best_edit(length)
    pieces = F.array(
        piece(first, length, scoring.score_exact(length), F.greatest(any_edit, nothing), False),
        piece(first, half, any_edit, nothing, False),
        piece(half + 1, length - half, best_edit(half), nothing, True),
    )
    return (
        queries.select("query", F.inline(pieces))
        .where(F.col("reach") > 0)
        .withColumn("half", F.expr("substring(query, half_start, half_length)"))
        .withColumn("known", F.lit(None).cast("int"))
        # An edit left of an intact right half moves the start of the query in the line.
        .withColumn("extra_shift", F.col("is_right").cast("int"))
        .withColumn("missing_shift", -F.col("is_right").cast("int"))
    )


def score_alignments(met: DataFrame, start: Column, keep: tuple[str, ...]) -> DataFrame:
    """Score the query placed at `start` of the line as it is and with each kind of edit.

    Each possibility is a generated row, so the text it covers and its score are worked
    out once and the code Spark generates stays small enough to be compiled (the JVM only
    interprets methods beyond 8000 bytes). A spelled edit stands there as it is, and its
    `known` score is the only possibility.
    """
    known = F.col("known")
    query, length = F.col("query"), F.length("query")

    def possibility(at: Column, size: Column, full: Column, indel: bool) -> Column:
        return F.struct(
            seeding.cut(at, size).alias("window"),
            size.alias("size"),
            full.alias("full"),
            F.lit(indel).alias("indel"),
        )

    edits = F.array(
        possibility(start, length, (length - 1) * 2, False),
        possibility(start + F.col("missing_shift"), length + 1, length * 2, True),
        possibility(start + F.col("extra_shift"), length - 1, (length - 1) * 2, True),
    )
    nothing = F.array(
        F.struct(F.lit("").alias("window"), F.lit(0).alias("size"), F.lit(0).alias("full"), F.lit(False).alias("indel"))
    )
    covered = met.select(
        "query", "floor", "known", *keep, F.inline(F.when(known.isNull(), edits).otherwise(nothing))
    ).where(
        known.isNotNull()
        | (F.length("window") == F.col("size")) & (F.levenshtein(F.col("window"), query, 1) >= 0)
    )
    score = (
        F.when(known.isNotNull(), known)
        .when(F.col("window") == query, scoring.score_exact(length))
        .otherwise(
            F.col("full")
            - scoring.edit_penalty(F.col("indel"), scoring.edit_position(F.col("window"), query))
        )
    )
    return covered.select("query", "floor", *keep, F.explode(F.array(score)).alias("score")).where(
        F.col("score") > F.col("floor")
    ).drop("floor")


@dataclass(frozen=True)
class Search:
    """Distinct queries made ready: their stored seeds and how many may be broadcast."""

    seeds: DataFrame
    seed_rows: int

    def without(self, found: DataFrame) -> Search:
        """The search for the queries not in `found`."""
        return Search(self.seeds.join(found.select("query"), "query", "left_anti"), self.seed_rows)


def prepare(admitted: DataFrame, seed_rows: int = seeding.SEED_ROWS) -> Search:
    """Work out the seeds of every distinct `query` once, for as many passes as follow."""
    return Search(materialize(one_edit_seeds(admitted.select("query").distinct())), seed_rows)


def one_edit_hits(
    lines: DataFrame,
    search: Search,
    floors: DataFrame | None = None,
    *,
    keep: tuple[str, ...] = ("line_id",),
) -> DataFrame:
    """Every place where a query fits a line with at most one edit.

    `floors` (query, floor) names scores that hits must exceed; without it, zero. Returns
    `query`, the `keep` columns of the line and `score`; a line may come several times, with
    the same or different scores.
    """
    if floors is None:
        seeds = search.seeds.withColumn("floor", F.lit(0))
    else:
        seeds = search.seeds.join(floors, "query", "left").withColumn(
            "floor", F.coalesce("floor", F.lit(0))
        )
    useful = seeds.where(
        (F.col("floor") < F.col("reach")) & (F.col("floor") >= F.col("from_floor"))
    )
    measured = seeding.measure(useful, "query", search.seed_rows)
    if not measured.widths:
        return lines.limit(0).select(F.lit("").alias("query"), *keep, F.lit(0).alias("score"))
    text = "normalized_sentence"
    met = seeding.meet(
        lines.select(*keep, F.col(text).alias("_line_text")), "_line_text", useful, "query", measured
    )
    start = F.col("_pos") - F.col("seed_offset")
    half_intact = seeding.cut(start + F.col("half_offset"), F.col("half_length")) == F.col("half")
    return score_alignments(met.where(half_intact), start, keep)


def line_count(lines: DataFrame) -> int:
    """Number of numbered lines; reads one column of stored lines."""
    last = lines.agg(F.max("line_id")).first()[0]
    return 0 if last is None else last + 1


def head_size(count: int) -> int:
    """Lines to search first; none when the whole is too small to gain from it."""
    share = min(count // HEAD_SHARE, HEAD_MOST)
    return share if share >= HEAD_LEAST else 0


def head_bound(lines: DataFrame) -> str | None:
    """A text that about a head of the unsorted `lines` lie before in the line order; None for no head.

    Taken from counts of the lines' first characters, so that nothing but these is moved. Lines
    that all begin alike are left to the rest together.
    """
    start = F.left("normalized_sentence", F.lit(BOUND_LENGTH))
    counts = materialize(lines.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("_lines")))
    size = head_size(counts.agg(F.coalesce(F.sum("_lines"), F.lit(0))).first()[0])
    if not size:
        return None
    sums = counts.withColumn("_until", F.sum("_lines").over(Window.orderBy("start")))
    return sums.where(F.col("_until") - F.col("_lines") <= size).agg(F.max("start")).first()[0]


def first_lines(lines: DataFrame, head_lines: int) -> DataFrame:
    """The head, dealt out by line: stored in line order it would be a task or two.

    It is bounded by HEAD_MOST. As every line's hits come up in one task, that task alone
    leaves each line's best score, and sends on only the best lines of each query.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    head = lines.where(F.col("line_id") < head_lines).select("line_id", "normalized_sentence")
    return head.repartition(cores, "line_id")


def best_lines(lines: DataFrame, search: Search, k: int, *, head_lines: int) -> DataFrame:
    """Best `k` of the numbered `lines` per distinct query: query, line_id, score, rank.

    The first `head_lines` lines are searched on their own. A line behind them ranks after
    every line of the head with the same score, so a query with k results there takes
    nothing from the rest but a higher score, and nothing at all once these are unchanged
    matches. That keeps queries which fit nearly every line out of the long pass.
    """
    if head_lines <= 0:
        return top_k(one_edit_hits(lines, search), k)
    head = first_lines(lines, head_lines)
    # At most k rows per query.
    from_head = materialize(top_k(one_edit_hits(head, search), k))
    floors = from_head.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    rest = lines.where(F.col("line_id") >= head_lines)
    from_rest = top_k(one_edit_hits(rest, search, floors), k)
    # Both sides name a line once, so the places of the union are final.
    return top_k(from_head.unionByName(from_rest).drop("rank"), k)


def show_results(
    admitted: DataFrame, best: DataFrame, lines: DataFrame, block_lines: int | None = None
) -> DataFrame:
    """The best lines of each query as result rows.

    The result numbers are stored first, so that their count can decide whether they are
    sent to the lines; planned unseen, this join would shuffle all lines instead.
    """
    stored = materialize(best.select("query", "line_id", "score", "rank"))
    found = fetch_lines(lines, broadcast_if_small(stored), block_lines)
    return admitted.join(
        found.select(
            "query",
            "rank",
            F.col("original_sentence").alias("completed_sentence"),
            "source_text",
            "offset",
            "score",
        ),
        "query",
    ).select(
        *admitted.columns, "rank", "completed_sentence", "source_text", "offset", "score"
    )


def complete(
    lines: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    *,
    text: str = "query_text",
    head_lines: int | None = None,
    seed_rows: int = seeding.SEED_ROWS,
) -> DataFrame:
    """Best `k` of the numbered `lines` for every row of `queries`, by scanning the lines.

    Adds `query` (the normalized text), `rank`, `completed_sentence`, `source_text`,
    `offset` and `score` to the columns of `queries`. Rows without a result do not appear.
    The search moves line numbers only; the lines themselves are fetched for the results.
    """
    if k <= 0:
        queries, k = queries.limit(0), 1
    admitted = materialize(admit(queries, text))
    if head_lines is None:
        head_lines = head_size(line_count(lines))
    best = best_lines(lines, prepare(admitted, seed_rows), k, head_lines=head_lines)
    return show_results(admitted, best, lines)


def best_texts(
    lines: DataFrame,
    queries: DataFrame,
    *,
    text: str = "query_text",
    head_lines: int = 0,
    seed_rows: int = seeding.SEED_ROWS,
) -> DataFrame:
    """Every row of `queries` that fits a line, with its best score and the first text that reaches it.

    Adds `query`, `score` and `normalized_sentence`. Only the first `head_lines` lines need be
    numbered in line order, and all others stand behind them: there a `line_id` is any number
    from `head_lines` on that no other line has. So lines need not be sorted for this.
    """
    admitted = materialize(admit(queries, text))
    search = prepare(admitted, seed_rows)
    floors, rest = None, lines
    texts = lines.select("line_id", "normalized_sentence")
    found = []
    if head_lines > 0:
        early = materialize(top_k(one_edit_hits(first_lines(lines, head_lines), search), 1).drop("rank"))
        floors = early.select("query", F.col("score").alias("floor"))
        rest = lines.where(F.col("line_id") >= head_lines)
        found.append((texts.where(F.col("line_id") < head_lines), early))
    # Line numbers only are moved, and of each query only the lines of its best score are kept.
    late = materialize(
        one_edit_hits(rest, search, floors).groupBy("query", "line_id").agg(F.max("score").alias("score"))
    )
    reached = late.groupBy("query").agg(F.max("score").alias("score"))
    ties = materialize(late.join(broadcast_if_small(reached), ["query", "score"]).select(late.columns))
    found.append((texts.where(F.col("line_id") >= head_lines), ties))
    # What the rest adds has a higher score than the head, so equal scores are of one side.
    best = reduce(
        DataFrame.unionByName,
        [
            fetch_lines(side, broadcast_if_small(hits))
            .groupBy("query", "score")
            .agg(F.min("normalized_sentence").alias("normalized_sentence"))
            for side, hits in found
        ],
    )
    one = best.groupBy("query").agg(F.max(F.struct("score", "normalized_sentence")).alias("_best"))
    return admitted.join(one, "query").select(*admitted.columns, "_best.score", "_best.normalized_sentence")


def word_halves(queries: DataFrame) -> DataFrame:
    """(query, pattern): each distinct `query` cut in two at the space nearest its middle.

    One edit leaves one of the two pieces whole, wherever the cut is. At a space the second
    piece starts with a word boundary, which makes its first word cheap to look up. A query
    of one word is cut in the middle.
    """
    middle = F.expr("int((length(query) + 1) div 2)")
    spaces = F.expr(
        "filter(sequence(2, length(query)), place -> substring(query, place, 1) = ' ')"
    )
    nearest = F.array_min(
        F.transform(spaces, lambda at: F.struct(F.abs(at - 1 - middle).alias("d"), at.alias("at")))
    )
    cut = F.coalesce(nearest["at"] - 1, middle)
    return (
        queries.where(F.length("query") > 1)
        .select("query", cut.alias("_cut"))
        .select(
            "query",
            F.explode(F.expr("array(left(query, _cut), substring(query, _cut + 1))")).alias(
                "pattern"
            ),
        )
        .unionByName(
            queries.where(F.length("query") == 1).select("query", F.col("query").alias("pattern"))
        )
    )


def complete_indexed(
    lines: DataFrame,
    postings: DataFrame,
    vocabulary: DataFrame,
    edges: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    *,
    text: str = "query_text",
    head_lines: int | None = None,
    index_rows: int = INDEX_ROWS,
    word_buckets: int | None = None,
    block_lines: int | None = None,
    seed_rows: int = seeding.SEED_ROWS,
) -> DataFrame:
    """`complete` with the word index: rare queries read their candidate lines only.

    The postings of the cheapest tokens of a query's two pieces name its candidate lines. The
    queries with the fewest go this way, as long as they lead to no more than `index_rows`
    lines together. All other queries share the scan.
    """
    if k <= 0:
        queries, k = queries.limit(0), 1
    admitted = materialize(admit(queries, text))
    distinct = admitted.select("query").distinct()
    pieces = materialize(word_halves(distinct))
    chosen = choose_tokens(pieces, vocabulary, edges, word_buckets)
    # A piece that no token choice was made for occurs in no line and costs nothing.
    costs = materialize(
        pieces.join(chosen.choice, "pattern", "left")
        .groupBy("query")
        .agg(F.sum(F.coalesce("cost", F.lit(0))).alias("cost"))
    )
    limit = affordable(costs, index_rows)
    rare = materialize(costs.where(F.col("cost") <= limit).select("query"))
    candidates = candidate_lines(
        chosen.choice.join(
            pieces.join(rare, "query").select("pattern").distinct(), "pattern", "left_semi"
        ),
        vocabulary,
        postings,
        word_buckets,
    )
    numbers = materialize(candidates.select("line_id").distinct())
    some_lines = materialize(
        fetch_lines(
            lines.drop("original_sentence", "source_text", "offset"), F.broadcast(numbers), block_lines
        )
    )
    by_index = best_lines(spread(some_lines), prepare(rare, seed_rows), k, head_lines=0)
    others = distinct.join(rare, "query", "left_anti")
    if head_lines is None:
        head_lines = head_size(line_count(lines))
    by_scan = best_lines(lines, prepare(others, seed_rows), k, head_lines=head_lines)
    return show_results(admitted, by_index.unionByName(by_scan), lines, block_lines)


def best_scores(
    lines: DataFrame, admitted: DataFrame, *, line_key: tuple[str, ...] = ("line_id",)
) -> DataFrame:
    """Best positive score of every (query, line) pair that has one."""
    hits = one_edit_hits(lines, prepare(admitted), keep=line_key)
    return hits.groupBy("query", *line_key).agg(F.max("score").alias("score"))


def matched_queries(lines: DataFrame, search: Search, *, head_lines: int) -> DataFrame:
    """The queries that fit any line. Those found in the head are not looked for in the rest."""
    if head_lines <= 0:
        return one_edit_hits(lines, search).select("query").distinct()
    early = materialize(one_edit_hits(first_lines(lines, head_lines), search).select("query").distinct())
    rest = one_edit_hits(lines.where(F.col("line_id") >= head_lines), search.without(early))
    return early.unionByName(rest.select("query").distinct())


def without_match(
    lines: DataFrame, queries: DataFrame, *, text: str = "query_text", head_lines: int | None = None
) -> DataFrame:
    """Admitted queries that fit no line, with the message shown for them. No line's text is fetched."""
    admitted = materialize(admit(queries, text))
    if head_lines is None:
        head_lines = head_size(line_count(lines))
    found = matched_queries(lines, prepare(admitted), head_lines=head_lines)
    return admitted.join(found, "query", "left_anti").withColumn("message", F.lit(NO_MATCHES))
