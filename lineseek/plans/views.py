"""Working tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineseek.functions.text import normalize
from lineseek.operators import completion
from lineseek.operators.postings import build_postings, build_vocabulary, edge_costs, line_words
from lineseek.operators.ranking import LINE_ORDER, number_lines
from lineseek.runtime import broadcast_if_small, materialize, spread
from lineseek.sources.corpus import keep_lines, lines_of, split_texts
from lineseek.sources.index_store import Index

# Characters typed at a time.
STRETCH = 24

_numbered: dict[tuple[str, str], DataFrame] = {}
_texts: dict[tuple[str, ...], DataFrame | tuple[DataFrame, int]] = {}
_words: dict[tuple[str, str], DataFrame] = {}
_indexes: dict[tuple[str, str], Index] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return documents.select(
        F.format_string("%s/%d.txt", "source", "doc_id").alias("source_text"), "text"
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(texts(spark, sf_dir))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered lines, prepared once per session and folder and then read back."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _numbered:
        _numbered[key] = materialize(number_lines(lines(spark, sf_dir)))
    return _numbered[key]


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines without their original text, stored as they come with a number of any size.

    Sorting reads its input twice, for the bounds and for the rows; stored lines are not
    normalized again for it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "stored")
    if key not in _texts:
        number = F.monotonically_increasing_id() + completion.HEAD_MOST
        _texts[key] = materialize(lines(spark, sf_dir).drop("original_sentence").withColumn("line_id", number))
    return _texts[key]


def numbered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered lines without their original text, sorted and stored once.

    For queries that return line numbers but no text: half as much is moved.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _texts:
        _texts[key] = number_lines(stored_texts(spark, sf_dir).drop("line_id"))
    return _texts[key]


def with_originals(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    """Some rows of `numbered_texts` with their original text, which is read from the documents again.

    Only the documents of these rows are split, and only their lines normalized. Lines alike in
    all that they are ordered by are in no order, so each takes another of their original texts.
    """
    alike = Window.partitionBy(*LINE_ORDER)
    asked = materialize(
        wanted.select("line_id", *LINE_ORDER).withColumn("_copy", F.row_number().over(alike.orderBy("line_id")))
    )
    places = asked.select("source_text", "offset").distinct()
    sources = broadcast_if_small(places.select("source_text").distinct())
    split = split_texts(texts(spark, sf_dir).join(sources, "source_text", "left_semi"))
    originals = keep_lines(split.join(broadcast_if_small(places), ["source_text", "offset"], "left_semi"))
    copies = originals.withColumn("_copy", F.row_number().over(alike.orderBy("original_sentence")))
    return asked.join(copies, [*LINE_ORDER, "_copy"]).drop("_copy")


def headed_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The lines without their original text, and how many of them are numbered in line order.

    For queries that return no line number. The lines are stored as they come; only the head
    that a search begins with, the first of the order, is sorted. All others carry any number
    behind it. Of a table too small to have a head all lines are sorted, and the size is 0.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "headed")
    if key not in _texts:
        stored = stored_texts(spark, sf_dir)
        bound = completion.head_bound(stored)
        if bound is None:
            _texts[key] = number_lines(stored.drop("line_id")), 0
        else:
            text = F.col("normalized_sentence")
            head = number_lines(stored.where(text < bound).drop("line_id"))
            _texts[key] = head.unionByName(stored.where(text >= bound)), completion.line_count(head)
    return _texts[key]


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the number of lines holding it; takes no line numbers."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _words:
        _words[key] = materialize(build_vocabulary(line_words(lines(spark, sf_dir))))
    return _words[key]


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The word index over the numbered lines, prepared once in the same way."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        numbered = numbered_lines(spark, sf_dir)
        entries = materialize(build_postings(numbered))
        words = materialize(build_vocabulary(entries))
        _indexes[key] = Index(numbered, entries, words, materialize(edge_costs(words)))
    return _indexes[key]


def stretches(text, pattern_flags: str = ""):
    return F.regexp_extract_all(text, F.lit(pattern_flags + ".{1,%d}" % STRETCH), F.lit(0))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed queries: every stretch of every passage, three in four with one typing error.

    The error is a wrong, a surplus or a missing character, in turn, at a place that
    moves along with the stretch. `intended` is the stretch without the error.
    """
    passages = read(spark, sf_dir, "benchmark").select(
        "item_id", normalize(F.col("text")).alias("passage")
    )
    parts = passages.select(
        "item_id", F.posexplode(stretches(F.col("passage"))).alias("part", "intended")
    ).select(
        (F.col("item_id") * 1000 + F.col("part")).alias("query_id"),
        ((F.col("item_id") + F.col("part")) % 4).alias("kind"),
        F.expr("int((item_id + part) % length(intended)) + 1").alias("place"),
        "intended",
    )
    before = F.expr("substring(intended, 1, place - 1)")
    typed = (
        F.when(F.col("kind") == 0, F.col("intended"))
        .when(F.col("kind") == 1, F.concat(before, F.lit("q"), F.expr("substring(intended, place + 1)")))
        .when(F.col("kind") == 2, F.concat(before, F.lit("q"), F.expr("substring(intended, place)")))
        .otherwise(F.concat(before, F.expr("substring(intended, place + 1)")))
    )
    return parts.select("query_id", typed.alias("query_text"), "intended")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk log of whole messages, some with a reset marker inside, some empty or blank."""
    turn = F.col("conv_id") + F.col("turn")
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        F.when(turn % 5 == 3, F.expr("concat(left(text, 10), '#', substring(text, 11))"))
        .when(turn % 7 == 4, F.lit(""))
        .when(turn % 11 == 5, F.lit("   "))
        .otherwise(F.col("text"))
        .alias("chunk"),
    )


def typed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk log of passages typed stretch by stretch, started over every sixth time."""
    part = F.col("seq")
    return (
        read(spark, sf_dir, "benchmark")
        .select(
            F.col("item_id").alias("session_id"),
            F.posexplode(stretches(F.col("text"), "(?s)")).alias("seq", "stretch"),
        )
        .select(
            "session_id",
            part.cast("long").alias("seq"),
            F.when(part % 6 == 5, F.concat(F.lit("#"), "stretch"))
            .when(part % 9 == 4, F.lit(""))
            .otherwise(F.col("stretch"))
            .alias("chunk"),
        )
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser answers in two languages for every message, in all accepted shapes."""
    said = F.col("text")
    padded = F.concat(F.lit("  "), said, F.lit(" "))

    def alternatives(*transcripts):
        items = [F.struct(t.alias("transcript"), F.lit(0.5).alias("confidence")) for t in transcripts]
        return F.to_json(F.struct(F.array(*items).alias("alternative")))

    turn = F.col("turn")
    default = (
        F.when(turn % 3 == 0, alternatives(padded, F.lit("second")))
        .when(turn % 3 == 1, F.lit('{"alternative":[]}'))
        .otherwise(alternatives(F.lit("   "), F.lit("other")))
    )
    fallback = (
        F.when(turn % 4 == 0, F.lit("{}"))
        .when(turn % 4 == 1, F.get_json_object(F.to_json(F.struct(F.array(padded).alias("a"))), "$.a"))
        .when(turn % 4 == 2, F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"))
        .otherwise(F.lit('{"alternative":[]}'))
    )
    answers = F.array(
        F.struct(F.lit("en-US").alias("language"), default.alias("response")),
        F.struct(F.lit("en-GB").alias("language"), fallback.alias("response")),
    )
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("recording_id"),
        F.when(F.col("role") == "user", F.lit("en-US"))
        .otherwise(F.lit("fr-FR"))
        .alias("requested_language"),
        F.inline(answers),
    )
