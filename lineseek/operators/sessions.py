"""Typing sessions, recordings and the display of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions.text import after_reset, has_reset, is_blank
from lineseek.functions.transcripts import (
    DEFAULT_LANGUAGE,
    FALLBACK_LANGUAGE,
    NOT_RECOGNIZED_MESSAGE,
    best_transcript,
)
from lineseek.operators import scan
from lineseek.runtime import broadcast_if_small, materialize

# Fixed value: shown for a text that finds nothing.
NO_MATCHES = "No suggestions found."


def chunk_events(chunks: DataFrame) -> DataFrame:
    """(session_id, seq, _reset, _piece) of the chunks that are events."""
    return chunks.where(F.col("chunk") != "").select(
        "session_id",
        "seq",
        has_reset(F.col("chunk")).alias("_reset"),
        after_reset(F.col("chunk")).alias("_piece"),
    )


def session_text(chunks: DataFrame, *, block_rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Text of a session after each chunk, for chunks (session_id, seq, chunk).

    Chunks append; a reset marker drops everything up to its last place in the chunk; an
    empty chunk is no event. `fired` tells whether the text is searched for. `seq` is of any
    ordered type and unique in its session. A session of any length is worked on in blocks
    of `block_rows` rows, which are then linked (`scan.running_text`).
    """
    placed = scan.in_order(chunk_events(chunks), ("session_id", "seq"))
    told = scan.running_text(placed, "session_id", block_rows)
    return told.select("session_id", "seq", F.col("_text").alias("session_text")).withColumn(
        "fired", ~is_blank(F.col("session_text"))
    )


def session_queries(chunks: DataFrame, *, block_rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """The accumulated texts that are searched for, as `query_text`."""
    return (
        session_text(chunks, block_rows=block_rows)
        .where("fired")
        .select("session_id", "seq", F.col("session_text").alias("query_text"))
    )


def drop_repeats(
    recordings: DataFrame, session: str, seq: str, content: str, *, block_rows: int = scan.BLOCK_ROWS
) -> DataFrame:
    """Drop a recording whose bytes equal those of the one before it in its session.

    The comparison is by SHA-256 (`content_hash`). Only ids and hashes are ordered, in
    blocks as above; the recordings themselves lose the rows found to repeat. `seq` is
    unique in its session.
    """
    content_hash = F.sha2(F.col(content), 256)
    light = recordings.select(
        F.col(session).alias("_session"), F.col(seq).alias("_seq"), content_hash.alias("_hash")
    )
    placed = scan.in_order(light, ("_session", "_seq", "_hash"))
    found = scan.equals_previous(placed, "_session", "_hash", block_rows).where("_repeats")
    repeats = broadcast_if_small(materialize(found.select("_session", "_seq")))
    same_row = F.col(session).eqNullSafe(F.col("_session")) & F.col(seq).eqNullSafe(F.col("_seq"))
    return recordings.join(repeats, same_row, "left_anti").withColumn("content_hash", content_hash)


def transcribe(responses: DataFrame) -> DataFrame:
    """One row per recording from recogniser answers, with `transcript` or `error`.

    `responses` holds (recording_id, requested_language, language, response). The default
    language is followed by its fallback; any other language stands alone.
    """
    tried = responses.withColumn(
        "_tried",
        (F.col("language") == F.col("requested_language"))
        | (
            (F.col("requested_language") == DEFAULT_LANGUAGE)
            & (F.col("language") == FALLBACK_LANGUAGE)
        ),
    ).withColumn("_transcript", best_transcript(F.col("response")))
    usable = F.col("_tried") & (F.col("_transcript") != "")
    priority = F.when(F.col("language") == F.col("requested_language"), F.lit(0)).otherwise(
        F.lit(1)
    )
    return (
        tried.groupBy("recording_id")
        .agg(F.min_by("_transcript", F.when(usable, priority)).alias("transcript"))
        .withColumn(
            "error", F.when(F.col("transcript").isNull(), F.lit(NOT_RECOGNIZED_MESSAGE))
        )
    )


def render_results(completions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each result as a display line, with the header of its result list."""
    line = F.format_string(
        "%d. %s (%s:%d, score=%d)",
        "rank",
        "completed_sentence",
        "source_text",
        "offset",
        "score",
    )
    shown = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return completions.select(
        *keys,
        "rank",
        F.format_string("Here are %d suggestions:", shown).alias("header"),
        line.alias("line"),
    )


def screen(fired: DataFrame, completions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Everything shown for each fired text, in order: (keys..., place from 0, line).

    A header with the results, or the message that there are none; then the text itself.
    `completions` holds the results of some of the texts by the same keys.
    """
    rendered = render_results(completions, keys)
    results = rendered.select(*keys, F.col("rank").alias("place"), "line")
    headers = rendered.where(F.col("rank") == 1).select(*keys, F.lit(0).alias("place"), F.col("header").alias("line"))
    shown = completions.groupBy(*keys).agg(F.max("rank").alias("_last"))
    ends = fired.select(*keys, F.col("query_text").alias("_echo")).join(shown, list(keys), "left")
    nothing = ends.where(F.col("_last").isNull()).select(*keys, F.lit(0).alias("place"), F.lit(NO_MATCHES).alias("line"))
    echoes = ends.select(*keys, (F.coalesce("_last", F.lit(0)) + 1).alias("place"), F.col("_echo").alias("line"))
    return headers.unionByName(results).unionByName(nothing).unionByName(echoes)
