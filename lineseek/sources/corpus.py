"""Reading text collections into the lines table."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions.text import KEPT, has_content, normalize, split_lines
from lineseek.runtime import spread

TEXT_GLOB = "*.txt"
# Files above this size are read in splits instead of as one row each.
WHOLE_FILE_BYTES = 64 * 1024 * 1024
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def lines_of(texts: DataFrame) -> DataFrame:
    """Lines of a table (source_text, text): numbered from 1, normalized, empties dropped."""
    return keep_lines(split_texts(texts))


def split_texts(texts: DataFrame) -> DataFrame:
    """All lines of a table (source_text, text) as they are, numbered from 1."""
    return texts.select("source_text", F.posexplode(split_lines(F.col("text")))).select(
        F.col("col").alias("original_sentence"),
        "source_text",
        (F.col("pos") + 1).alias("offset"),
    )


def keep_lines(numbered: DataFrame) -> DataFrame:
    """Normalize the lines and drop those with nothing left."""
    return numbered.where(has_content(F.col("original_sentence"))).select(
        "original_sentence",
        normalize(F.col("original_sentence")).alias("normalized_sentence"),
        "source_text",
        "offset",
    )


def _relative(path, root: str):
    """Path below `root`, whatever scheme either of them is written with."""
    base = re.sub(_SCHEME, "", root if re.match(_SCHEME, root) else os.path.abspath(root))
    return F.substring(
        F.regexp_replace(path, _SCHEME, ""), F.lit(len(base.rstrip("/")) + 2), F.lit(1 << 20)
    )


def read_text_tree(
    spark: SparkSession, root: str, whole_file_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """Lines of all `*.txt` files below `root`, at any depth.

    Invalid UTF-8 becomes U+FFFD. Files up to `whole_file_bytes` are one row each; larger
    ones are read in splits, so a file of any size spreads over the cluster.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": TEXT_GLOB}
    files = spark.read.format("binaryFile").options(**options).load(root)
    whole = files.where(F.col("length") <= whole_file_bytes).select(
        _relative(F.col("path"), root).alias("source_text"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )
    lines = lines_of(spread(whole))
    # Reads the file listing only: the content column is not asked for.
    if files.where(F.col("length") > whole_file_bytes).select("length").limit(1).count():
        lines = lines.unionByName(_read_in_splits(spark, root, options, whole_file_bytes))
    return lines


def _read_in_splits(
    spark: SparkSession, root: str, options: dict, more_than: int
) -> DataFrame:
    """Lines of large files, numbered without ever gathering a file.

    A split's lines carry consecutive ids, so a line's number is its id's distance from
    the split's first id plus the lines of the splits before it.
    """
    rows = (
        spark.read.options(**options)
        .text(root)
        .select(
            F.make_valid_utf8("value").alias("original_sentence"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("_metadata.file_size").alias("_size"),
        )
        .where(F.col("_size") > more_than)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    blocks = rows.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first")
    )
    # One row per split: a file has size / split size of them.
    starts = blocks.select(
        "_file",
        "_block",
        F.expr(
            "coalesce(sum(_lines) over (partition by _file order by _block "
            "rows between unbounded preceding and 1 preceding), 0) - _first + 1"
        ).alias("_shift"),
    )
    # The metadata path is percent-encoded; a plus sign in it stands for itself.
    path = F.url_decode(F.regexp_replace("_file", r"\+", "%2B"))
    return keep_lines(
        rows.join(starts, ["_file", "_block"]).select(
            "original_sentence",
            _relative(path, root).alias("source_text"),
            (F.col("_row") + F.col("_shift")).cast("int").alias("offset"),
        )
    )


def corpus_alphabet(lines: DataFrame) -> DataFrame:
    """One row: the sorted distinct characters of the normalized lines."""
    known = sorted(" " + KEPT)
    held = [F.bool_or(F.contains("normalized_sentence", F.lit(letter))) for letter in known]
    letters = F.array(*[F.when(found, F.lit(letter)) for letter, found in zip(known, held, strict=True)])
    # A missing letter is a null, which is left out.
    return lines.agg(F.array_join(letters, "").alias("alphabet"))


def corpus_stats(lines: DataFrame) -> DataFrame:
    """One row: retained lines and distinct words, in one pass."""
    words = lines.select(
        F.posexplode(F.array_distinct(F.split("normalized_sentence", " "))).alias("place", "word")
    )
    return words.agg(
        F.count_if(F.col("place") == 0).alias("sentences"),
        F.count_distinct("word").alias("distinct_words"),
    )
