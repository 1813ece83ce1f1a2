"""Dense global numbering and top-k per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.runtime import materialize, shuffle_parts

# Lines are numbered in this order, and equal scores are ranked in it.
LINE_ORDER = ("normalized_sentence", "source_text", "offset")


def number_rows(df: DataFrame, order: tuple, column: str) -> DataFrame:
    """Add a dense 0-based rank over the whole table without a one-task window.

    Rows are range-partitioned and sorted; the row counts of the partitions before give
    the rank a partition starts from. `order` must name a unique key so that equal leading
    columns still spread over partitions. The sorted rows are stored before they are
    counted: range bounds are sampled, and a redone task must meet the same ones.
    """
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    ranged = materialize(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: bounded by the partition count, not by the data.
    starts = materialize(
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
        .select(
            "_part",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    return ranged.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias(column)
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Give every line its `line_id`: the place in the order ties are broken by."""
    return number_rows(lines, LINE_ORDER, "line_id")


def top_k(hits: DataFrame, k: int, scores: int | None = None) -> DataFrame:
    """Best `k` lines per `query` from hits (query, line_id, score), with their `rank`.

    Hits may name a line more than once. In a first step every line keeps its best score:
    repeats go in the task that finds them, and what is left is dealt by query and line, so
    that the lines of one query spread over all tasks (no shuffle at all where the lines were
    dealt by `line_id`). In the second step each task sends on at most `k` lines of a query
    (`row_number` is a limit that Spark applies before the shuffle on `query`).

    Where a query can have no more than `scores` different scores, the lines need not be dealt
    first: its best `k` lines are among the best `k * scores` pairs of score and line, as none of
    these lines has more than `scores` of them. Each task sends on only its own best pairs.
    """
    if scores is not None:
        pairs = Window.partitionBy("query").orderBy(F.desc("score"), "line_id")
        hits = hits.withColumn("_pair", F.dense_rank().over(pairs)).where(F.col("_pair") <= k * scores)
    best = hits.groupBy("query", "line_id").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "line_id")
    return best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
