"""Running values along ordered rows of groups of any length.

All rows are ordered by group and place and numbered once. Blocks of so many consecutive
numbers are worked on alone, whichever groups they hold, so a task's share is bounded by
rows and neither by a group nor by how its order column is spaced. What a block hands on is
one row; these rows are scanned in the same way, block of blocks by block of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.operators.ranking import number_rows
from lineseek.runtime import materialize

# Consecutive rows worked on together.
BLOCK_ROWS = 1024


def in_order(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Add `_place`, dense from 0; `order` starts with the group and names a unique key."""
    return number_rows(rows, order, "_place")


def _block(size: int) -> Column:
    return F.expr(f"_place div {size}")


def _window(*more: str):
    return Window.partitionBy("_block", *more).orderBy("_place")


def _same_group_before(group: str, size: int) -> Column:
    """False at a row whose predecessor in the block is of another group; true at a block's first."""
    first = F.col("_place") % size == 0
    return first | F.lag(group).over(_window()).eqNullSafe(F.col(group))


def running_text(placed: DataFrame, group: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `_text`: the `_piece`s of the group's rows so far, since the last with `_reset`, joined.

    Two neighbouring stretches combine to one (a stretch with a reset or a change of group
    replaces what it is handed, any other appends to it), which is what lets blocks be
    worked on at once.
    """
    last = placed.agg(F.max("_place")).first()[0]
    return _scan(placed, group, block_rows, 0 if last is None else last + 1)


def _scan(placed: DataFrame, group: str, size: int, count: int) -> DataFrame:
    until_here = (Window.unboundedPreceding, Window.currentRow)
    blocked = placed.withColumn("_block", _block(size))
    turns = blocked.withColumn(
        "_turn", (F.col("_reset") | ~_same_group_before(group, size)).cast("int")
    ).withColumn("_turns", F.sum("_turn").over(_window().rowsBetween(*until_here)))
    parts = F.collect_list("_piece").over(_window("_turns").rowsBetween(*until_here))
    local = turns.withColumn("_text", F.array_join(parts, ""))
    if count <= size:
        return local.drop("_block", "_turn", "_turns")
    # A block's last row stands for the block; an unfinished one hands nothing on.
    ends = local.where(F.col("_place") % size == size - 1).select(
        F.col("_block").alias("_place"),
        group,
        (F.col("_turns") > 0).alias("_reset"),
        F.col("_text").alias("_piece"),
    )
    handed = _scan(materialize(ends), group, size, count // size).select(
        (F.col("_place") + 1).alias("_block"),
        F.col(group).alias("_of"),
        F.col("_text").alias("_before"),
    )
    goes_on = (F.col("_turns") == 0) & F.col(group).eqNullSafe(F.col("_of"))
    text = F.when(goes_on, F.concat(F.coalesce("_before", F.lit("")), "_text")).otherwise(F.col("_text"))
    return (
        local.join(handed, "_block", "left")
        .withColumn("_text", text)
        .drop("_block", "_turn", "_turns", "_of", "_before")
    )


def equals_previous(
    placed: DataFrame, group: str, value: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add `_repeats`: whether the row before it in its group holds the same `value` (or null too)."""
    blocked = placed.withColumn("_block", _block(block_rows))
    ends = blocked.where(F.col("_place") % block_rows == block_rows - 1).select(
        (F.col("_block") + 1).alias("_block"),
        F.struct(F.col(group).alias("g"), F.col(value).alias("v")).alias("_end"),
    )
    before = F.coalesce(
        F.lag(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))).over(_window()), F.col("_end")
    )
    return (
        blocked.join(ends, "_block", "left")
        .withColumn("_before", before)
        .withColumn(
            "_repeats",
            F.col("_before").isNotNull()
            & F.col("_before.g").eqNullSafe(F.col(group))
            & F.col("_before.v").eqNullSafe(F.col(value)),
        )
        .drop("_block", "_end", "_before")
    )
