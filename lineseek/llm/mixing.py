"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.common import row_key, words
from lineseek.runtime import materialize

BLOCKS = 512
SHARDS = 8
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 11


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Share all words by weight; what exceeds `most` times a source's size is shared again."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if unit * weights[k] > most * sizes[k]}
        for k in full or open_:
            out[k] = float(most * sizes[k]) if full else unit * weights[k]
        if not full:
            break
        left -= sum(out[k] for k in full)
        open_ -= full
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Deal block quotas to shards, halving the shards at every node of a tree.

    The left half of a node draws its blocks without replacement from all of the node's,
    so every shard has a hypergeometric share of each source and nothing is left over.
    """
    if shards == 1:
        yield quotas
        return
    left = shards // 2
    drawn, total, need = np.zeros_like(quotas), int(quotas.sum()), int(quotas.sum()) * left // shards
    for k, quota in enumerate(quotas.tolist()):
        if need and quota:
            take = int(rng.hypergeometric(quota, total - quota, need)) if total > quota else need
            drawn[k], need = take, need - take
        total -= quota
    yield from split_quotas(drawn, left, rng)
    yield from split_quotas(quotas - drawn, shards - left, rng)


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with their size, key, and block; the block is a permuted place in the source."""
    key = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(
        *keep, "source", F.size(words(F.col("text"))).cast("long").alias("_size"), F.xxhash64(F.lit(SEED), key).alias("_place")
    ).withColumn("_block", F.pmod(F.col("_place"), F.lit(BLOCKS)).cast("int"))


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): targets of the sources, and what each block gives.

    Sizes of sources come to the driver, a row each; sources are named categories. Blocks
    are at most BLOCKS per source. A block gives `passes` whole passes, one more if it lies
    before the cut, and up to `rest` words more if the cut falls into it.
    """
    spark = rows.sparkSession
    blocks = materialize(rows.groupBy("source", "_block").agg(F.sum("_size").alias("_words")))
    listed = blocks.groupBy("source").agg(F.sum("_words").alias("n")).collect()
    # Code points order as UTF-8 bytes; null comes last.
    listed.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["n"] for r in listed], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(listed))])
    sources = spark.createDataFrame(
        [(r["source"], int(r["n"]), t) for r, t in zip(listed, aims)], "source string, source_size long, target double"
    )
    order = Window.partitionBy("source").orderBy("_block")
    passes = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.round(F.col("target") - passes * F.col("source_size")).cast("long")
    placed = (
        blocks.withColumn("_after", F.sum("_words").over(order))
        .join(F.broadcast(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "_block", "_words", "_after", passes.cast("int").alias("_passes"), rest.alias("_rest"))
    )
    cut = F.col("_after") - F.col("_words")
    return sources, placed.select(
        F.col("source").alias("_bs"),
        F.col("_block").alias("_bb"),
        (F.col("_passes") + (F.col("_after") <= F.col("_rest")).cast("int")).alias("_repeats"),
        F.when((cut < F.col("_rest")) & (F.col("_after") > F.col("_rest")), F.col("_rest") - cut).alias("_room"),
    )


def shards_of_blocks(blocks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Give every drawn pass of a block one shard: (source, block, pass) -> shard.

    The tree deals quotas, then each shard takes the next of the source's permuted passes.
    """
    spark = blocks.sparkSession
    drawn = F.col("_repeats") + F.col("_room").isNotNull().cast("int")
    quotas = blocks.groupBy("_bs").agg(F.sum(drawn).alias("n")).collect()
    quotas.sort(key=lambda r: (r["_bs"] is None, r["_bs"] or ""))
    dealt = list(split_quotas(np.array([int(r["n"] or 0) for r in quotas], np.int64), shards, np.random.default_rng(SEED)))
    ranges = []
    for k, row in enumerate(quotas):
        at = 0
        for shard, own in enumerate(dealt):
            ranges.append((row["_bs"], shard, at, at + int(own[k])))
            at += int(own[k])
    bounds = spark.createDataFrame(ranges, "_rs string, _shard int, _from long, _to long")
    passes = blocks.where(drawn > 0).select("_bs", "_bb", F.explode(F.sequence(F.lit(1), drawn)).alias("_pass"))
    order = Window.partitionBy("_bs").orderBy(F.xxhash64(F.lit(SEED), "_bb", "_pass"), "_bb", "_pass")
    placed = passes.withColumn("_n", F.row_number().over(order) - 1)
    inside = F.col("_bs").eqNullSafe(F.col("_rs")) & (F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_to"))
    return placed.join(F.broadcast(bounds), inside).select("_bs", "_bb", "_pass", "_shard")


def dealt(docs: DataFrame, keep: list[str], shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(rows with `_draws`, sources). A draw is a pass over a row that the tree gave to a shard.

    Blocks are dealt whole; of a cut block's last pass only the rows before the cut are drawn.
    `_order` is a permuted place in the shard.
    """
    light = materialize(sized(docs, []))
    sources, blocks = plan(light)
    blocks = materialize(blocks)
    passes = shards_of_blocks(blocks, shards).groupBy(F.col("_bs").alias("_ds"), F.col("_bb").alias("_db")).agg(
        F.sort_array(F.collect_list(F.struct("_pass", "_shard"))).alias("_passes")
    )
    here = F.col("_bs").eqNullSafe(F.col("_ds")) & (F.col("_bb") == F.col("_db"))
    cut = F.when(F.col("_room").isNotNull(), F.col("_repeats") + 1)
    given = materialize(blocks.join(passes, here, "left").select("_bs", "_bb", "_passes", "_room", cut.alias("_cut")))
    own = F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb"))
    rows = sized(docs, keep).join(F.broadcast(given), own)
    # One block of each source at most has room: a five-hundredth of the source's rows.
    inside = light.join(F.broadcast(given.where("_room is not null")), own)
    totals = inside.groupBy("_bs", "_place").agg(F.sum("_size").alias("_n"), F.first("_room").alias("_room"))
    order = Window.partitionBy("_bs").orderBy("_place")
    # Rows up to the one that crosses the cut; it goes in if that comes nearer to the target.
    after = F.sum("_n").over(order)
    taken = totals.withColumn("_sum", after).where(2 * F.col("_sum") - F.col("_n") <= 2 * F.col("_room"))
    taken = taken.select(F.col("_bs").alias("_ts"), F.col("_place").alias("_tp")).distinct()
    rows = rows.join(taken, F.col("source").eqNullSafe(F.col("_ts")) & (F.col("_place") == F.col("_tp")), "left")
    drawn = F.filter("_passes", lambda p: F.col("_tp").isNotNull() | F.col("_cut").isNull() | (p["_pass"] < F.col("_cut")))
    placed = F.transform(
        drawn, lambda p: F.struct(p["_pass"].alias("_pass"), p["_shard"].alias("_shard"), F.xxhash64("_place", p["_pass"]).alias("_order"))
    )
    none = F.array().cast("array<struct<_pass:int,_shard:int,_order:bigint>>")
    return rows.withColumn("_draws", F.coalesce(placed, none)), sources


def mix_counts(docs: DataFrame) -> DataFrame:
    """Return doc_id, size, source_size, target, taken, n_repeats, draws of every document.

    `draws` lists shard:order of every pass that the tree dealt; their number is n_repeats.
    Null texts have size 0 and take nothing. A null source is a source of its own, last in
    order. Rows equal in id and text share one place and are taken alike; a source of no
    words has target 0. An empty table returns no rows.
    """
    rows, sources = dealt(docs, ["doc_id"])
    return rows.join(
        F.broadcast(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))
    ).select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.size("_draws")).cast("long").alias("taken"),
        F.size("_draws").alias("n_repeats"),
        F.array_join(F.transform("_draws", lambda d: F.concat_ws(":", d["_shard"], d["_order"])), ",").alias("draws"),
    )


def _mixed(docs: DataFrame, shards: int) -> DataFrame:
    """A row per drawn document: all its columns in `_all`, and its `_shard` and `_order`."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    rows, _ = dealt(docs.select("doc_id", "text", "source", row), ["_all"], shards)
    return rows.withColumn("_d", F.explode("_draws")).select("_all", "_d._shard", "_d._order")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mixed corpus: a row per drawn document, all columns, with `_shard` and `_order`.

    Sorting a shard by `_order` is its local shuffle. Where `docs` has columns of these
    names, the two get a further `_` before.
    """
    names = {}
    for name in ("_shard", "_order"):
        names[name] = name
        while names[name].lower() in {c.lower() for c in docs.columns}:
            names[name] = f"_{names[name]}"
    return _mixed(docs, shards).select("_all.*", *(F.col(old).alias(new) for old, new in names.items()))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of `docs` only, shard after shard, each in its shuffled order."""
    return _mixed(docs, SHARDS).orderBy("_shard", "_order").select("_all.*")
