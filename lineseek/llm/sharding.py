"""Shards of nearly equal bytes by histogram sort: probe, refine, exchange once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.common import join_counted, row_key, whole
from lineseek.runtime import broadcast_if_small, materialize

SHARDS = 8
PROBES = 15
TOLERANCE = 0.002
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
# Rows numbered in one task; parts of a shard are as many as that takes.
PART_ROWS = 20_000
MOST_PART_BITS = 16


def keyed(rows: DataFrame) -> DataFrame:
    """Add `_key` to stored rows with `_same` (equal for rows alike in id and text) and `_uid`.

    The sort key is a hash of `_same` and of a number, from 0, that tells rows alike apart.
    Such rows are numbered from their counts in each partition of `_uid`, so that no task
    sees more of a group than one partition held; reruns give the same keys.
    """
    several = materialize(rows.groupBy("_same").agg(F.count("*").alias("_uses")).where("_uses > 1"))
    mark = join_counted(rows, several.withColumn("_one", F.lit(True)), "_same", "_uses")
    part = F.shiftright("_uid", 33).alias("_p")
    alike = materialize(mark.select(*rows.columns, part))
    counts = alike.groupBy("_same", "_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_same").orderBy("_p")) - F.col("_c")
    starts = counts.select("_same", "_p", before.alias("_start"))
    own = F.row_number().over(Window.partitionBy("_same", "_p").orderBy("_uid")) - 1
    numbered_ = alike.withColumn("_own", own).join(starts, ["_same", "_p"])
    single = rows.join(broadcast_if_small(several.select("_same")), "_same", "left_anti")
    key_of = lambda number: F.xxhash64("_same", number.cast("long"))
    return single.withColumn("_key", key_of(F.lit(0))).unionByName(
        numbered_.withColumn("_key", key_of(F.col("_start") + F.col("_own"))).select(*rows.columns, "_key")
    )


def bytes_of(text: Column) -> Column:
    return (F.octet_length(whole(text)) + 1).cast("long")


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """Keys that cut (key, size) rows into shards of equal size, as near as asked.

    Each round counts exactly, in all partitions at once, the bytes below every probe in the
    open intervals, and keeps the piece that holds the cut. A splitter is settled when its
    count is within `tolerance` of a shard, or when its interval holds no key to part.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    aims = [total * k / shards for k in range(1, shards)]
    # Interval of each splitter: bytes below `low` are at most the aim, below `high` at least.
    state = [{"low": LOWEST, "below": 0, "high": HIGHEST, "above": total, "rows": None} for _ in aims]
    slack = max(1.0, tolerance * total / shards)
    cut = [None] * len(aims)
    while any(c is None for c in cut):
        probes = set()
        for s, c in zip(state, cut):
            if c is None:
                width = s["high"] - s["low"]
                probes |= {s["low"] + max(1, width * k // (PROBES + 1)) for k in range(1, PROBES + 1)}
        listed = sorted(p for p in probes if LOWEST < p < HIGHEST)
        counted = keys.groupBy(slot_of(F.col("key"), listed).alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("c")).collect()
        of = {row["b"]: (row["n"], row["c"]) for row in counted}
        running, rows, below = 0, 0, {LOWEST: (0, 0)}
        for k, probe in enumerate(listed):
            running, rows = running + of.get(k, (0, 0))[0], rows + of.get(k, (0, 0))[1]
            below[probe] = running, rows
        below[HIGHEST] = total, sum(c for _, c in of.values())
        for k, aim in enumerate(aims):
            if cut[k] is not None:
                continue
            s = state[k]
            for probe in listed:
                if s["low"] < probe < s["high"]:
                    if below[probe][0] <= aim:
                        s["low"], s["below"] = probe, below[probe][0]
                    else:
                        s["high"], s["above"] = probe, below[probe][0]
                        break
            # Only where both ends were counted this round is the number of rows between known.
            if s["low"] in below and s["high"] in below:
                s["rows"] = below[s["high"]][1] - below[s["low"]][1]
            near = (aim - s["below"], s["low"]) if aim - s["below"] <= s["above"] - aim else (s["above"] - aim, s["high"])
            if near[0] <= slack or s["high"] - s["low"] <= 1 or (s["rows"] is not None and s["rows"] <= 1):
                cut[k] = near[1]
    return sorted(cut)


def slot_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most `value`, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < bounds[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(bounds))


def numbered(placed: DataFrame, n_rows: int) -> DataFrame:
    """Add `slot`, gapless from 0 in every `shard`, in key order.

    A shard is numbered in parts by key; a part starts where the counts of the parts before
    it end. No task sees a whole shard.
    """
    bits = min(MOST_PART_BITS, max(0, (n_rows // PART_ROWS).bit_length()))
    part = F.shiftright("_key", 64 - bits).cast("int") if bits else F.lit(0)
    placed = placed.withColumn("_part", part)
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    starts = counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), before.alias("_start"))
    own = Window.partitionBy("shard", "_part").orderBy("_key")
    joined = placed.withColumn("_own", F.row_number().over(own)).join(
        F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p"))
    )
    return joined.withColumn("slot", (F.col("_start") + F.col("_own") - 1).cast("long"))


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Stored `rows` with `_key` and `size`, given their `shard` and `slot`."""
    cuts = splitters(rows.select(F.col("_key").alias("key"), "size"), shards)
    return numbered(rows.withColumn("shard", slot_of(F.col("_key"), cuts).cast("int")), rows.count())


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is `bytes`. A null text has size 1 and the checksum of no bytes. Copies of a
    text spread over all shards, also rows alike in id and text. Empty tables return no rows.
    """
    text = F.col("text")
    crc = F.crc32(whole(text).cast("binary")).alias("text_crc32")
    light = docs.select("doc_id", bytes_of(text).alias("size"), crc, row_key(F.col("doc_id"), text).alias("_same"))
    light = materialize(light.withColumn("_uid", F.monotonically_increasing_id()))
    return assign(materialize(keyed(light).drop("_same", "_uid")), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of `docs`, with `shard_id` and `shard_slot`; names taken already get a `_` before.

    Keys, cuts and slots are worked out on light rows; the documents are then moved once, to
    their shard's parts, in slot order. Copies of a document lie anywhere in any shard.
    """
    names = {}
    for name in ("shard_id", "shard_slot"):
        taken = {c.lower() for c in docs.columns}
        names[name] = name
        while names[name].lower() in taken:
            names[name] = f"_{names[name]}"
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    same = row_key(F.col("doc_id"), F.col("text")).alias("_same")
    inner = docs.select(row, bytes_of(F.col("text")).alias("size"), same)
    inner = materialize(inner.withColumn("_uid", F.monotonically_increasing_id()))
    light = materialize(keyed(inner.select("_same", "_uid", "size")))
    placed = materialize(assign(light, shards).select("_uid", "shard", "slot"))
    out = inner.select("_uid", "_row").join(broadcast_if_small(placed), "_uid")
    out = out.repartition("shard", F.expr(f"slot div {PART_ROWS}")).sortWithinPartitions("shard", "slot")
    return out.select("_row.*", F.col("shard").alias(names["shard_id"]), F.col("slot").alias(names["shard_slot"]))
