"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import WORD_BYTES, row_key
from lineseek.llm.components import components
from lineseek.runtime import materialize

BITS = 64
RADIUS = 3
SHINGLE = 3
HASH_SEED = 42
CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingle hashes; zero for a text without words."""
    found = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return 0
    count = max(len(found) - shingle + 1, 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for begin in range(0, count, CHUNK):
        end = min(begin + CHUNK, count)
        parts = [found[begin + j : end + j] for j in range(shingle)] if len(found) >= shingle else [[b" ".join(found)]]
        hashes = np.array([digest(b" ".join(p), HASH_SEED) for p in zip(*parts)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in range(BITS) if 2 * ones[k] > count)


def masks(radius: int = RADIUS, seed: int = 5) -> list[int]:
    """2 ** (radius + 1) - 1 masks that cover the radius.

    Every bit gets a nonzero vector of radius + 1 bits; the mask of a nonzero vector v keeps
    the bits whose vectors have an odd product with v. Any `radius` bits leave some v that
    all of them are even with, so two fingerprints that differ in these bits agree under
    that mask. Vectors are dealt evenly, so all masks keep about half of the bits.
    """
    vectors = [1 + k % ((1 << radius + 1) - 1) for k in range(BITS)]
    vectors = [vectors[k] for k in np.random.default_rng(seed).permutation(BITS)]
    return [sum(1 << k for k in range(BITS) if (vectors[k] & v).bit_count() % 2) for v in range(1, 1 << radius + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def spanning_edges(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links of at most `radius` bits connect; fewer than values."""
    labels = np.arange(len(values))
    edges = []
    for k in range(len(values) - 1):
        near = k + 1 + np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius)
        near = near[labels[near] != labels[k]]
        if len(near):
            others, first = np.unique(labels[near], return_index=True)
            edges += [(int(values[k]), int(values[j])) for j in near[first]]
            labels[np.isin(labels, others)] = labels[k]
    return edges


def bucket_edges(radius: int):
    """Walk rows sorted by (table, key); each bucket gives its spanning edges.

    A bucket never gives more edges than it has fingerprints. Only one bucket, of distinct
    8-byte fingerprints, is held at a time.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            rows = np.column_stack([batch["t"].to_numpy(np.int64), batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64)])
            if tail is not None:
                rows = np.concatenate([tail, rows])
            starts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            tail = rows[starts[-1] :]
            yield edges_of(rows[: starts[-1]], starts)
        if tail is not None:
            yield edges_of(tail, np.array([0, len(tail)]))

    def edges_of(rows: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        found = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a > 1:
                found += spanning_edges(rows[a:b, 2].astype(np.uint64), radius)
        return pd.DataFrame([(signed(x), signed(y)) for x, y in found], columns=["src", "dst"], dtype="int64")

    return walk


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    @F.pandas_udf("long")
    def prints(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([signed(fingerprint(t)) for t in texts], dtype="int64")

    return docs.select(*keep, prints("text").alias("fp"))


def near_edges(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): links of distinct fingerprints that span those within the radius."""
    spark = values.sparkSession
    tables = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks(radius)))))
    keyed = values.select("fp", tables.alias("b")).select("b.t", "b.key", "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(parts, "t", "key").sortWithinPartitions("t", "key", "fp")
    return ordered.mapInPandas(bucket_edges(radius), "src long, dst long")


def link(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): components of distinct fingerprints, only those with a link."""
    return components(near_edges(values, radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def classes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` of every row with fp and component_id, the smallest doc_id of its component.

    Null ids join components but name none unless all are null. Rows with one fingerprint
    are one node, so thousands of copies make no pair.
    """
    prints = materialize(fingerprints(docs, ["doc_id", *keep]))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = link(distinct.select("fp"))
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = named.join(first, "root").select("fp", "component_id", "root")
    return prints.join(owner, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits), component_id of every row.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated
    rows share a component. An empty table returns no rows.
    """
    return classes(docs, []).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of every component, with all columns, whatever their names: the first by doc_id, then by text."""
    all_columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    rows = docs.select("doc_id", "text", all_columns, row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    keyed = classes(rows.select("doc_id", "text", "_row"), ["_row"])
    best = keyed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("b"))
    best = best.select(F.col("b._row").alias("_best"))
    kept = rows.select("_all", "_row").join(best, F.col("_row") == F.col("_best"), "left_semi")
    return kept.dropDuplicates(["_row"]).select("_all.*")
