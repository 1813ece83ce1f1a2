"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.runtime import materialize

SHORTEST = 5
COVERAGE = 0.8
# Benchmark characters broadcast at a time; a larger benchmark takes more passes.
SLICE_CHARS = 8_000_000
TOKEN = regex.compile(r"[\p{L}\p{N}]+")
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin value of every window, rolled over all places at once."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    # Wrapping sums of mixed ids; equal windows are compared token by token later.
    mixed = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    power, value = np.uint64(1), np.zeros(count, np.uint64)
    for j in range(size - 1, -1, -1):
        value += mixed[j : j + count] * power
        power = np.uint64(int(power) * BASE & MASK)
    return value


def tile(item: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length): longest unmarked common runs first.

    Ties go to the earliest place in the item, then in the document. Each token lies in
    at most one tile.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)

    def common(size: int) -> list[tuple[int, int]]:
        places: dict[int, list[int]] = {}
        hashes = window_hashes(item, size)
        for start in range(len(hashes)):
            if free_item[start : start + size].all():
                places.setdefault(int(hashes[start]), []).append(start)
        if not places:
            return []
        values = window_hashes(doc, size)
        return sorted(
            (start, at)
            for at in np.flatnonzero(np.isin(values, np.array(list(places), np.uint64))).tolist()
            if free_doc[at : at + size].all()
            for start in places[int(values[at])]
            if (item[start : start + size] == doc[at : at + size]).all()
        )

    tiles, longest = [], min(len(item), len(doc))
    while longest >= shortest:
        # A free common run of n tokens holds one of n - 1, so its length can be bisected.
        low, high = shortest - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        if low < shortest:
            break
        for start, at in common(low):
            if free_item[start : start + low].all() and free_doc[at : at + low].all():
                free_item[start : start + low] = False
                free_doc[at : at + low] = False
                tiles.append((start, at, low))
        longest = low - 1
    return tiles


class Slice:
    """Token numbers, tokens and seeds of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], shortest: int):
        self.shortest = shortest
        self.number: dict[str, int] = {}
        self.items = []
        seeds: list[tuple[np.ndarray, np.ndarray]] = []
        for item_id, text in items:
            ids = np.array([self.number.setdefault(t, len(self.number) + 1) for t in tokens(text)], np.int64)
            if not len(ids):
                continue
            # An item shorter than a seed is its own seed.
            width = min(shortest, len(ids))
            seeds.append((np.unique(window_hashes(ids, width)), np.array([len(self.items), width])))
            self.items.append((item_id, ids))
        self.widths = sorted({int(about[1]) for _, about in seeds})
        self.seeds = {}
        for width in self.widths:
            own = [(s, about[0]) for s, about in seeds if about[1] == width]
            values = np.concatenate([s for s, _ in own])
            owners = np.concatenate([np.full(len(s), k) for s, k in own])
            order = np.argsort(values, kind="stable")
            self.seeds[width] = values[order], owners[order]

    def matches(self, text: str | None, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, item tokens, covered tokens, tiles) of the items that the text holds."""
        get = self.number.get
        ids = np.array([get(t, 0) for t in tokens(text)], np.int64)
        for width in self.widths:
            values, owners = self.seeds[width]
            mine = window_hashes(ids, width)
            left = np.searchsorted(values, mine, "left")
            hits = np.flatnonzero(left < np.searchsorted(values, mine, "right"))
            places: dict[int, list[int]] = {}
            for at in hits.tolist():
                k = left[at]
                while k < len(values) and values[k] == mine[at]:
                    places.setdefault(int(owners[k]), []).append(at)
                    k += 1
            for owner, starts in places.items():
                item_id, item = self.items[owner]
                # Only tokens on shared seeds can lie in tiles: first what that allows at most.
                reach = np.zeros(len(item), bool)
                for at in np.flatnonzero(np.isin(window_hashes(item, width), mine[starts])):
                    reach[at : at + width] = True
                if reach.sum() < coverage * len(item):
                    continue
                # Then the document's own such tokens; the others become breaks.
                keep = np.zeros(len(ids) + 1, bool)
                for j in range(width):
                    keep[np.array(starts) + j] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[False], keep]).astype(np.int8)))
                runs = [ids[a:b] for a, b in zip(edges[::2], edges[1::2])]
                joined = np.concatenate([part for run in runs for part in (run, np.array([-1]))])
                tiles = tile(item, joined, width)
                covered = sum(size for _, _, size in tiles)
                if covered >= coverage * len(item):
                    yield item_id, len(item), covered, len(tiles)


def slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in id order, a bounded number of characters at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row["text"]) > limit:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if held:
        yield held


SCHEMA = "doc_id long, item_id long, n_item_tokens long, n_covered long, n_tiles long, row_hash long"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    shortest: int = SHORTEST,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """Documents that hold at least `coverage` of a benchmark item in tiles of `shortest` tokens.

    Returns doc_id, item_id, n_item_tokens, n_covered, n_tiles, row_hash (of the text), a
    row per pair. Tokens are lower-case runs of letters and digits. Items shorter than
    `shortest` must occur whole. Null or token-free texts and items match nothing; repeated
    rows are answered each; ids may be null. The documents are never shuffled: each slice
    of the benchmark, of bounded size, is one pass whose few results are stored.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    found = None
    for items in slices(benchmark, slice_chars):
        shared = spark.sparkContext.broadcast((items, shortest))

        def search(batches, shared=shared):
            part = Slice(*shared.value)
            for batch in batches:
                rows = [
                    (doc_id, *match, row_hash)
                    for doc_id, text, row_hash in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["row_hash"])
                    for match in part.matches(text, coverage)
                ]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        one = materialize(source.mapInPandas(search, SCHEMA))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, with all their columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_h"])
    return docs.join(bad, same, "left_anti")
