"""Exact search for repeated windows of symbols (bytes or words) by shared anchors.

Every window of `length` symbols names the smallest hash among its grams, its anchor.
Equal windows name equal anchors at equal places, so only windows with a common anchor can
be equal. Neighbouring windows with one anchor form a segment: a document has few of them.

A range of windows has a hull, all symbols of its windows, and a core, those that each of
its windows holds. Equal hulls settle all their windows at once; a core that only one hull
has settles that none of its windows is repeated. Where neither does, one range of each
hull is cut into finer ones, down to single windows. No pair of occurrences is ever made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import WORD_BYTES
from lineseek.runtime import materialize

NO_ID = (1 << 63) - 1
PLACE_BITS = 20
STRIDE = 1 << 19
# Windows in a range of each round of cutting; the last must be 1.
WIDTHS = (64, 8, 1)
# About as many found rows are held in a task before they are passed on.
HELD_ROWS = 20_000


@dataclass(frozen=True)
class Unit:
    """What a symbol is, how many make a window, and how many a gram.

    A gram has a power of two of words, or eight times one of bytes.
    """

    of_words: bool
    length: int
    gram: int


class Text:
    """Symbols of one text: where each begins and ends in `data`."""

    def __init__(self, text: str | bytes | None, unit: Unit):
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        self.unit = unit
        if unit.of_words:
            self.words = re.findall(WORD_BYTES, raw)
            self.data = b" ".join(self.words)
            sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
            self.ends = np.cumsum(sizes + 1) - 1
            self.starts = self.ends - sizes
            self.count = len(self.words)
        else:
            self.data, self.count = raw, len(raw)

    def grams(self, begin: int, end: int) -> np.ndarray:
        """Hashes of the grams that start at symbols `begin` to `end`, by doubling their size."""
        many = np.uint64(0x9E3779B97F4A7C15)
        if self.unit.of_words:
            part = self.words[begin : end + self.unit.gram - 1]
            out, size = np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part)), 1
        else:
            raw = np.frombuffer(self.data, np.uint8)[begin : end + self.unit.gram - 1]
            out = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel() * many
            out, size = out ^ (out >> np.uint64(29)), 8
        while size < self.unit.gram:
            out = (out[:-size] ^ (out[size:] >> np.uint64(7))) * many + out[size:]
            out ^= out >> np.uint64(29)
            size *= 2
        return out

    def part(self, first: int, last: int) -> bytes:
        """Symbols `first` to `last`, the last one not included, as a text of their own."""
        if self.unit.of_words:
            return self.data[self.starts[first] : self.ends[last - 1]]
        return self.data[first:last]

    def digest(self, first: int, last: int) -> bytes:
        return xxhash.xxh3_128_digest(self.part(first, last))

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, first window, last window, anchor's place in the first) arrays.

        A long text comes in several parts.
        """
        length, gram = self.unit.length, self.unit.gram
        width = length - gram + 1
        for begin in range(0, self.count - length + 1, STRIDE):
            windows = min(STRIDE, self.count - length + 1 - begin)
            hashes = self.grams(begin, begin + windows + width - 1)
            packed = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
            place = (sliding_minimum(packed, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            last = np.append(first[1:], windows) - 1
            yield hashes[place[first]].view(np.int64), first + begin, last + begin, place[first] - first


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window in two passes, from both sides of blocks of `width`."""
    count = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what names a row: `did` (null ids last) and the hash of its text."""
    return docs.select(
        "doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("rid")
    )


def occurrences(rows: DataFrame, unit: Unit, passes=None) -> DataFrame:
    """(key, hull, did, rid, first, last, ahead) of every segment whose anchor `passes` lets through.

    The key is the anchor, `ahead` its place in the first window.
    """

    def find(batches):
        test = passes() if passes else None
        for batch in batches:
            parts = {name: [] for name in ("key", "hull", "did", "rid", "first", "last", "ahead")}
            for text, did, rid in zip(batch["text"], batch["did"], batch["rid"]):
                held = Text(text, unit)
                for found in held.segments():
                    if test is not None:
                        keep = test(found[0])
                        found = [values[keep] for values in found]
                    for name, values in zip(("key", "first", "last", "ahead"), found):
                        parts[name].append(values)
                    parts["hull"] += [held.digest(a, b + unit.length) for a, b in zip(found[1].tolist(), found[2].tolist())]
                    parts["did"].append(np.full(len(found[0]), did))
                    parts["rid"].append(np.full(len(found[0]), rid))
            if parts["hull"]:
                yield pd.DataFrame({k: v if k == "hull" else np.concatenate(v) for k, v in parts.items()})

    schema = "key long, hull binary, did long, rid long, first int, last int, ahead int"
    return rows.select("text", "did", "rid").mapInPandas(find, schema)


def pieces(rows: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """(did, rid, base, ahead, last, data): the symbols of the wanted segments."""
    lists = wanted.groupBy("did", "rid").agg(F.collect_set(F.struct("first", "last", "ahead")).alias("own"))

    def copy(batches):
        for batch in batches:
            for text, did, rid, own in zip(batch["text"], batch["did"], batch["rid"], batch["own"]):
                held = Text(text, unit)
                yield pd.DataFrame(
                    [(did, rid, p["first"], p["ahead"], p["last"], held.part(p["first"], p["last"] + unit.length)) for p in own],
                    columns=["did", "rid", "base", "ahead", "last", "data"],
                )

    joined = rows.select("text", "did", "rid").join(lists, ["did", "rid"])
    return joined.mapInPandas(gathered(copy, 5_000), "did long, rid long, base int, ahead int, last int, data binary")


def finer(held: DataFrame, unit: Unit, width: int) -> DataFrame:
    """(key, hull, did, rid, base, first, last) of the ranges in `own`, cut every `width` windows.

    Cuts are counted from the anchor, so equal windows are in ranges alike. The key is the
    core of an uncut range, which the ends of a segment do not change.
    """
    farthest = unit.length - unit.gram
    names = ["key", "hull", "did", "rid", "base", "first", "last"]

    def cut(batches):
        for batch in batches:
            out = []
            for did, rid, base, ahead, data, own in zip(*(batch[c] for c in ("did", "rid", "base", "ahead", "data", "own"))):
                text = Text(data, unit)
                for part in own:
                    low, high = ahead - (part["last"] - base), ahead - (part["first"] - base)
                    for k in range(low // width, high // width + 1):
                        near, far = k * width, min(k * width + width - 1, farthest)
                        first, last = ahead - min(far, high), ahead - max(near, low)
                        core = text.digest(ahead - near, ahead - far + unit.length)
                        out.append((core, text.digest(first, last + unit.length), did, rid, base, base + first, base + last))
                if len(out) >= HELD_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return held.mapInPandas(cut, "key binary, hull binary, did long, rid long, base int, first int, last int")


def gathered(make, least: int = 20_000):
    """Put the small frames of `make` together, so that few are sent."""

    def run(batches):
        held, count = [], 0
        for frame in make(batches):
            held.append(frame)
            count += len(frame)
            if count >= least:
                yield pd.concat(held)
                held, count = [], 0
        if held:
            yield pd.concat(held)

    return run


def settled(found: DataFrame, other_document: bool) -> DataFrame:
    """Rows of `found` to remove (`gone`) or to look at more finely (`open`), with these flags.

    A hull that stands elsewhere goes: in a document of smaller id, or anywhere. Hulls that
    share a key with others are open; one occurrence of each speaks for all, except that
    those in the document of smallest id are not removed with the others and stay in.
    """
    here = F.struct("did", "rid", "first")
    hulls = found.groupBy("key", "hull").agg(F.count("*").alias("n"), F.min(here).alias("who"))
    hulls = materialize(hulls)
    several = F.min("who.did") < F.max("who.did") if other_document else F.count("*") > 1
    keys = hulls.groupBy("key").agg(several.alias("open"))
    wanted = hulls.join(keys.where("open"), "key", "left").where("open or n > 1")
    same = F.col("did") == F.col("who.did") if other_document else here == F.col("who")
    gone = F.col("did") > F.col("who.did") if other_document else F.col("n") > 1
    flagged = found.join(wanted, ["key", "hull"]).select(
        *(c for c in found.columns if c not in ("key", "hull")),
        gone.alias("gone"),
        (F.coalesce("open", F.lit(False)) & same).alias("open"),
    )
    return materialize(flagged.where("gone or open"))


def ranges(rows: DataFrame, unit: Unit, other_document: bool, passes=None) -> DataFrame:
    """(did, rid, own): what to remove of each document as lists of (first, after) symbols.

    With `other_document` a window goes if it starts in a document of smaller id as well,
    else if it starts anywhere else. Repeated rows stand for themselves in the first round,
    where their hulls are equal, so finer rounds need not tell them apart.
    """
    span = F.struct(F.col("first").alias("a"), (F.col("last") + unit.length).alias("b"))
    now = settled(materialize(occurrences(rows, unit, passes)), other_document)
    spans = now.where("gone").select("did", "rid", span.alias("span"))
    data = materialize(pieces(rows, now.where("open"), unit))
    whole = F.array(F.struct(F.col("base").alias("first"), "last"))
    held = data.withColumn("own", whole)
    for width in (w for w in WIDTHS if w == 1 or 2 * w <= unit.length - unit.gram):
        now = settled(materialize(finer(held, unit, width)), other_document)
        spans = spans.union(now.where("gone").select("did", "rid", span.alias("span")))
        own = now.where("open").groupBy("did", "rid", "base").agg(F.collect_set(F.struct("first", "last")).alias("own"))
        held = data.join(own, ["did", "rid", "base"])
    return spans.groupBy("did", "rid").agg(F.collect_set("span").alias("own"))


def removed(count: int, own) -> np.ndarray:
    """Mask of removed symbols: a sum of +1 at starts and -1 after ends."""
    change = np.zeros(count + 1, np.int64)
    for span in own if own is not None else ():
        change[span["a"]] += 1
        change[span["b"]] -= 1
    return np.cumsum(change)[:count] > 0
