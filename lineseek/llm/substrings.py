"""Removal of word windows seen in an earlier document, behind a count-min sketch."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lineseek.llm.repeats import Text, Unit, keyed, ranges, removed
from lineseek.runtime import materialize

LENGTH = 50
GRAM = 8
# Cells of a row of the sketch. A fuller sketch lets more through, and loses nothing.
WIDTH = 1 << 22
DEPTH = 2
PARTS = 64
MERGE_FANOUT = 64
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def cells(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((anchors.view(np.uint64) * np.uint64(FACTORS[row])) >> np.uint64(20)).astype(np.int64) % width


def sketch(rows: DataFrame, unit: Unit, width: int = WIDTH) -> np.ndarray:
    """Counts of window anchors, never too low, ending at 255.

    A window occurs at most as often as its anchor, so what the sketch holds for the anchor
    overestimates the window. Each partition fills its own; parts of them are summed in two
    steps, and the driver gets DEPTH * width bytes whatever the input is.
    """

    def fill(batches):
        counts = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            own = [anchor for text in batch["text"] for anchor, *_ in Text(text, unit).segments()]
            if own:
                anchors = np.concatenate(own)
                for row in range(DEPTH):
                    cell, n = np.unique(cells(anchors, row, width), return_counts=True)
                    counts[row, cell] = np.minimum(counts[row, cell] + n, 255)
        salt = TaskContext.get().partitionId() % MERGE_FANOUT
        for row in range(DEPTH):
            pieces = np.array_split(counts[row], PARTS)
            yield pd.DataFrame(
                {"row": row, "part": range(PARTS), "salt": salt, "cells": [zlib.compress(p.tobytes(), 1) for p in pieces]}
            )

    def add(group):
        total = np.minimum(sum(np.frombuffer(zlib.decompress(c), np.uint8).astype(np.int64) for c in group["cells"]), 255)
        first = group.iloc[0]
        packed = zlib.compress(total.astype(np.uint8).tobytes(), 1)
        return pd.DataFrame({"row": [first["row"]], "part": [first["part"]], "salt": [first["salt"]], "cells": [packed]})

    schema = "row int, part int, salt int, cells binary"
    filled = rows.select("text").mapInPandas(fill, schema)
    merged = filled.groupBy("row", "part", "salt").applyInPandas(add, schema).groupBy("row", "part").applyInPandas(add, schema)
    pieces = {(r["row"], r["part"]): np.frombuffer(zlib.decompress(r["cells"]), np.uint8) for r in materialize(merged).collect()}
    if not pieces:
        return np.zeros((DEPTH, width), np.uint8)
    return np.stack([np.concatenate([pieces[row, part] for part in range(PARTS)]) for row in range(DEPTH)])


def remove_seen(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = WIDTH) -> DataFrame:
    """Return doc_id, n_words, n_removed, kept_sha256 of every row.

    Words covered by a window of `length` words that also starts in a document with a
    smaller id go. Null ids are last and not smaller than each other; a null or empty text
    has no words; repeated rows (one id) do not remove each other.
    """
    unit = Unit(True, length, gram)
    rows = keyed(docs)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(sketch(rows, unit, width) >= 2, axis=1))

    def passes():
        bits = shared.value

        def test(anchors: np.ndarray) -> np.ndarray:
            keep = np.ones(len(anchors), bool)
            for row in range(DEPTH):
                cell = cells(anchors, row, width)
                keep &= (bits[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            return keep

        return test

    def cut(batches):
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["own"]):
                words = Text(text, unit).words
                gone = removed(len(words), own)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    joined = rows.join(ranges(rows, unit, other_document=True, passes=passes), ["did", "rid"], "left").select("doc_id", "text", "own")
    return joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
