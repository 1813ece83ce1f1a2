"""Removal of byte strings that occur more than once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lineseek.llm.repeats import Text, Unit, keyed, ranges, removed

LENGTH = 400


def gram_of(length: int) -> int:
    """Eight times a power of two: the largest up to a sixth of a window, 64 for 400 bytes."""
    return 8 << max(0, (length // 48).bit_length() - 1)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Return doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Bytes covered by a string of `length` bytes that starts anywhere else go, all of its
    occurrences. A null or empty text has no bytes; shorter texts keep all. Repeated rows
    count as often as they stand. A window has at least eight bytes.
    """
    unit = Unit(False, length, gram_of(length))
    rows = keyed(docs)

    def cut(batches):
        for batch in batches:
            out = []
            for text, own in zip(batch["text"], batch["own"]):
                data = np.frombuffer(Text(text, unit).data, np.uint8)
                gone = removed(len(data), own)
                runs = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
                out.append((len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    joined = rows.join(ranges(rows, unit, other_document=False), ["did", "rid"], "left").select("doc_id", "text", "own")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
