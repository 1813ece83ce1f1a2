"""Token counts of a byte-fallback BPE model by rank-synchronous merging of arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_LIMIT = 4096
SPACE = "▁"
# Pre-tokens above this many symbols are merged one by one with a heap: the array turns
# would cost the square of their length. Counts are the same.
LONG = 256
NO_RANK = np.int64(1 << 62)


class Merger:
    """The merge table of a model: which neighbours join, into what, in which order."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        special = lambda k: self.library.is_control(k) or self.library.is_unknown(k) or self.library.is_byte(k)
        pieces = {self.library.id_to_piece(k): k for k in range(size) if not special(k)}
        if any(self.library.is_unused(k) for k in range(size)) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces must not be unused or have a space after another character")
        scores = sorted({self.library.get_score(k) for k in pieces.values()}, reverse=True)
        rank = {score: place for place, score in enumerate(scores)}
        self.ids = pieces
        self.size = size + 1
        table = sorted(
            (pieces[p[:cut]] * self.size + pieces[p[cut:]], rank[self.library.get_score(k)], k)
            for p, k in pieces.items()
            for cut in range(1, len(p))
            if p[:cut] in pieces and p[cut:] in pieces
        )
        self.keys, self.ranks, self.made = (np.array(c, np.int64) for c in zip(*table))
        self.lookup = {key: (place, made) for key, place, made in table}
        self.known: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each neighbouring pair; NO_RANK where it does not join."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token; unknown characters count their bytes."""
        out = np.zeros(len(pretokens), np.int64)
        short = []
        for k, text in enumerate(pretokens):
            if len(text) > LONG:
                out[k] = self.by_heap(text)
            else:
                short.append(k)
        for begin in range(0, len(short), 20_000):
            part = short[begin : begin + 20_000]
            out[part] = self.in_turns([pretokens[k] for k in part])
        return out

    def in_turns(self, pretokens: list[str]) -> np.ndarray:
        """In every turn each sequence joins its lowest-rank pair, the leftmost of equals."""
        get = self.ids.get
        symbols = np.array([get(c, -1) for t in pretokens for c in t], np.int64)
        extra = np.array([0 if c in self.ids else len(c.encode()) - 1 for t in pretokens for c in t], np.int64)
        owner = np.repeat(np.arange(len(pretokens)), [len(t) for t in pretokens])
        out = np.bincount(owner, 1 + extra, len(pretokens)).astype(np.int64)
        while len(symbols) > 1:
            rank, made = self.pair_ranks(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NO_RANK
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NO_RANK, lengths)
            if not live.any():
                break
            at = np.flatnonzero(live & (rank == np.repeat(best, lengths)))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
            symbols[at] = made[at]
            out[owner[at]] -= 1
            # The right half goes, and with it every sequence that is done.
            live[at + 1] = False
            symbols, owner = symbols[live], owner[live]
        return out

    def by_heap(self, text: str) -> int:
        symbols = [self.ids.get(c, -1) for c in text]
        count = len(symbols) + sum(len(c.encode()) - 1 for c, s in zip(text, symbols) if s < 0)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and symbols[left] >= 0 and symbols[right] >= 0:
                if found := self.lookup.get(symbols[left] * self.size + symbols[right]):
                    heapq.heappush(heap, (found[0], left, right, symbols[left] * self.size + symbols[right]))

        for left in range(len(symbols) - 1):
            offer(left, left + 1)
        while heap:
            _, left, right, key = heapq.heappop(heap)
            if after[left] != right or symbols[left] * self.size + symbols[right] != key or symbols[left] < 0:
                continue
            symbols[left] = self.lookup[key][1]
            symbols[right] = -2
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            after[right] = -1
            count -= 1
            offer(before[left], left)
            offer(left, after[left])
        return count

    def batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Pre-tokens are runs of spaces with what follows them."""
        split = [re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", self.library.normalize(t)) for t in texts]
        if len(self.known) > 500_000:
            self.known.clear()
        fresh = list({p for own in split for p in own} - self.known.keys())
        self.known.update(zip(fresh, self.counts(fresh).tolist()))
        known = self.known
        return [sum(known[p] for p in own) for own in split]


_mergers: dict[str, Merger] = {}


def merger(model_file: str) -> Merger:
    """One table per Python worker."""
    if model_file not in _mergers:
        _mergers[model_file] = Merger(model_file)
    return _mergers[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, over_limit of every whole text.

    A null or empty text has no bytes and no tokens. Repeated rows are answered each, ids
    are carried as they are. `model_file` must be readable on the executors.
    """

    @F.pandas_udf("long")
    def tokens(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = merger(model_file)
        for texts in series:
            counts, begin = [], 0
            for begin in range(0, len(texts), 500):
                counts += table.batch([t or "" for t in texts.iloc[begin : begin + 500]])
            yield pd.Series(counts, dtype="int64")

    counted = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        tokens("text").alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
