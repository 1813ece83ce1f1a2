"""Whitening of vectors with a covariance found by polarisation.

Entries become whole numbers. The variances of every dimension and of the sum of every two
dimensions are aggregated as exact sums of squares of centred values; half of what the
variance of a sum exceeds the two variances by is the covariance. Only these d * (d + 1) / 2
numbers, whatever the number of vectors, come together for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
# An entry c becomes floor(STEP * c) + SHIFT.
STEP, SHIFT = 1024, 100_000
# An entry this large has no exact whole number of 64 bits.
LARGEST = 2.0**52
# Sums are passed on in two parts, so that they are exact beyond 38 digits.
LIMB = 60
# Below this share of the largest eigenvalue a component counts as without variance.
NOTHING = 1e-11
# Numbers squared at once in a task.
CELLS = 4_000_000


def entries(vector: Column, largest: float = LARGEST) -> Column:
    """True where every entry is a number; null vectors and entries, NaN and infinities are not."""
    size = lambda e: F.abs(e.cast("double"))
    return F.coalesce(F.forall(vector, lambda e: F.coalesce(~F.isnan(e) & (size(e) * STEP < largest), F.lit(False))), F.lit(False))


def usable(vectors: DataFrame, keep: list[Column], vector: str) -> tuple[DataFrame, int]:
    """Rows (keep..., _v) that take part, and their dimension: the commonest length, the longer of equals."""
    rows = vectors.select(*keep, F.col(vector).alias("_v")).where(entries(F.col("_v")))
    sizes = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    d = first["d"] if first else 0
    return rows.where(F.size("_v") == d), d


def whole(batch: pd.Series) -> np.ndarray:
    return np.floor(np.stack(batch.to_numpy()).astype(np.float64) * STEP).astype(np.int64) + SHIFT


def in_parts(total: np.ndarray) -> pd.DataFrame:
    """Python integers as (k, high, low)."""
    mask = (1 << LIMB) - 1
    return pd.DataFrame({"k": range(len(total)), "high": [int(t) >> LIMB for t in total], "low": [int(t) & mask for t in total]})


def total_of(parts: DataFrame, size: int) -> list[int]:
    """Exact sums of the parts by k: `size` numbers come to the driver."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = {r["k"]: (int(r["high"]) << LIMB) + int(r["low"]) for r in parts.groupBy("k").agg(wide("high"), wide("low")).collect()}
    return [got.get(k, 0) for k in range(size)]


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of every dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d + 1, object)
        for batch in batches:
            if len(batch):
                x = whole(batch["_v"])
                safe = int(np.abs(x).max()) * len(x) < 1 << 62
                total[:d] += (x if safe else x.astype(object)).sum(axis=0).astype(object)
                total[d] += len(batch)
        yield in_parts(total)

    *own, n = total_of(rows.select("_v").mapInPandas(add, "k int, high long, low long"), d + 1)
    return n, own


def squares_of(x: np.ndarray) -> np.ndarray:
    """Sums of squares of every dimension, then of the sums of dimensions i < j, in order, as Python integers."""
    n, d = x.shape
    most = 2 * int(np.abs(x).max(initial=0))
    if most * most * n >= 1 << 62:
        x = x.astype(object)
    out = [(x * x).sum(axis=0)]
    for i in range(d - 1):
        both = x[:, i : i + 1] + x[:, i + 1 :]
        out.append((both * both).sum(axis=0))
    return np.concatenate(out).astype(object)


def square_sums(rows: DataFrame, d: int, middle: list[int]) -> list[int]:
    centre = np.array(middle, np.int64)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * (d + 1) // 2, object)
        step = max(1, CELLS // d)
        for batch in batches:
            for begin in range(0, len(batch), step):
                total += squares_of(whole(batch["_v"].iloc[begin : begin + step]) - centre)
        yield in_parts(total)

    parts = rows.select("_v").mapInPandas(add, "k int, high decimal(38,0), low decimal(38,0)")
    return total_of(parts, d * (d + 1) // 2)


@dataclass(frozen=True)
class Whitening:
    """What is learned from the vectors: `columns` holds the components, eigenvalues fall."""

    n: int
    total: list[int]
    values: np.ndarray
    columns: np.ndarray
    trace: float


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Exact covariance by polarisation, then its eigenvectors.

    Values are centred at the whole number next to the mean before they are squared; what
    the mean differs by, rest / n, is taken off the sums exactly.
    """
    n, total = sums(rows, d)
    middle = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, middle)]
    squares = square_sums(rows, d, middle)
    # n * n times the variance of one dimension, and of the sum of two.
    own = [n * q - r * r for q, r in zip(squares, rest)]
    covariance = np.zeros((d, d))
    at = d
    for i in range(d):
        covariance[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            both = n * squares[at] - (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n * n)
            at += 1
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    columns = columns[:, order]
    # The largest entry of a component is positive, so that reruns agree.
    largest = columns[np.abs(columns).argmax(axis=0), np.arange(len(order))]
    return Whitening(n, total, np.maximum(values[order], 0.0), columns * np.where(largest < 0, -1, 1), sum(own) / (n * n))


def centred(batch: pd.Series, n: int, total: list[int]) -> np.ndarray:
    """x - S / n: the difference to the nearest whole mean first, so that no digits are lost."""
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(total, middle)])
    return (whole(batch) - middle) - rest


def scale_of(model: Whitening) -> np.ndarray:
    """1 / sqrt(e), and NaN for a component without variance."""
    live = model.values > NOTHING * max(model.trace, 0.0)
    return np.where(live, 1 / np.sqrt(np.where(live, model.values, 1.0)), np.nan)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    live = ~np.isnan(scale_of(model))
    if not live.any():
        return 0.0
    project, size = (model.columns * scale_of(model))[:, live], int(live.sum())

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if len(batch):
                w = centred(batch["_v"], model.n, model.total) @ project
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pd.DataFrame({"k": range(size + size * size), "s": np.concatenate([first, second.ravel()])})

    got = rows.select("_v").mapInPandas(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    flat = np.array([r["s"] for r in sorted(got, key=lambda r: r["k"])]) / model.n
    mean, second = flat[:size], flat[size:].reshape(size, size)
    # Rounded, as sums of doubles depend on the order in which tasks end.
    return round(float(np.abs(second - np.outer(mean, mean) - np.eye(size)).max()), 9)


def whiten(vectors: DataFrame, keep: list[Column], vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """`keep` columns, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Vectors that are null, or hold a null, NaN or infinite entry, or one of 2^42 or more, take
    no part; neither do those whose length is not the commonest (of two, the longer). Repeated
    rows count as often as they are there. `deviation` is null where it exceeds a long. A
    component without variance has a null `whitened`. No vectors, or empty ones, give no rows.
    """
    rows, d = usable(vectors, keep, vector)
    model = fit(rows, d, components) if d else Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    error = identity_error(rows, model) if d else 0.0
    project, n = model.columns * scale_of(model), model.n
    explained = model.values / model.trace if model.trace > 0 else np.zeros(len(model.values))

    @F.pandas_udf("deviation long, whitened array<double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        floor = [s // n for s in model.total]
        over = [s - n * f for s, f in zip(model.total, floor)]
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"deviation": pd.array([], "Int64"), "whitened": []})
                continue
            off = whole(batch) - np.array(floor, np.int64)
            # In whole numbers of any size where 64 bits do not hold them.
            if ((int(np.abs(off).max()) + 1) * n) ** 2 * d >= 1 << 62:
                off = off.astype(object)
            off = n * off - np.array(over, off.dtype)
            deviation = [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]
            yield pd.DataFrame({"deviation": pd.array(deviation, "Int64"), "whitened": list(centred(batch, n, model.total) @ project)})

    shares = F.array(*(F.lit(float(e)) for e in explained)) if len(explained) else F.array().cast("array<double>")
    names = [F.col(f"`{c}`") for c in rows.columns if c != "_v"]
    placed = rows.where(F.lit(bool(d))).select(*names, place("_v").alias("_w"))
    return placed.select(*names, F.col("_w.deviation").alias("deviation"), F.posexplode("_w.whitened").alias("_at", "_value")).select(
        *names,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("_value"), F.col("_value")).alias("whitened"),
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
