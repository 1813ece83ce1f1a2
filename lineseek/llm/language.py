"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labelled rows fitted per language; the only bound on what is learned from.
SAMPLE_PER_LANGUAGE = 400
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
GRAM_SIZES = (1, 2, 3, 4)
GROUP_CODES = 400_000
# Share of rightly named calibration texts that rejection may cost.
LOST_SHARE = 0.001
# The low and the high end of the familiarity of real and of shuffled calibration texts.
ENDS = (0.01, 0.99)
# Fewer grams than this, three or four letters, say too little.
LEAST_GRAMS = 12

NOT_LETTERS = regex.compile(r"\P{L}+")
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """`table[bucket, language]` is the embedding times the softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    # log2 of how much commoner a bucket is in the fitted texts than if all were alike.
    familiar: np.ndarray
    least_familiar: float = -math.inf


def clean(text: str) -> str:
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def grams(codes: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start positions, buckets) of the grams of each size that begin before `starts`."""
    letter = codes != 32
    for size in GRAM_SIZES:
        count = min(starts, len(codes) - size + 1)
        if count <= 0:
            continue
        mixed = np.full(count, size, np.uint64)
        for j in range(size):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + count]
            mixed ^= mixed >> np.uint64(31)
        if size <= 2:
            valid = letter[:count] | letter[size - 1 : size - 1 + count]
        else:
            valid = letter[1 : 1 + count].copy()
            for j in range(2, size - 1):
                valid &= letter[j : j + count]
        at = np.flatnonzero(valid)
        mixed = mixed[at] * np.uint64(0xD6E8FEB86659FD93)
        yield at, (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts as code arrays of bounded length: (codes, text number of each code, starts).

    Short texts share an array; their outer spaces keep grams from crossing. A long one
    is cut, each cut carrying the codes that its last grams need.
    """
    group, numbers, held = [], [], 0

    def packed():
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return codes, np.repeat(numbers, [len(t) for t in group]), len(codes)

    for number, text in enumerate(texts):
        text = clean(text)
        if len(text) > GROUP_CODES:
            extra = max(GRAM_SIZES) - 1
            for begin in range(0, len(text), GROUP_CODES):
                part = text[begin : begin + GROUP_CODES + extra].encode("utf-32-le", "surrogatepass")
                codes = np.frombuffer(part, np.uint32).astype(np.uint64)
                yield codes, np.full(len(codes), number), min(GROUP_CODES, len(codes))
            continue
        if held + len(text) > GROUP_CODES:
            yield packed()
            group, numbers, held = [], [], 0
        group.append(text)
        numbers.append(number)
        held += len(text)
    if group:
        yield packed()


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.int64)
    for codes, _, starts in pieces([text]):
        for _, buckets in grams(codes, starts):
            total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


def shuffled(text: str) -> str:
    """The text with its letters dealt anew to the letters' places: what no language looks like."""
    text = clean(text)
    letters = [c for c in text if c != " "]
    random.Random(len(text)).shuffle(letters)
    dealt = iter(letters)
    return "".join(c if c == " " else next(dealt) for c in text)


def logits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its logits, the mean familiarity of its grams, and their number."""
    known = np.zeros(len(texts))
    sums = np.zeros((len(texts), len(model.languages)))
    seen = np.zeros(len(texts))
    for codes, owner, starts in pieces(texts):
        for at, buckets in grams(codes, starts):
            mine = owner[at]
            seen += np.bincount(mine, minlength=len(texts))
            known += np.bincount(mine, model.familiar[buckets], len(texts))
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(mine, model.table[buckets, k], len(texts))
    return sums / np.maximum(seen, 1)[:, None] + model.bias, known / np.maximum(seen, 1), seen


def softmax(values: np.ndarray) -> np.ndarray:
    powers = np.exp(values - values.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def calibrates(doc_id: int) -> bool:
    """A fifth of the rows, by id."""
    return zlib.crc32(str(doc_id).encode()) // 4 % 5 == 4


def train(rows: list[tuple]) -> Model:
    """Fit on four of five rows (language, calibrates, buckets, counts, the same two of the shuffled text).

    The fifth sets the temperature and two thresholds: the least score, and the least
    familiarity, halfway between the fifth's texts and the same texts with letters shuffled. Where
    these overlap, no real text is given up for it.
    """
    languages = sorted({row[0] for row in rows})
    number = {name: k for k, name in enumerate(languages)}
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    if len(languages) == 0:
        return Model([], emb @ weights, bias, 1.0, 0.0, np.zeros(BUCKETS))
    fit, calibration, total, real, junk = [], [], np.full(BUCKETS, 0.5), [], []
    for name, held, buckets, counts, other, other_counts in rows:
        share = (counts / max(counts.sum(), 1)).astype(float)
        (calibration if held else fit).append((number[name], buckets, share))
        if not held:
            total[buckets] += counts
        elif counts.sum() >= LEAST_GRAMS:
            real.append((buckets, share))
            junk.append((other, other_counts / max(other_counts.sum(), 1)))
    steps = EPOCHS * len(fit)
    done = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            label, buckets, share = fit[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ emb[buckets]
            error = softmax(mean @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # A bucket moves by its share of the text, raised as mean vectors are short.
            emb[buckets] -= (rate * 20) * np.outer(share, back)
    model = Model(languages, emb @ weights, bias, 1.0, 0.0, np.log2(total / total.mean()))
    if real:
        low, high = (
            np.quantile([share @ model.familiar[buckets] for buckets, share in texts], end) for texts, end in zip((real, junk), ENDS)
        )
        model.least_familiar = float((low + high) / 2 if high < low else min(share @ model.familiar[buckets] for buckets, share in real))
    if calibration:
        truth = np.array([row[0] for row in calibration])
        raw = np.array([share @ model.table[buckets] + bias for _, buckets, share in calibration])
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
        sure = softmax(raw / model.temperature)
        right = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == truth])
        if len(right) and len(languages) > 1:
            # Never above what half-certain means, whatever the calibration texts are like.
            model.threshold = float(min(0.5, right[int(LOST_SHARE * len(right))]))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on `per_language` labelled, not held-out texts of each language.

    The rows are those with the smallest hash of doc_id; only their bucket counts reach
    the driver. Rows without id, text or lang teach nothing; no rows give an empty model.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "lang", "text").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        known.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    ).select("doc_id", "lang")
    sample = known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])

    def count(batches):
        for batch in batches:
            found = [bucket_counts(text) for text in batch["text"]]
            junk = [bucket_counts(shuffled(t) if calibrates(d) else "") for d, t in zip(batch["doc_id"], batch["text"])]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "lang": batch["lang"],
                    # As bytes, four a number: lists of numbers would take many times that on the driver.
                    "buckets": [b.astype("<i4").tobytes() for b, _ in found],
                    "counts": [c.astype("<i4").tobytes() for _, c in found],
                    "junk": [b.astype("<i4").tobytes() for b, _ in junk],
                    "junk_counts": [c.astype("<i4").tobytes() for _, c in junk],
                }
            )

    parts = ("buckets", "counts", "junk", "junk_counts")
    got = sample.mapInPandas(count, "doc_id long, lang string, buckets binary, counts binary, junk binary, junk_counts binary").collect()
    got.sort(key=lambda row: (row["doc_id"], row["lang"], *(bytes(row[k]) for k in parts[:2])))
    return train([(r["lang"], calibrates(r["doc_id"]), *(np.frombuffer(r[k], "<i4") for k in parts)) for r in got])


def predictor(spark, model: Model):
    """A column function text -> struct(lang_pred, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in series:
            out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "rejected": True}, index=range(len(texts)))
            usable = [k for k, t in enumerate(texts) if t is not None and LETTER.search(t)]
            if usable and model.languages:
                raw, known, seen = logits(model, [texts.iloc[k] for k in usable])
                chance = softmax(raw / model.temperature)
                best = chance.max(axis=1)
                out.loc[usable, "lang_pred"] = np.array(model.languages, object)[chance.argmax(axis=1)]
                out.loc[usable, "score"] = best
                out.loc[usable, "rejected"] = (best < model.threshold) | (known < model.least_familiar) | (seen < LEAST_GRAMS)
            yield out

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predict the language of every text from the text alone.

    Returns doc_id, held_out, lang_pred, score, rejected. A null text, or one without a
    letter, is `und` with score 0 and rejected; so is every text where nothing was
    learned. Rejected are also texts of three letters or so, and those whose grams are too
    unfamiliar, as in other languages or shuffled letters. Repeated rows are answered each; ties go to the first language in order.
    """
    predict = predictor(docs.sparkSession, model or fit(docs))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("_p")).select(
        "doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.rejected"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""
    predict = predictor(docs.sparkSession, fit(docs))
    return docs.where(~predict(docs["text"])["rejected"])
