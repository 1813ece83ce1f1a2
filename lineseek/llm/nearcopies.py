"""Near copies at a Jaccard similarity of word shingles: linked by SimHash, made complete by prefixes.

Fingerprints of pairs at 0.8 differ in about ten of 64 bits, more than covering tables can take
in. They link what they reach; the links they miss are found by a prefix join, which is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm import simhash
from lineseek.llm.common import WORD_BYTES, row_key
from lineseek.llm.components import components
from lineseek.runtime import broadcast_if_small, materialize, release

SHINGLE = 5
# The least similarity as a fraction, so that no rounding decides.
SIMILAR, OUT_OF = 4, 5
# Rows whose shingles are counted to learn which are common, and how many of those are kept.
# They only set the order in which prefixes are taken: any order gives the same links.
SAMPLE_ROWS = 16_384
COMMON_ROWS = 3
MOST_COMMON = 200_000
# Words of 64 bits that tell of a set which of as many groups of shingles are odd in number.
ODD_WORDS = 4
# So many of a set's earlier buckets are known in each of its buckets.
EARLIER = 32
# Pairs compared at once, for each member of a bucket.
PAIRS_PER_MEMBER = 4
# Leaders of a bucket in the second turn, and by how much they grow with each.
LEADERS = 16
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the shingles of lower-cased words; a shorter text is one shingle."""
    found = WORD_BYTES.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(size, len(found))
    mixed = np.full(len(found) - width + 1, width, np.uint64)
    for j in range(width):
        mixed = (mixed ^ words[j : j + len(mixed)]) * FACTOR
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed number."""
    if not len(own):
        return 0
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(own), simhash.CHUNK):
        part = own[begin : begin + simhash.CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def cells_of(own: np.ndarray) -> bytes:
    """How many shingles lie in each of a power of two of equal ranges of hashes, two to four on average; 255 means as many or more."""
    bits = max(0, (len(own) // 2).bit_length() - 1)
    if not bits:
        return bytes([min(len(own), 255)])
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def odd_bits(own: np.ndarray) -> np.ndarray:
    """Bit k is set if an odd number of shingles have the remainder k.

    A bit in which two sets differ stands for a shingle, at least one, that only one of them has.
    """
    bits = 64 * ODD_WORDS
    counts = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def may_be_similar(a: bytes, b: bytes, n: int, m: int) -> bool:
    """False only where the cells alone show that too few shingles can be shared."""
    counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b)]
    counts = [np.where(c == 255, 1 << 40, c) for c in counts]
    size = min(map(len, counts))
    one, two = (c.reshape(size, -1).sum(axis=1) for c in counts)
    shared = min(int(np.minimum(one, two).sum()), n, m)
    return OUT_OF * shared >= SIMILAR * (n + m - shared)


def prefix_length(n: int) -> int:
    """So many first shingles, in any one order, that similar sets share one of them."""
    return n - -(-SIMILAR * n // OUT_OF) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OUT_OF * shared >= SIMILAR * (len(a) + len(b) - shared)


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met in several sampled rows, ascending, and in how many."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({"h": np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)})

    rows = docs.count()
    share = F.pmod(F.xxhash64("_row"), F.lit(max(rows, 1))) < SAMPLE_ROWS
    counted = docs.where(share).select("text").mapInPandas(hashes, "h long").groupBy("h").agg(F.count("*").alias("c"))
    # As columns: a Python object for each row would take many times that on the driver.
    got = counted.where(F.col("c") >= COMMON_ROWS).orderBy(F.desc("c"), "h").limit(MOST_COMMON).toArrow()
    keys, counts = (got.column(k).to_numpy().astype(np.int64) for k in ("h", "c"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, _row, and of the shingle set: `whole` (128 bits), n, fp, cells, odd, and the prefix, rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(common(docs))

    @F.pandas_udf("whole binary, n int, fp long, cells binary, odd array<long>, head array<long>")
    def sign(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        for texts in series:
            out = []
            for text in texts:
                own = shingles(text)
                keys, weight = own.view(np.int64), np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    weight = np.where(known[at] == keys, counts[at], 0)
                head = keys[np.lexsort((keys, weight))[: prefix_length(len(own))]]
                out.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), fingerprint(own), cells_of(own), odd_bits(own), head))
            yield pd.DataFrame(out, columns=["whole", "n", "fp", "cells", "odd", "head"]).astype({"n": "int32", "fp": "int64"})

    return docs.select("doc_id", "_row", sign("text").alias("s")).select("doc_id", "_row", "s.*")


def fingerprint_pairs(reps: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(a, b): sets tied by equal fingerprints, or by the spanning edges of the covering tables."""
    first = reps.groupBy("fp").agg(F.min("rid").alias("lead"))
    equal = reps.join(first, "fp").where("rid <> lead").select(F.col("lead").alias("a"), F.col("rid").alias("b"))
    edges = simhash.near_edges(first.select("fp"), radius).distinct()
    src, dst = (first.select(F.col("fp").alias(x), F.col("lead").alias(y)) for x, y in (("src", "a"), ("dst", "b")))
    return equal.union(edges.join(src, "src").join(dst, "dst").select("a", "b"))


def near_in_size(n, m):
    return (OUT_OF * n >= SIMILAR * m) & (OUT_OF * m >= SIMILAR * n)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_pairs(named: DataFrame) -> DataFrame:
    """Each bucket's members with one leader, chosen by hash."""
    lead = named.groupBy("h").agg(F.min(F.struct(F.xxhash64("rid").alias("o"), "rid", "n")).alias("l"))
    both = named.join(lead, "h").where((F.col("rid") != F.col("l.rid")) & near_in_size(F.col("n"), F.col("l.n")))
    return ordered(both.select(F.col("l.rid").alias("a"), F.col("rid").alias("b")))


def hub_pairs(named: DataFrame, leaders: int) -> DataFrame:
    """Each bucket's members with those of `leaders` members of other labels that have most links so far.

    In a group of copies of one text the least changed ones are similar to most others, so few
    leaders leave little to be compared.
    """
    order = Window.partitionBy("h").orderBy(F.desc("links"), F.xxhash64("rid"), "rid")
    return cross_labels(named, named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= leaders))


def cross_labels(named: DataFrame, lead: DataFrame) -> DataFrame:
    """Pairs of a member and a leader of one bucket that no chain links yet."""
    both = named.join(others(lead), "h").where((F.col("label") != F.col("other")) & enough() & few_odd(named))
    return ordered(both.select(F.col("rid").alias("a"), "b"))


def others(named: DataFrame) -> DataFrame:
    """Members under the names of the second set of a pair."""
    names = {"rid": "b", "n": "m", "place": "at", "label": "other", "odd": "odd_other", "before": "before_other"}
    return named.select("h", *(F.col(c).alias(x) for c, x in names.items() if c in named.columns))


def few_odd(named: DataFrame):
    """Whether sets of n and m shingles differ in so few bits of `odd` that they may be similar; true of members without it."""
    if "odd" not in named.columns:
        return F.lit(True)
    differ = sum(F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("odd_other")[k])) for k in range(ODD_WORDS))
    return (OUT_OF + SIMILAR) * differ <= (OUT_OF - SIMILAR) * (F.col("n") + F.col("m"))


def first_met(named: DataFrame):
    """False where both sets are known to share an earlier bucket, which holds the pair as well."""
    return ~F.arrays_overlap("before", "before_other") if "before" in named.columns else F.lit(True)


def enough():
    """Whether sets of n and m shingles that first meet in their places `place` and `at` may be similar."""
    reach = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    return (SIMILAR + OUT_OF) * reach >= SIMILAR * (F.col("n") + F.col("m"))


def early(n, place):
    """Whether the shingle stands so early in its set that a set as large or larger may be met here first."""
    return (SIMILAR + OUT_OF) * (n - place) >= 2 * SIMILAR * n


def all_pairs(named: DataFrame) -> DataFrame:
    """All pairs of a bucket that no chain links yet and that may be similar, if this is the first bucket they share.

    Sets that first meet in their places i and j share at most min(n - i, m - j) shingles. Where that
    is enough, the smaller set stands early, so others are met from early sets no larger only.
    A similar pair is never lost: it is emitted in the first bucket that it shares.
    """
    near = named.where("early")
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("rid") < F.col("b")))
    both = near.join(others(named), "h").where((F.col("label") != F.col("other")) & smaller & enough() & few_odd(named) & first_met(named))
    return ordered(both.select(F.col("rid").alias("a"), "b"))


def comparisons(named: DataFrame) -> DataFrame:
    """(h, p, c): of each bucket, at least the pairs that `all_pairs` compares, and the members.

    An early set meets sets of other labels as large as itself or larger, up to the size that may
    be similar. They are counted along the sizes, so that no pair is made.
    """
    scale = 1_000_000
    wider = int(scale * math.log(OUT_OF / SIMILAR)) + 2
    sized = named.withColumn("size", F.floor(scale * F.log("n")).cast("long"))

    def ahead(*keys: str):
        bucket = Window.partitionBy(*keys)
        until = F.count("*").over(bucket.orderBy("size").rangeBetween(Window.unboundedPreceding, wider))
        return until - F.row_number().over(bucket.orderBy("size", "rid"))

    met = sized.withColumn("all", ahead("h")).withColumn("own", ahead("h", "label"))
    pairs = F.when(F.col("early"), F.col("all") - F.col("own")).otherwise(0)
    return met.groupBy("h").agg(F.sum(pairs).alias("p"), F.count("*").alias("c"))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (src, dst) whose sets are similar, by exact comparison.

    Pairs that counts of a few bytes a set rule out go first. Only the texts of the others are
    read again; their sets are dealt out once, by `rid`, for both ends of the pairs.
    """

    @F.pandas_udf("boolean")
    def possible(left: pd.Series, right: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(*row) for row in zip(left, right, n, m)], dtype=bool)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    @F.pandas_udf("boolean")
    def judge(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(left, right)], dtype=bool)

    left, right = (reps.select(F.col("rid").alias(x), F.col("cells").alias(f"_c{x}"), F.col("n").alias(f"_n{x}")) for x in ("a", "b"))
    near = pairs.join(left, "a").join(right, "b").where(possible("_ca", "_cb", "_na", "_nb"))
    pairs = materialize(near.select("a", "b"))
    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    wanted = materialize(reps.join(ends, "rid", "left_semi").select("rid", F.col("row").alias("_row")))
    texts = docs.select("_row", "text").join(broadcast_if_small(wanted), "_row")
    # Rows alike in id and text stand for one set.
    sets = texts.select("rid", packed("text").alias("own")).dropDuplicates(["rid"])
    one, two = (sets.select(F.col("rid").alias(x), F.col("own").alias(f"_{x}")) for x in ("a", "b"))
    judged = pairs.join(one, "a").join(two, "b").where(judge("_a", "_b"))
    out = materialize(judged.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    release(wanted, pairs)
    return out


def shared_members(reps: DataFrame) -> DataFrame:
    """(h, rid, n, place, early): the buckets of prefix shingles in which a similar pair may meet first.

    They hold several sets, one of them early. One shuffle serves the counts and the members.
    """
    dealt = reps.select("rid", "n", F.posexplode("head").alias("place", "h")).withColumn("early", early(F.col("n"), F.col("place")))
    dealt = dealt.repartition("h")
    several = dealt.groupBy("h").agg(F.count("*").alias("c"), F.max("early").alias("e")).where("c > 1 and e").select("h")
    return materialize(dealt.join(several, "h", "left_semi"))


def by_set(members: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """(rid, n, own): the buckets of every set in one row, so that what is known of a set meets one row and not each bucket.

    With `reps` also `odd` of the set.
    """
    sets = members.groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("place", "h", "early"))).alias("own"))
    return materialize(sets if reps is None else sets.join(reps.select("rid", "odd"), "rid"))


def open_members(sets: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """(rid, n, label, links, h, place, early, before, odd if known) of the buckets that hold several labels.

    `before` has the first of the set's buckets that come ahead of this one. All sets take shingles
    in one order, and the first bucket that two sets of different labels share is never settled, so
    it is among those that both have left.
    """
    ends = found.select(F.col("src").alias("rid")).union(found.select("dst"))
    known = labels.select("rid", "component", F.lit(0).alias("links")).union(ends.select("rid", F.lit(None).cast("long"), F.lit(1)))
    known = known.groupBy("rid").agg(F.max("component").alias("component"), F.sum("links").alias("links"))
    label, links = F.coalesce("component", "rid").alias("label"), F.coalesce("links", F.lit(0)).alias("links")
    odd = [c for c in ("odd",) if c in sets.columns]
    ahead = lambda at: F.transform(F.slice("own", F.lit(1), F.least(at, F.lit(EARLIER))), lambda x: x["h"])
    own = F.transform("own", lambda x, at: F.struct(x["h"].alias("h"), x["place"].alias("place"), x["early"].alias("early"), ahead(at).alias("before")))
    named = sets.join(known, "rid", "left").select("rid", "n", *odd, label, links, F.inline(own))
    bucket = Window.partitionBy("h")
    named = named.withColumn("x", F.min("label").over(bucket)).withColumn("y", F.max("label").over(bucket))
    return materialize(named.where("x <> y").drop("x", "y"))


def link(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rid, component): components of all similar pairs of `reps`, only those with a link.

    Similar sets share a shingle of their prefixes, so they meet in the bucket of the first such. Members are
    first compared with one leader, then in turns with LEADERS, LEADERS ** 2 .. of those with most
    links, then in all pairs that are not linked by then: a group of near copies costs its size,
    not its square, and turns grow with the logarithm of the largest bucket. Labels of earlier
    turns are carried on, so later ones link labels only. A bucket with one label is settled for good and
    left out of later turns. Steps are deleted once used.
    """
    members = shared_members(reps)
    tried = materialize(ordered(fingerprint_pairs(reps).union(star_pairs(members))))
    found = verified(tried, docs, reps)
    labels = materialize(components(found).select(F.col("node").alias("rid"), "component"))
    sets = by_set(members, reps)
    release(members)
    leaders = LEADERS
    while True:
        named = open_members(sets, labels, found)
        release(sets)
        left, rows, largest = comparisons(named).agg(F.sum(F.col("p").cast("double")), F.sum("c"), F.max("c")).first()
        if not left:
            release(named)
            return labels
        last = left <= PAIRS_PER_MEMBER * rows or leaders >= largest
        pairs = all_pairs(named) if last else hub_pairs(named, leaders)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
        if not last:
            sets = by_set(named, reps)
        release(named)
        more = verified(pairs, docs, reps)
        labels = relabelled(labels, more)
        if last:
            return labels
        found, tried, leaders = found.union(more), tried.union(pairs), leaders * LEADERS


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(rid, component) after further pairs: the labels that they tie become one."""
    if not more.take(1):
        return labels
    named = more
    for end in ("src", "dst"):
        own = labels.select(F.col("rid").alias(end), F.col("component").alias("c"))
        named = named.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    tied = components(named).select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(tied, "component", "left").select("rid", F.coalesce("to", "component").alias("component"))
    fresh = tied.join(labels.select(F.col("rid").alias("component")), "component", "left_anti")
    return materialize(old.union(fresh.select(F.col("component").alias("rid"), F.col("to").alias("component"))))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of every group linked at the similarity, with all columns: the first by doc_id, then by text.

    Texts without words are copies of each other. Null ids come last. Columns may have any
    names. An empty table returns no rows.
    """
    all_columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all")
    rows = docs.select("doc_id", "text", all_columns, row_key(F.col("doc_id"), F.col("text")).alias("_row"))
    prints = materialize(signatures(rows.select("doc_id", "text", "_row")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("v"), "doc_id", "_row")).alias("best")
    reps = prints.groupBy("whole").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("cells").alias("cells"), F.first("odd").alias("odd"), F.first("head").alias("head"))
    reps = materialize(reps.select("best", F.col("best._row").alias("row"), "n", "fp", "cells", "odd", "head", F.monotonically_increasing_id().alias("rid")))
    # Rows alike in id and text, of which one is left.
    repeated = materialize(prints.groupBy("_row").agg(F.count("*").alias("c")).where("c > 1").select("_row", F.lit(True).alias("_again")))
    release(prints)
    named = reps.select("rid", "best").join(link(rows, reps), "rid", "left").withColumn("root", F.coalesce("component", "rid"))
    best = named.groupBy("root").agg(F.min("best").alias("b")).select(F.col("b._row").alias("_row"))
    best = materialize(best.join(repeated, "_row", "left"))
    release(reps, repeated)
    kept = rows.select("_all", "_row").join(broadcast_if_small(best), "_row")
    once, again = kept.where("_again is null"), kept.where("_again").dropDuplicates(["_row"])
    return once.select("_all.*").union(again.select("_all.*"))
