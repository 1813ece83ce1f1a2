"""The typo table: mined from searches, counted, capped, thinned out and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions.scoring import score_exact
from lineseek.functions.text import edit_pairs, normalize
from lineseek.operators.ladder import plan_edits, sane, spell_edits
from lineseek.operators.ranking import number_rows
from lineseek.runtime import broadcast_if_small, materialize

# Fixed value: how many different typos the table keeps.
MAX_ENTRIES = 10_000


def mine_corrections(completions: DataFrame, alphabet: str, keys: tuple[str, ...]) -> DataFrame:
    """The correction each search points to: (keys..., query, corrected).

    Taken from the best line of a search without an unchanged match: the first variant in
    plan order, among those with the line's score, that the line contains. `keys` identify
    a search.
    """
    best = completions.where(
        (F.col("rank") == 1) & (F.col("score") < score_exact(F.length("query")))
    ).select(
        *keys,
        "query",
        F.length("query").alias("length"),
        F.col("score").alias("_reached"),
        normalize(F.col("completed_sentence")).alias("_line"),
    )
    # Only the edits of that one score are spelled out.
    planned = plan_edits(best).where(F.col("score") == F.col("_reached"))
    matching = sane(spell_edits(planned, alphabet)).where(
        (F.col("text") != F.col("query")) & F.contains("_line", "text")
    )
    return (
        matching.groupBy(*keys, "query")
        .agg(F.min(F.struct("text_order", "text")).alias("_first"))
        .select(*keys, "query", F.col("_first.text").alias("corrected"))
    )


def correction_records(corrections: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys..., typo, correction) for every word-level edit of a correction."""
    return corrections.select(*keys, F.inline(edit_pairs(F.col("query"), F.col("corrected"))))


def recordable(records: DataFrame) -> DataFrame:
    return records.where(
        (F.col("typo") != "")
        & (F.col("correction") != "")
        & (F.col("typo") != F.col("correction"))
    )


def count_typos(records: DataFrame, seq: str = "seq") -> DataFrame:
    """(typo, correction, frequency, first_seen): the latest correction counts."""
    return (
        recordable(records)
        .groupBy("typo")
        .agg(
            F.max_by("correction", seq).alias("correction"),
            F.count(F.lit(1)).alias("frequency"),
            F.min(seq).alias("first_seen"),
        )
    )


def keep_first_seen(typos: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The typos seen first, up to the table's size."""
    return typos.orderBy("first_seen", "typo").limit(max_entries)


def drop_least_frequent(typos: DataFrame, fraction: float) -> DataFrame:
    """Remove the lowest `int(n * fraction)` rows by frequency, ties by first seen."""
    return _by_frequency(typos, fraction, kept=True)


def least_frequent(typos: DataFrame, fraction: float) -> DataFrame:
    """The rows that `drop_least_frequent` removes."""
    return _by_frequency(typos, fraction, kept=False)


def _by_frequency(typos: DataFrame, fraction: float, kept: bool) -> DataFrame:
    ranked = number_rows(typos, ("frequency", "first_seen", "typo"), "_place")
    dropped = int(typos.count() * fraction)
    place = F.col("_place")
    return ranked.where(place >= dropped if kept else place < dropped).drop("_place")


def merge_records(
    stored: DataFrame, records: DataFrame, seq: str = "seq", max_entries: int = MAX_ENTRIES
) -> DataFrame:
    """The rows of a typo table that a batch of later records sets anew.

    A known typo gains the batch's count and takes its latest correction. New typos come in
    as they are first seen until the table holds `max_entries`; the rest leave no trace. So
    the table after several batches is that of one record after the other.
    """
    counted = materialize(count_typos(records, seq))
    known = stored.select(
        "typo", F.col("frequency").alias("_frequency"), F.col("first_seen").alias("_first")
    )
    met = counted.join(broadcast_if_small(known), "typo", "left")
    again = met.where(F.col("_first").isNotNull()).select(
        "typo",
        "correction",
        (F.col("frequency") + F.col("_frequency")).alias("frequency"),
        F.col("_first").alias("first_seen"),
    )
    # The table is never larger than `max_entries`.
    room = max(0, max_entries - stored.count())
    new = met.where(F.col("_first").isNull()).select(counted.columns)
    return again.unionByName(keep_first_seen(new, room))


def lookup(texts: DataFrame, typos: DataFrame, text: str = "typo") -> DataFrame:
    """`texts` with the known correction and frequency, NULL where there is none."""
    known = typos.select(F.col("typo").alias(text), "correction", "frequency")
    return texts.join(broadcast_if_small(known), text, "left")


def preferred_texts(queries: DataFrame, typos: DataFrame) -> DataFrame:
    """Known rewrites of each distinct `query`: (query, text, place from 1).

    The correction of the whole query comes first, then one token replaced at a time.
    """
    tokens = F.split("query", " ")
    parts = queries.select(
        "query",
        F.posexplode(F.concat(F.array(F.col("query")), tokens)).alias("at", "typo"),
    )
    known = broadcast_if_small(typos.select("typo", "correction"))

    def replaced(token: Column, index: Column) -> Column:
        return F.when(index + 1 == F.col("at"), F.col("correction")).otherwise(token)

    rewritten = F.when(F.col("at") == 0, F.col("correction")).otherwise(
        F.array_join(F.transform(tokens, replaced), " ")
    )
    first = (
        parts.join(known, "typo")
        .select("query", "at", rewritten.alias("text"))
        .where((F.col("text") != "") & (F.col("text") != F.col("query")))
        .groupBy("query", "text")
        .agg(F.min("at").alias("at"))
    )
    by_place = Window.partitionBy("query").orderBy("at")
    return first.select("query", "text", F.row_number().over(by_place).alias("place"))


def prioritize(ladder: DataFrame, preferred: DataFrame) -> DataFrame:
    """Order the ladder's texts: within a score the known rewrites first, else as planned."""
    marked = ladder.join(
        preferred.select("query", "text", F.lit(True).alias("preferred")), ["query", "text"], "left"
    ).withColumn("preferred", F.coalesce("preferred", F.lit(False)))
    order = Window.partitionBy("query").orderBy(
        F.desc("score"), F.desc("preferred"), "text_order"
    )
    return marked.withColumn("place", F.row_number().over(order))


def _quoted(text: str) -> Column:
    boxed = F.to_json(F.array(F.col(text)))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def _entry() -> Column:
    return F.concat(
        _quoted("typo"), F.lit(": ["), _quoted("correction"), F.lit(", "), F.col("frequency"), F.lit("]")
    )


def json_rows(typos: DataFrame) -> DataFrame:
    """One JSON object `{typo: [correction, frequency]}` per row."""
    return typos.select(F.concat(F.lit("{"), _entry(), F.lit("}")).alias("value"))


def save_json(typos: DataFrame, path: str) -> None:
    """Write the table as JSON lines, in parallel."""
    json_rows(typos).write.text(path)


def json_object(typos: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The whole table as one JSON object; refused above the table's size limit."""
    joined = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_seen", _entry().alias("entry")))),
            lambda item: item["entry"],
        ),
        ", ",
    )
    size = F.count(F.lit(1))
    too_many = F.raise_error(F.lit("too many typos for one JSON object")).cast("string")
    whole = F.concat(F.lit("{"), joined, F.lit("}"))
    return typos.limit(max_entries + 1).agg(
        F.when(size <= max_entries, whole).otherwise(too_many).alias("value")
    )
