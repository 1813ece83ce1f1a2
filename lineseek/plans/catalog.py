"""The queries offered to the driver: each operator over the whole given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.functions import scoring
from lineseek.functions.text import edit_pairs, interior_tokens, normalize
from lineseek.operators import completion, containment, ladder, postings, sessions, typos
from lineseek.operators.ranking import top_k
from lineseek.plans import views
from lineseek.runtime import broadcast_if_small, ensure_checkpoint_dir, materialize
from lineseek.sources import corpus
from lineseek.sources.index_store import Index
from lineseek.streaming import jobs

K = completion.DEFAULT_K


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completion.admit(views.queries(spark, sf_dir))


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admitted(spark, sf_dir).select("query").distinct()


def _alphabet(lines: DataFrame) -> str:
    # At most 37 characters.
    return corpus.corpus_alphabet(lines).first()["alphabet"]


# Sources


def corpus_lines(spark, sf_dir):
    return views.lines(spark, sf_dir)


def text_tree_scan(spark, sf_dir, whole_file_bytes=corpus.WHOLE_FILE_BYTES, text="text"):
    """Write the documents as a tree of text files, then read the tree."""
    root = _scratch(spark, "tree")
    documents = views.read(spark, sf_dir, "documents").select(
        "source", (F.col("doc_id") % 16).alias("shelf"), "doc_id", F.expr(text).alias("text")
    )
    (
        documents.repartition("source", "shelf")
        .sortWithinPartitions("source", "shelf", "doc_id")
        .select("source", "shelf", "text")
        .write.partitionBy("source", "shelf")
        .text(root)
    )
    path = r"source=([^/]*)/shelf=([^/]*)/.*"
    return corpus.read_text_tree(spark, root, whole_file_bytes).select(
        "original_sentence",
        "normalized_sentence",
        F.regexp_replace("source_text", path, "$1/$2").alias("source_text"),
        "offset",
    )


def lossy_text_tree(spark, sf_dir):
    """The tree with a byte that no UTF-8 text holds, and a character cut short, in every document."""
    broken = (
        "concat(cast(left(text, 10) as binary), x'FF', cast('|' as binary), x'E282', cast('|' as binary),"
        " cast(substring(text, 11) as binary))"
    )
    return text_tree_scan(spark, sf_dir, text=f"cast({broken} as string)")


def text_tree_splits(spark, sf_dir):
    """The same tree with every file read in splits."""
    return text_tree_scan(spark, sf_dir, whole_file_bytes=0)


def index_round_trip(spark, sf_dir):
    """Best completions from an index written to files and read back."""
    path = _scratch(spark, "index")
    sizes = {"block_lines": 2_000, "word_buckets": 8}
    Index.build(views.lines(spark, sf_dir)).save(path, **sizes)
    found = Index.load(spark, path).complete(views.queries(spark, sf_dir), K)
    return found.select(*RESULT)


def typo_json(spark, sf_dir):
    """The typo table written as JSON and read back."""
    path = _scratch(spark, "typos")
    typos.save_json(typo_counts(spark, sf_dir), path)
    entries = spark.read.text(path).select(
        F.explode(F.from_json("value", "map<string,array<string>>")).alias("typo", "entry")
    )
    return entries.select(
        "typo",
        F.element_at("entry", 1).alias("correction"),
        F.element_at("entry", 2).cast("long").alias("frequency"),
    )


def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(views.lines(spark, sf_dir))


def corpus_alphabet(spark, sf_dir):
    return corpus.corpus_alphabet(views.lines(spark, sf_dir))


# Scalar functions


def normalize_text(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select(
        "doc_id", normalize(F.col("text")).alias("normalized")
    )


def admitted_queries(spark, sf_dir):
    return completion.admit(views.chunks(spark, sf_dir), "chunk").select(
        "session_id", "seq", "query"
    )


def penalties(spark, sf_dir):
    place = F.col("offset")
    return views.lines(spark, sf_dir).select(
        "source_text",
        "offset",
        scoring.substitution_penalty(place).alias("substitution"),
        scoring.indel_penalty(place).alias("indel"),
    )


def scores(spark, sf_dir):
    length, place = F.length("normalized_sentence"), F.col("offset")
    return views.lines(spark, sf_dir).select(
        "source_text",
        "offset",
        scoring.score_exact(length).alias("exact"),
        scoring.score_substitution(length, place).alias("substitution"),
        scoring.score_extra_char(length, place).alias("extra"),
        scoring.score_missing_char(length, place).alias("missing"),
    )


def token_classes(spark, sf_dir):
    patterns = _distinct(spark, sf_dir).withColumnRenamed("query", "pattern")
    return postings.pattern_tokens(patterns)


def interior_token_list(spark, sf_dir):
    return _distinct(spark, sf_dir).select(
        "query", F.array_join(interior_tokens(F.col("query")), "|").alias("tokens")
    )


def edit_pair_rows(spark, sf_dir):
    pairs = _admitted(spark, sf_dir).select(
        "query_id", F.inline(edit_pairs(F.col("query"), normalize(F.col("intended"))))
    )
    return pairs


def content_hash(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")
    )


def transcripts(spark, sf_dir):
    return sessions.transcribe(views.responses(spark, sf_dir))


# Row generators


def tier_plan(spark, sf_dir):
    lengths = _distinct(spark, sf_dir).select(F.length("query").alias("length")).distinct()
    return ladder.plan_edits(lengths).select("length", "kind", "position", "score")


def edit_variants(spark, sf_dir):
    variants = ladder.edit_variants(_distinct(spark, sf_dir), _alphabet(views.lines(spark, sf_dir)))
    return variants.select("query", "kind", "position", "text", "score")


def score_ladder(spark, sf_dir):
    return ladder.score_ladder(_distinct(spark, sf_dir), _alphabet(views.lines(spark, sf_dir))).select(
        "query", "text", "score", "tier"
    )


# Index and lookups


def line_ids(spark, sf_dir):
    return views.numbered_texts(spark, sf_dir).select("line_id", "source_text", "offset")


def line_lookup(spark, sf_dir):
    """The last line of every source, fetched by its id."""
    index = views.index(spark, sf_dir)
    last = index.lines.groupBy("source_text").agg(F.max("line_id").alias("line_id"))
    wanted = broadcast_if_small(materialize(last.select("line_id")))
    return index.fetch(wanted).select(
        "line_id", "original_sentence", "normalized_sentence", "source_text", "offset"
    )


def word_postings(spark, sf_dir):
    return postings.build_postings(views.numbered_texts(spark, sf_dir))


def vocabulary(spark, sf_dir):
    return views.vocabulary(spark, sf_dir)


def _lookup(kind):
    def run(spark, sf_dir):
        """Words that the tokens of one boundary class stand in, with their line counts."""
        tokens = token_classes(spark, sf_dir).where(F.col("token_class") == kind)
        return postings.token_words(views.vocabulary(spark, sf_dir), tokens).select("token", "word", "df")

    return run


def edge_costs(spark, sf_dir):
    """What every beginning and end of a word costs to look up."""
    return postings.edge_costs(views.vocabulary(spark, sf_dir))


def token_choice(spark, sf_dir):
    words, tokens = views.vocabulary(spark, sf_dir), token_classes(spark, sf_dir)
    costs = postings.token_costs(tokens, words, postings.edge_costs(words, tokens))
    return postings.cheapest_tokens(costs).select("pattern", "token", "cost")


def _halves(spark, sf_dir):
    queries = _distinct(spark, sf_dir)
    return queries.select(
        "query",
        F.explode(
            F.expr(
                "array(left(query, int((length(query) + 1) div 2)),"
                " substring(query, int((length(query) + 1) div 2) + 1))"
            )
        ).alias("pattern"),
    ).where(F.col("pattern") != "")


def pattern_search(spark, sf_dir):
    """Lines that contain a whole typed query, through the word index."""
    patterns = _distinct(spark, sf_dir).withColumnRenamed("query", "pattern")
    # For one search nothing but the words is stored: edges are counted and postings met for it.
    lines = views.numbered_texts(spark, sf_dir)
    words = materialize(postings.build_vocabulary(postings.line_words(lines)))
    edges = postings.edge_costs(words, postings.pattern_tokens(patterns))
    return Index(lines, postings.build_postings(lines), words, edges).search(patterns)


def contains_filter(spark, sf_dir):
    """Lines that contain a whole typed query, by one scan."""
    patterns = _distinct(spark, sf_dir).withColumnRenamed("query", "pattern")
    lines = views.lines(spark, sf_dir).select("source_text", "offset", "normalized_sentence")
    return containment.find_containing(lines, patterns).drop("normalized_sentence")


def half_candidates(spark, sf_dir):
    """Lines one edit may turn into a match: those that contain a half of the query."""
    halves = _halves(spark, sf_dir)
    found = containment.find_containing(
        views.lines(spark, sf_dir).select("source_text", "offset", "normalized_sentence"),
        halves.select("pattern"),
    )
    return (
        found.join(broadcast_if_small(halves.distinct()), "pattern")
        .select("query", "pattern", "source_text", "offset")
    )


# Completion

RESULT = ("query_id", "rank", "completed_sentence", "source_text", "offset", "score")


def fuzzy_topk(spark, sf_dir):
    return completion.complete(
        views.numbered_lines(spark, sf_dir), views.queries(spark, sf_dir), K
    ).select(*RESULT)


def fuzzy_topk_indexed(spark, sf_dir):
    """The same answers, with the lines of rare queries found through the word index."""
    return views.index(spark, sf_dir).complete(views.queries(spark, sf_dir), K).select(*RESULT)


def fuzzy_topk_by_variants(spark, sf_dir):
    """The same answers by definition: every edited text is searched for as it is spelled."""
    lines = views.numbered_texts(spark, sf_dir)
    admitted = _admitted(spark, sf_dir)
    # Spelled once; there are thousands to a query, so they are never sent to every task.
    variants = materialize(
        ladder.score_ladder(
            admitted.select("query").distinct(), _alphabet(lines)
        ).select("query", F.col("text").alias("pattern"), "score")
    )
    found = containment.find_containing(
        lines.select("line_id", "normalized_sentence"), variants, keep=("line_id",)
    )
    best = materialize(top_k(found.drop("pattern"), K, scoring.SCORES))
    # Of the lines shown, and of no others, the original text is needed.
    numbers = broadcast_if_small(materialize(best.select("line_id").distinct()))
    shown = views.with_originals(spark, sf_dir, postings.fetch_lines(lines, numbers))
    return completion.show_results(admitted, best, shown).select(*RESULT)


def best_scores(spark, sf_dir):
    return completion.best_scores(
        views.lines(spark, sf_dir), _admitted(spark, sf_dir), line_key=("source_text", "offset")
    )


def rendered_results(spark, sf_dir):
    return sessions.render_results(fuzzy_topk(spark, sf_dir), ("query_id",))


def no_match_queries(spark, sf_dir):
    lines, head_lines = views.headed_texts(spark, sf_dir)
    return completion.without_match(
        lines, views.queries(spark, sf_dir), head_lines=head_lines
    ).select("query_id", "query", "message")


# Typos


def _corrections(spark, sf_dir):
    lines, head_lines = views.headed_texts(spark, sf_dir)
    found = completion.best_texts(lines, views.queries(spark, sf_dir), head_lines=head_lines)
    # Only the normalized text of a result is looked at, and normalizing that changes nothing.
    best = found.withColumnRenamed("normalized_sentence", "completed_sentence").withColumn("rank", F.lit(1))
    return typos.mine_corrections(best, _alphabet(lines), ("query_id",))


def typo_mining(spark, sf_dir):
    return _corrections(spark, sf_dir)


def _records(spark, sf_dir):
    return typos.correction_records(_corrections(spark, sf_dir), ("query_id",)).withColumnRenamed(
        "query_id", "seq"
    )


def typo_counts(spark, sf_dir):
    return typos.count_typos(_records(spark, sf_dir))


def typo_cap(spark, sf_dir):
    """The table held to the 20 typos seen first."""
    return typos.keep_first_seen(typo_counts(spark, sf_dir), 20)


def typo_evict(spark, sf_dir):
    """The table without its least frequent half."""
    return typos.drop_least_frequent(materialize(typo_counts(spark, sf_dir)), 0.5)


def typo_lookup(spark, sf_dir):
    tokens = token_classes(spark, sf_dir).select("token").distinct()
    return typos.lookup(tokens, materialize(typo_counts(spark, sf_dir)), "token")


def preferred_texts(spark, sf_dir):
    return typos.preferred_texts(
        _distinct(spark, sf_dir), materialize(typo_counts(spark, sf_dir))
    )


def prioritized_variants(spark, sf_dir):
    alphabet = _alphabet(views.headed_texts(spark, sf_dir)[0])
    rungs = ladder.score_ladder(_distinct(spark, sf_dir), alphabet)
    return typos.prioritize(rungs, preferred_texts(spark, sf_dir)).select(
        "query", "text", "score", "preferred", "place"
    )


# Sessions and recordings


def session_text(spark, sf_dir):
    return sessions.session_text(views.chunks(spark, sf_dir))


def _session_results(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    typed = materialize(sessions.session_queries(views.typed_chunks(spark, sf_dir)))
    return typed, completion.complete(views.numbered_lines(spark, sf_dir), typed, K)


def session_completions(spark, sf_dir):
    _, found = _session_results(spark, sf_dir)
    return found.select(
        "session_id",
        "seq",
        F.col("query_text").alias("echo"),
        "rank",
        "completed_sentence",
        "source_text",
        "offset",
        "score",
    )


def session_transcript(spark, sf_dir):
    """What a session shows, line by line, also for texts that find nothing."""
    typed, found = _session_results(spark, sf_dir)
    return sessions.screen(typed, materialize(found), ("session_id", "seq"))


def consecutive_dedup(spark, sf_dir):
    """Lines of each source without those equal to the line before them."""
    recordings = views.lines(spark, sf_dir).select("source_text", "offset", "original_sentence")
    return sessions.drop_repeats(recordings, "source_text", "offset", "original_sentence").select(
        "source_text", "offset", "content_hash"
    )


def recording_dedup(spark, sf_dir):
    """Documents of each collection without those equal to the one before them."""
    recordings = views.read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return sessions.drop_repeats(recordings, "source", "doc_id", "text").select(
        "source", "doc_id", "content_hash"
    )


# Streams


def _stream(spark, table: DataFrame, name: str, bounds: tuple = (), order: str = "seq") -> DataFrame:
    """The table as a stream, one micro-batch for the rows up to each bound and one for the rest."""
    path = _scratch(spark, name)
    place = F.col(order)
    for low, high in zip((None, *bounds), (*bounds, None)):
        part = table if low is None else table.where(place >= low)
        part = part if high is None else part.where(place < high)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def streaming_session_text(spark, sf_dir):
    """Session text over a stream of three batches, each going on from the one before."""
    out = _scratch(spark, "session-text")
    arriving = _stream(spark, views.chunks(spark, sf_dir), "chunks", (2, 5))
    jobs.write_session_text(arriving, out, _scratch(spark, "stream")).awaitTermination()
    return spark.read.parquet(f"{out}/text").drop("batch_id")


def _thirds(records: DataFrame) -> tuple:
    """Where the range of `seq` is cut in three."""
    low, high = records.agg(F.min("seq"), F.max("seq")).first()
    return () if low is None else tuple(low + (high - low) * n // 3 for n in (1, 2))


def streaming_typo_counts(spark, sf_dir):
    """The typo table kept by a stream of three batches of records."""
    out = _scratch(spark, "typo-table")
    records = materialize(_records(spark, sf_dir))
    arriving = _stream(spark, records, "records", _thirds(records))
    jobs.write_typo_table(arriving, out, _scratch(spark, "stream")).awaitTermination()
    return jobs.typo_versions(spark, out).latest()


def typo_table_held_small(spark, sf_dir):
    """The same stream with room for 30 typos, of which every second batch drops a third."""
    out = _scratch(spark, "typo-table")
    records = materialize(_records(spark, sf_dir))
    arriving = _stream(spark, records, "records", _thirds(records))
    jobs.write_typo_table(
        arriving, out, _scratch(spark, "stream"), max_entries=30, thin_every=2, thin_fraction=1 / 3
    ).awaitTermination()
    return jobs.typo_versions(spark, out).latest().select("typo", "correction", "frequency")


def streaming_completions(spark, sf_dir):
    """Queries that arrive in two batches, answered through one stored index."""
    out, path = _scratch(spark, "completions"), _scratch(spark, "index")
    index = Index.build(views.lines(spark, sf_dir)).save(path)
    arriving = _stream(spark, views.queries(spark, sf_dir), "queries", (20_000,), "query_id")
    jobs.write_completions(arriving, index, out, _scratch(spark, "stream"), K).awaitTermination()
    return spark.read.parquet(out).select(*RESULT)


QUERIES = {
    "corpus_lines": corpus_lines,
    "text_tree_scan": text_tree_scan,
    "text_tree_splits": text_tree_splits,
    "lossy_text_tree": lossy_text_tree,
    "index_round_trip": index_round_trip,
    "typo_json": typo_json,
    "corpus_stats": corpus_stats,
    "corpus_alphabet": corpus_alphabet,
    "normalize_text": normalize_text,
    "admitted_queries": admitted_queries,
    "penalties": penalties,
    "scores": scores,
    "token_classes": token_classes,
    "interior_tokens": interior_token_list,
    "edit_pairs": edit_pair_rows,
    "content_hash": content_hash,
    "transcripts": transcripts,
    "tier_plan": tier_plan,
    "edit_variants": edit_variants,
    "score_ladder": score_ladder,
    "line_ids": line_ids,
    "line_lookup": line_lookup,
    "postings": word_postings,
    "vocabulary": vocabulary,
    "lookup_whole": _lookup("whole"),
    "lookup_prefix": _lookup("prefix"),
    "lookup_suffix": _lookup("suffix"),
    "lookup_infix": _lookup("infix"),
    "edge_costs": edge_costs,
    "token_choice": token_choice,
    "pattern_search": pattern_search,
    "contains_filter": contains_filter,
    "half_candidates": half_candidates,
    "fuzzy_topk": fuzzy_topk,
    "fuzzy_topk_indexed": fuzzy_topk_indexed,
    "fuzzy_topk_by_variants": fuzzy_topk_by_variants,
    "best_scores": best_scores,
    "rendered_results": rendered_results,
    "no_match_queries": no_match_queries,
    "typo_mining": typo_mining,
    "typo_counts": typo_counts,
    "typo_cap": typo_cap,
    "typo_evict": typo_evict,
    "typo_lookup": typo_lookup,
    "preferred_texts": preferred_texts,
    "prioritized_variants": prioritized_variants,
    "session_text": session_text,
    "session_completions": session_completions,
    "session_transcript": session_transcript,
    "consecutive_dedup": consecutive_dedup,
    "recording_dedup": recording_dedup,
    "streaming_session_text": streaming_session_text,
    "streaming_typo_counts": streaming_typo_counts,
    "typo_table_held_small": typo_table_held_small,
    "streaming_completions": streaming_completions,
}
