"""The prepared tables of a text collection, and where they are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lineseek.operators import completion, postings
from lineseek.operators.ranking import number_lines

# Lines of one stored block; a line is fetched from its block only.
BLOCK_LINES = 1_000_000
# Within a block, lines lie in order of their numbers in row groups of so many bytes.
ROW_GROUP_BYTES = 8 << 20
# Stored parts of the postings; a word is fetched from its part only.
WORD_BUCKETS = 256


TABLES = ("lines", "postings", "vocabulary", "edges")


@dataclass(frozen=True)
class Index:
    """Numbered lines, (word, line_id) postings, (word, df) vocabulary and the prices of word edges."""

    lines: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    edges: DataFrame
    block_lines: int | None = None
    word_buckets: int | None = None

    @classmethod
    def build(cls, lines: DataFrame) -> Index:
        numbered = number_lines(lines)
        entries = postings.build_postings(numbered)
        vocabulary = postings.build_vocabulary(entries)
        return cls(numbered, entries, vocabulary, postings.edge_costs(vocabulary))

    def save(
        self, path: str, block_lines: int = BLOCK_LINES, word_buckets: int = WORD_BUCKETS
    ) -> Index:
        """Write the tables as Parquet and return the stored index.

        Lines lie in blocks of consecutive ids, postings in buckets of words. Postings are
        ranged by (bucket, word, line_id), so a frequent word spreads over files.
        """
        spark = self.lines.sparkSession
        # Numbering has sorted the lines, and a task writes one block after the other.
        self.lines.withColumn("line_block", postings.line_block(block_lines)).sortWithinPartitions(
            "line_block", "line_id"
        ).write.partitionBy("line_block").option("parquet.block.size", ROW_GROUP_BYTES).parquet(
            f"{path}/lines"
        )
        order = ("word_bucket", "word", "line_id")
        entries = postings.build_postings(spark.read.parquet(f"{path}/lines")).withColumn(
            "word_bucket", postings.word_bucket(word_buckets)
        )
        entries.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(
            "word_bucket"
        ).parquet(f"{path}/postings")
        postings.build_vocabulary(spark.read.parquet(f"{path}/postings")).write.parquet(
            f"{path}/vocabulary"
        )
        edges = postings.edge_costs(spark.read.parquet(f"{path}/vocabulary"))
        edges.withColumn("edge_bucket", postings.edge_bucket(word_buckets)).repartition(
            "edge_bucket"
        ).write.partitionBy("edge_bucket").parquet(f"{path}/edges")
        # Written last: an index without its sizes is incomplete.
        sizes = spark.createDataFrame(
            [(block_lines, word_buckets)], "block_lines long, word_buckets long"
        )
        sizes.coalesce(1).write.parquet(f"{path}/sizes")
        return Index.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """Read a saved index; its block and bucket sizes are stored with it."""
        tables = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
        sizes = spark.read.parquet(f"{path}/sizes").first()
        return cls(*tables, sizes["block_lines"], sizes["word_buckets"])

    def _storage(self) -> dict:
        return {"block_lines": self.block_lines, "word_buckets": self.word_buckets}

    def complete(self, queries: DataFrame, k: int = completion.DEFAULT_K, **options) -> DataFrame:
        return completion.complete_indexed(
            self.lines, self.postings, self.vocabulary, self.edges, queries, k, **self._storage(), **options
        )

    def search(self, patterns: DataFrame, **options) -> DataFrame:
        return postings.search_patterns(
            self.lines, self.postings, self.vocabulary, self.edges, patterns, **self._storage(), **options
        )

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """The lines of the rows' `line_id`, from their blocks and, for a few, their row groups only."""
        return postings.fetch_lines(self.lines, wanted, self.block_lines)
