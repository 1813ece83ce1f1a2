"""A keyed table that the micro-batches of a stream change.

Every batch stores its changed rows under its number, and every so many batches the whole
table. A reader takes the newest whole table and the changes since, so neither reading nor
writing grows with the history. A batch that is run again finds the table as it was before
it and replaces what it had stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.runtime import remove_path

# Batches from one whole table to the next.
EVERY = 8
LAST = (1 << 31) - 1


@dataclass(frozen=True)
class Versions:
    spark: SparkSession
    path: str
    key: str
    # Columns besides the key, as DDL.
    columns: str
    key_type: str = "string"
    every: int = EVERY

    def _read(self, kind: str, first: int, end: int) -> DataFrame:
        # A schema given spares the reader the footers; `version` is the folder's number.
        schema = f"{self.key} {self.key_type}, {self.columns}, gone boolean, version int"
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        return stored.where((F.col("version") >= first) & (F.col("version") < end))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.key} {self.key_type}, {self.columns}")

    def before(self, batch_id: int) -> DataFrame:
        """The table as the batches before this one left it."""
        if batch_id == 0:
            return self._empty()
        base = (batch_id - 1) // self.every * self.every
        parts = [self._read("change", base, batch_id)]
        if base:
            # A whole table comes before the changes of its own number.
            parts.append(self._read("full", base, base + 1).withColumn("version", F.lit(base - 1)))
        rows = reduce(DataFrame.unionByName, parts)
        values = [c for c in rows.columns if c not in (self.key, "version")]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*values), "version").alias("_row"))
        kept = newest.select(self.key, "_row.*").where(~F.col("gone"))
        return kept.drop("gone")

    def store(self, batch_id: int, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Store what a batch changes: rows set, and keys (first column) that are removed."""
        rows = changed.withColumn("gone", F.lit(False))
        if removed is not None:
            rows = rows.unionByName(removed.select(self.key).withColumn("gone", F.lit(True)), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.path}/change/version={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.before(batch_id + 1).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(
                f"{self.path}/full/version={batch_id + 1}"
            )
            # This batch may be run again and then needs the whole table before; older ones go.
            for old in range(max(0, batch_id + 1 - 3 * self.every), batch_id + 1 - 2 * self.every):
                remove_path(self.spark, f"{self.path}/change/version={old}")
            remove_path(self.spark, f"{self.path}/full/version={batch_id + 1 - 2 * self.every}")

    def latest(self) -> DataFrame:
        """The table after the last stored batch that changed anything."""
        last = self._read("change", 0, LAST).agg(F.max("version")).first()[0]
        return self._empty() if last is None else self.before(last + 1)
