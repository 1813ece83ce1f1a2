"""Words, keys and tables shared by the operators of this package."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.runtime import BROADCAST_ROWS

WHITE = " \t\n\x0b\f\r"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0d]+")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words between ASCII white space; none for an empty or null text."""
    bare = F.btrim(whole(text), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows equal in id and text share a key; a null text differs from an empty one."""
    return F.md5(F.concat_ws("|", doc_id.cast("string"), text.isNull().cast("string"), whole(text)).cast("binary"))


# A key with more than one in so many of the rows is joined by broadcast.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, uses: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` joined to `table`, unique on `key`, whose column `uses` counts the rows with that key.

    A small table is broadcast. Of a larger one only the keys with over a thousandth of all
    rows are, at most a thousand; the rest meet in a shuffle where no key is hot.
    """
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(uses)), key)
    total = table.agg(F.sum(uses)).first()[0]
    is_hot = F.col(uses) * HOT_SHARE > total
    hot, rest = table.where(is_hot).drop(uses), table.where(~is_hot).drop(uses)
    by_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return by_hot.unionByName(others)
