"""The score ladder: which edits exist, what they score and the texts they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.functions import scoring
from lineseek.runtime import shuffle_parts


def plan_edits(lengths: DataFrame) -> DataFrame:
    """Add every (kind, position) of `length` with its score and place in the plan.

    Within one score the plan takes missing characters by position first, then by position
    a substitution before a surplus character; `plan_order` sorts that way.
    """
    length = F.col("length")

    def edits(kind: str, until: Column, order: tuple[int, int]) -> Column:
        return F.transform(
            F.sequence(F.lit(1), until),
            lambda position: F.struct(
                F.lit(kind).alias("kind"),
                position.alias("position"),
                F.struct(
                    F.lit(order[0]).alias("group"),
                    position.alias("position"),
                    F.lit(order[1]).alias("kind"),
                ).alias("plan_order"),
            ),
        )

    exact = F.array(
        F.struct(
            F.lit("exact").alias("kind"),
            F.lit(0).alias("position"),
            F.struct(
                F.lit(0).alias("group"), F.lit(0).alias("position"), F.lit(0).alias("kind")
            ).alias("plan_order"),
        )
    )
    planned = lengths.select(
        *lengths.columns,
        F.inline(
            F.concat(
                exact,
                edits("missing", length + 1, (0, 0)),
                edits("substitution", length, (1, 0)),
                edits("extra", length, (1, 1)),
            )
        ),
    )
    position = F.col("position")
    score = (
        F.when(F.col("kind") == "exact", scoring.score_exact(length))
        .when(F.col("kind") == "missing", scoring.score_missing_char(length, position))
        .when(F.col("kind") == "substitution", scoring.score_substitution(length, position))
        .otherwise(scoring.score_extra_char(length, position))
    )
    return planned.withColumn("score", score)


def spell_edits(planned: DataFrame, alphabet: str) -> DataFrame:
    """Spell out planned edits of `query` as texts, one row per character tried.

    `text_order` sorts the texts of one score as the plan lists them.
    """
    query, position, kind = F.col("query"), F.col("position"), F.col("kind")
    letters = F.array(*[F.lit(letter) for letter in alphabet])
    letters = letters if alphabet else F.array().cast("array<string>")
    replaced = F.substring(query, position, F.lit(1))
    tried = (
        F.when(kind == "missing", letters)
        .when(kind == "substitution", F.filter(letters, lambda letter: letter != replaced))
        .otherwise(F.array(F.lit("")))
    )
    behind = F.when(kind == "missing", position).otherwise(position + 1)
    text = F.when(kind == "exact", query).otherwise(
        F.concat(
            F.substring(query, F.lit(1), position - 1),
            F.col("letter"),
            F.substring(query, behind, F.length(query)),
        )
    )
    return (
        planned.select("*", F.posexplode(tried).alias("_letter_at", "letter"))
        .withColumn("text", text)
        .withColumn("text_order", F.struct("plan_order", F.col("_letter_at").alias("letter")))
        .drop("_letter_at", "letter")
    )


def edit_variants(queries: DataFrame, alphabet: str) -> DataFrame:
    """Every edit of each distinct normalized `query`, spelled out."""
    lengths = queries.select("query", F.length("query").alias("length"))
    return spell_edits(plan_edits(lengths), alphabet).drop("length")


def sane(variants: DataFrame) -> DataFrame:
    """Only texts a normalized line can hold, with a score above zero."""
    return variants.where(
        (F.col("score") > 0) & (F.col("text") != "") & ~F.contains("text", F.lit("  "))
    )


def score_ladder(queries: DataFrame, alphabet: str) -> DataFrame:
    """Each distinct text of each query at its best score, with its tier from 1 downwards.

    The queries are dealt out before they are spelled: all texts of one come up in one task,
    where they are compared, and none is moved.
    """
    best_first = F.struct((-F.col("score")).alias("worst"), "text_order")
    dealt = queries.select("query").repartitionByRange(shuffle_parts(queries.sparkSession), "query")
    best = (
        sane(edit_variants(dealt, alphabet))
        .groupBy("query", "text")
        .agg(F.min(best_first).alias("_best"))
        .select(
            "query",
            "text",
            (-F.col("_best.worst")).alias("score"),
            F.col("_best.text_order").alias("text_order"),
        )
    )
    tiers = Window.partitionBy("query").orderBy(F.desc("score"))
    return best.withColumn("tier", F.dense_rank().over(tiers))
