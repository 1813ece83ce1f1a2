"""Merkle manifest of a dataset: a tree per source, and one over the sources' roots.

Every node is labelled with the interval of leaf ranks it covers. A level's nodes lie in
buckets of that level's width, so a node meets its parent in an equi-join on the bucket with
the parent's interval containing its own; the siblings are what the parent's interval holds
besides. Steps to the root are handed down from parent to child, so the work is a geometric
sum over the levels, and no task sees more of a source than one run of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import join_counted
from lineseek.operators.ranking import number_rows
from lineseek.runtime import BROADCAST_ROWS, materialize

# Consecutive nodes under one parent; the last run of a level may be shorter.
FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(**changed: Column) -> Column:
    """Digest of a row's fields; `changed` gives a field another value."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(*(field(name) for name in FIELDS))


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda node: node["digest"]), "")


def up(nodes: DataFrame, width: int) -> DataFrame:
    """Parents, `width` ranks wide, of the nodes of all groups that still have several."""
    inside = F.struct("lo", "hi", "digest")
    runs = (
        nodes.where(F.col("n") > width // FAN)
        .groupBy("g", F.expr(f"lo div {width}").alias("bucket"))
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(inside)).alias("kids"))
    )
    return runs.select(
        "g",
        "n",
        F.col("kids")[0]["lo"].alias("lo"),
        F.element_at("kids", -1)["hi"].alias("hi"),
        F.sha2(joined(F.col("kids")), 256).alias("digest"),
        "kids",
    )


@dataclass(frozen=True)
class Tree:
    """Stored levels, leaves first: g, n (leaves of the group), lo, hi, digest and, above the leaves, kids."""

    levels: list[DataFrame]

    @classmethod
    def grow(cls, leaves: DataFrame) -> Tree:
        """`leaves`: g, n, rank, digest and whatever else they are to carry."""
        lowest = materialize(leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1).drop("rank"))
        most, levels, width = lowest.agg(F.max("n")).first()[0] or 0, [lowest], FAN
        while width < most * FAN:
            levels.append(materialize(up(levels[-1], width)))
            width *= FAN
        return cls(levels)

    def nodes(self) -> DataFrame:
        """(g, level, lo, hi, digest) of all nodes."""
        rows = None
        for level, nodes in enumerate(self.levels):
            own = nodes.select("g", F.lit(level).alias("level"), "lo", "hi", "digest")
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def roots(self) -> DataFrame:
        """(g, n, digest): the node of each group that covers all its leaves."""
        rows = None
        for nodes in self.levels:
            own = nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("g", "n", "digest")
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def down(self, crown: DataFrame) -> DataFrame:
        """The leaves with `steps` (siblings before and after, lowest level first) and what `crown` has of their group.

        `crown` has one row per group: g, `steps` above the group's root, and other columns.
        """
        passed = [c for c in crown.columns if c not in ("g", "steps")]
        above = None
        for level in range(len(self.levels) - 1, -1, -1):
            own = self.levels[level]
            is_root = (F.col("lo") == 0) & (F.col("hi") == F.col("n"))
            out = own.where(is_root).join(crown, "g")
            if above is not None:
                width = FAN ** (level + 1)
                parent = above.select(
                    "g", F.expr(f"lo div {width}").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                    F.col("kids").alias("_kids"), F.col("steps").alias("_steps"), *passed,
                )
                below = own.where(~is_root).withColumn("_bucket", F.expr(f"lo div {width}"))
                met = below.join(parent, ["g", "_bucket"]).where((F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
                step = F.struct(
                    joined(F.filter("_kids", lambda k: k["hi"] <= F.col("lo"))).alias("before"),
                    joined(F.filter("_kids", lambda k: k["lo"] >= F.col("hi"))).alias("after"),
                )
                met = met.withColumn("steps", F.concat(F.array(step), "_steps"))
                out = out.unionByName(met.select(*out.columns))
            above = out
        return above


def leaves(docs: DataFrame, keep: list[Column], broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(g, n, rank, digest, doc_id, keep...) of every row and (g, source, n) of every source.

    g is the source's place, null first. Ranks follow doc_id (null first), then the digest.
    """
    named = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    light = docs.select("doc_id", named.alias("_source"), leaf_of().alias("digest"), *keep)
    ranked = number_rows(light, ("_source", "doc_id", "digest"), "_place")
    starts = ranked.groupBy("_source").agg(F.min("_place").alias("_start"), F.count("*").alias("n"))
    sources = materialize(number_rows(starts, ("_source",), "g"))
    met = join_counted(ranked, sources.withColumn("_uses", F.col("n")), "_source", "_uses", broadcast_rows)
    rows = met.withColumn("rank", F.col("_place") - F.col("_start")).drop("_source", "_place", "_start")
    source = F.when(F.col("_source") != "0", F.substring("_source", 2, 1 << 30))
    return rows, sources.select("g", source.alias("source"), "n")


@dataclass(frozen=True)
class Manifest:
    """The tree of the sources' leaves, the tree over their roots, and which group is which source."""

    forest: Tree
    top: Tree
    sources: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, keep: list[Column] = (), broadcast_rows: int = BROADCAST_ROWS) -> Manifest:
        """Manifest of `docs`; `keep` are columns that its leaves carry along.

        Nulls are fields of their own (`-`), also as source and as doc_id. Rows alike in all
        fields are leaves next to each other. Columns besides the five fields are not covered.
        """
        rows, sources = leaves(docs, keep, broadcast_rows)
        forest = Tree.grow(rows)
        roots = number_rows(forest.roots().select(F.col("g").alias("source_g"), "digest"), ("source_g",), "rank")
        roots = materialize(roots)
        counted = roots.select(F.lit(0).alias("g"), F.lit(roots.count()).cast("long").alias("n"), "rank", "digest", "source_g")
        return cls(forest, Tree.grow(counted), sources)

    def nodes(self) -> DataFrame:
        """(tree, source, level, lo, hi, digest) of every node; `tree` is `source` or `top`."""
        below = self.forest.nodes().join(self.sources, "g").select(F.lit("source").alias("tree"), "source", "level", "lo", "hi", "digest")
        above = self.top.nodes().select(F.lit("top").alias("tree"), F.lit(None).cast("string").alias("source"), "level", "lo", "hi", "digest")
        return below.unionByName(above)

    def proofs(self) -> DataFrame:
        """The leaves with leaf, subroot, root and `steps`, the siblings met on the way to the root."""
        root = self.top.roots().select("g", F.col("digest").alias("root"), F.array().cast(STEPS).alias("steps"))
        crown = self.top.down(root).select(F.col("source_g").alias("g"), F.col("digest").alias("subroot"), "root", "steps")
        return self.forest.down(materialize(crown)).withColumnRenamed("digest", "leaf").drop("g", "n", "lo", "hi")


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda own, s: digest(s["before"], own, s["after"]))


def verify(docs: DataFrame, altered: Column, **changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, folded_root and verified of every row of `docs`.

    Where `altered` holds, the fold starts from a leaf with the fields `changed`. An empty
    table returns no rows.
    """
    other = F.when(altered, leaf_of(**changed)).alias("_other")
    proven = Manifest.of(docs, [other]).proofs()
    return proven.withColumn("folded_root", fold(F.coalesce("_other", "leaf"), F.col("steps"))).select(
        "doc_id", "leaf", "subroot", "root", "steps", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def check_tampering(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; every other id, by CRC-32, loses its line ends.

    A null doc_id has no CRC-32 and is not tampered with.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = chosen & F.contains("text", F.lit("\n"))
    return verify(docs, cut, text=F.translate("text", "\n", "")).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified"
    )
