"""Searches over lines of which only the first few are sorted."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from lineseek.operators import completion
from lineseek.operators.ranking import number_lines
from lineseek.plans import catalog
from lineseek.sources.corpus import keep_lines

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    words = ["pear", "pears", "boat", "small", "grey", "rain", "ladder", "bring", "a", "so"]
    raws = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(120)] + ["rain rain rain"] * 9
    rows = [(raw, f"{i % 3}.txt", i + 1) for i, raw in enumerate(raws)]
    return keep_lines(spark.createDataFrame(rows, "original_sentence string, source_text string, offset int")).cache()


def in_two(texts, bound):
    """As `views.headed_texts` gives them: numbers in line order before `bound`, others behind it at random."""
    text = F.col("normalized_sentence")
    head = number_lines(texts.where(text < bound))
    rest = texts.where(text >= bound).withColumn("line_id", 1_000 + F.pmod(F.xxhash64("offset"), F.lit(1 << 40)))
    return head.unionByName(rest), completion.line_count(head)


def test_the_bound_leaves_a_share_of_the_lines_before_it(texts, monkeypatch):
    assert completion.head_bound(texts) is None
    monkeypatch.setattr(completion, "HEAD_LEAST", 1)
    for share in (2, 4, 32):
        monkeypatch.setattr(completion, "HEAD_SHARE", share)
        before = texts.where(F.col("normalized_sentence") < completion.head_bound(texts)).count()
        assert before <= texts.count() // share
        assert share > 2 or before > 0


@pytest.mark.parametrize("bound", ["", "c", "pears", "zzz"])
def test_best_texts_equal_brute_force(spark, texts, bound):
    lines, head_lines = in_two(texts, bound)
    normalized = sorted(row[0] for row in texts.select("normalized_sentence").collect())
    asked = ["rain rain", "rian", "bring a lader", "pear boats", "smal grey", "a", "qq", "rain  pears", "nothing like it", "?"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    found = completion.best_texts(lines, queries, head_lines=head_lines)
    got = {r.query_id: (r.score, r.normalized_sentence) for r in found.collect()}
    want = {}
    for number, text in enumerate(asked):
        query = plain.normalize(text)
        best = plain.best_k(query, normalized, plain_alphabet(normalized), 1) if query else []
        if best:
            want[number] = (-best[0][0], normalized[best[0][1]])
    assert got == want and len(want) >= 5


def plain_alphabet(normalized):
    return sorted(set("".join(normalized)))


@pytest.mark.parametrize("name", ["no_match_queries", "typo_mining"])
def test_only_a_head_is_sorted(spark, monkeypatch, name):
    """Of a table large enough to have a head, the rest of the lines is not sorted, with the same rows."""
    number, sizes = catalog.views.number_lines, []

    def sized(lines):
        sizes.append(lines.count())
        return number(lines)

    rows = []
    for least in (completion.HEAD_LEAST, 10):
        monkeypatch.setattr(completion, "HEAD_LEAST", least)
        for store in ("_numbered", "_texts", "_indexes"):
            monkeypatch.setattr(catalog.views, store, {})
        monkeypatch.setattr(catalog.views, "number_lines", sized)
        rows.append(sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, SF_DIR).collect()))))
    everything, head = sizes
    assert rows[0] == rows[1] and rows[0]
    assert 0 < head <= everything // completion.HEAD_SHARE
