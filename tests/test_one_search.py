"""A single search through the word index stores no more of it than it looks at."""

import pytest

from lineseek.operators import postings
from lineseek.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pattern_search", "token_choice"])
def test_no_whole_index_is_stored(spark, monkeypatch, name):
    def refuse(*arguments):
        raise AssertionError("the whole index was built")

    monkeypatch.setattr(catalog.views, "index", refuse)
    catalog.QUERIES[name](spark, SF_DIR)


def test_edges_of_the_tokens_asked_for(spark):
    vocabulary = spark.createDataFrame(
        [("pear", 3), ("pears", 2), ("spear", 1), ("a", 9), ("", 4), ("x" * 40, 5)], "word string, df long"
    )
    tokens = spark.createDataFrame(
        [("pear", "whole"), ("pear", "prefix"), ("pear", "prefix"), ("ar", "suffix"), ("ea", "infix"), ("no", "prefix"),
         ("x" * 32, "suffix"), ("x" * 40, "whole")],
        "token string, token_class string",
    )
    got = {tuple(r) for r in postings.edge_costs(vocabulary, tokens).collect()}
    asked = {(r.token_class, r.token) for r in tokens.collect()}
    assert got == {tuple(r) for r in postings.edge_costs(vocabulary).collect() if (r.token_class, r.edge) in asked}
    assert ("prefix", "pear", 2, 5) in got and ("suffix", "ar", 2, 4) in got and len(got) == 5
