"""Every registered query against its SQL twin on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as driver
from lineseek.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_twin(spark, database, name):
    got = driver.queries()[name](spark, SF_DIR)
    names = sorted(got.columns)
    want = database.sql(f"select {', '.join(f'"{n}"' for n in names)} from ({driver.oracle_sql()[name]})")
    rows = sorted(map(repr, map(tuple, got.select(*names).collect())))
    assert rows == sorted(map(repr, want.fetchall()))
    assert rows


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["lookup_prefix", "lookup_infix", "vocabulary", "edge_costs", "edit_variants", "score_ladder"])
def test_words_and_letters_need_no_numbering(spark, monkeypatch, name):
    def refuse(lines):
        raise AssertionError("lines were sorted")

    for store in ("_numbered", "_texts", "_indexes"):
        monkeypatch.setattr(catalog.views, store, {})
    monkeypatch.setattr(catalog.views, "number_lines", refuse)
    catalog.QUERIES[name](spark, SF_DIR)


@pytest.mark.parametrize("name", ["line_ids", "postings", "no_match_queries", "typo_counts", "preferred_texts"])
def test_the_original_text_is_not_sorted(spark, monkeypatch, name):
    number, seen = catalog.views.number_lines, []
    for store in ("_numbered", "_texts", "_indexes"):
        monkeypatch.setattr(catalog.views, store, {})
    monkeypatch.setattr(catalog.views, "number_lines", lambda lines: seen.append(lines.columns) or number(lines))
    catalog.QUERIES[name](spark, SF_DIR)
    assert len(seen) == 1 and "original_sentence" not in seen[0]
