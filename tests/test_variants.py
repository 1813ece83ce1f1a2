"""Searches for every edited text as it is spelled: thousands of patterns to a query, none of them moved."""

import random

import plain
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lineseek.functions import scoring
from lineseek.operators import containment, ladder, ranking, seeding
from lineseek.plans import catalog

WORDS = ["pear", "pears", "boat", "small", "grey", "rain", "ladder", "bring", "a", "so"]


def sentences(seed, count):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) for _ in range(count)]


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


def patterns_of(spark, texts, alphabet):
    rows = [(text, query, score) for query in texts for text, score in plain.ladder(query, alphabet).items()]
    return spark.createDataFrame(rows, "pattern string, query string, score int")


@pytest.mark.parametrize("seed_rows", [0, 1_200, 1_000_000])
def test_many_patterns_equal_brute_force(spark, seed_rows):
    """Rows of a pattern come with all their columns, alike ones once; alike lines each, and long ones once for a pattern."""
    texts = ["pear so", "rain a", "bring a ladder", "bring a ladde", "so", "grey boat small rain"]
    # Repeats over the ends of the runs of places, and a line that is a pattern.
    long = ["bring a ladder " * 600, "x" * 4090 + "bring a ladder", "bring a ladder"]
    lines = sentences(3, 60) + ["rain a"] * 2 + long
    table = spark.createDataFrame([(line, n) for n, line in enumerate(lines)], "normalized_sentence string, line_id long")
    patterns = patterns_of(spark, texts, "abdeginoprs ")
    twice = patterns.unionByName(patterns).unionByName(patterns.limit(1).withColumn("pattern", F.lit("")))
    assert 0 < twice.where(F.length("pattern") < 8).count() <= 1_200 < twice.count()
    found = containment.find_containing(table, twice, keep=("line_id",), seed_rows=seed_rows)
    assert found.columns == ["line_id", "pattern", "query", "score"]
    want = sorted(
        (n, r.pattern, r.query, r.score) for r in patterns.collect() for n, line in enumerate(lines) if r.pattern in line
    )
    assert sorted(map(tuple, found.collect())) == want and sum(len(row[1]) > 7 for row in want) > 9


def test_neither_lines_nor_many_patterns_are_shuffled(spark):
    """What is joined is stored before: the texts that stand in lines, and the patterns among them."""
    lines = spark.createDataFrame([(line, n) for n, line in enumerate(sentences(4, 40))], "normalized_sentence string, line_id long")
    patterns = patterns_of(spark, ["bring a ladder"], "abdeginoprs ")
    found = containment.find_containing(lines, patterns, keep=("line_id",), seed_rows=0)
    plan = plan_of(found)
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 0
    assert plan.count("ReadSchema: struct<line_id:bigint,pattern:string>") == 1 and "normalized_sentence" not in plan


def test_the_filters_let_every_text_and_hardly_another_through(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh", k=rng.randint(8, 12))) for _ in range(3_000)]
    lines = [" ".join(texts[n : n + 3]) for n in range(0, 900, 3)] + ["".join(rng.choices("abcdefgh", k=40)) for _ in range(900)]
    table = spark.createDataFrame([(line,) for line in lines], "line string")
    asked = spark.createDataFrame([(t,) for t in texts], "pattern string")
    places = seeding.stand(table, "line", asked, "pattern", tuple({len(t) for t in texts}), lambda found, start: F.lit(True))
    got = sorted((r.line, r._pos, r._text) for r in places.collect())
    want = sorted(
        (line, at + 1, line[at : at + size])
        for line in lines for size in range(8, 13) for at in range(len(line) - size + 1) if line[at : at + size] in set(texts)
    )
    missing, more = set(want) - set(got), set(got) - set(want)
    assert not missing and len(more) <= 5 and len(got) == len(want) + len(more)


def test_spelled_texts_are_compared_where_they_are_spelled(spark):
    """The queries are dealt out, their thousands of texts are not."""
    queries = spark.createDataFrame([(t,) for t in ["pear so", "rain", "bring a ladder"]], "query string").distinct()
    plan = plan_of(ladder.score_ladder(queries, "abdeginoprs "))
    below = plan[plan.rindex("Generate") :]
    assert "Exchange" not in plan[: plan.rindex("Generate")]
    assert below.count("Exchange rangepartitioning(query") == 1


def test_pairs_are_cut_before_they_are_dealt(spark):
    """The best lines of a query with so many scores to a line; of each task only its best pairs are sent."""
    rng = random.Random(8)
    rows = {(rng.choice("pqr"), rng.randint(0, 60), rng.choice([3, 5, 8, 9])) for _ in range(900)}
    hits = spark.createDataFrame([Row(query=q, line_id=n, score=s) for q, n, s in rows for _ in range(2)]).repartition(4)
    best = ranking.top_k(hits, 5, 4)
    assert "line_id" not in "".join(line for line in plan_of(best).splitlines() if "hashpartitioning" in line)
    assert "WindowGroupLimit" in plan_of(best)
    want = []
    for query in "pqr":
        tops = {n: max(s for q, m, s in rows if (q, m) == (query, n)) for n in {n for q, n, _ in rows if q == query}}
        ordered = sorted((-s, n) for n, s in tops.items())[:5]
        want += [(query, n, -s, rank) for rank, (s, n) in enumerate(ordered, 1)]
    assert sorted((r["query"], r.line_id, r.score, r["rank"]) for r in best.collect()) == want
    assert {r["rank"] for r in ranking.top_k(hits, 5).collect()} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("length", [1, 2, 3, 5, 7, 30])
def test_a_query_has_no_more_scores_than_told(length):
    query = "".join(random.Random(length).choices("abc", k=length))
    assert len({score for _, score in plain.edited_texts(query, "abc")}) <= scoring.SCORES


def test_results_by_variants_take_their_original_text_from_the_documents(spark, tmp_path, monkeypatch):
    """Lines are sorted without it. Documents alike in name give each of their lines; alike ones take one original each."""
    number, seen = catalog.views.number_lines, []
    for store in ("_numbered", "_texts", "_indexes"):
        monkeypatch.setattr(catalog.views, store, {})
    monkeypatch.setattr(catalog.views, "number_lines", lambda lines: seen.append(lines.columns) or number(lines))
    raws = ["Bring a ladder.", "Rain, so grey!", "???", "bring a LADDER", "so small"]
    documents = [
        (1, "\n".join(raws), "a"),
        (1, "bring a ladder\n-- other --\nBring? a ladder", "a"),
        (2, None, "a"),
        (None, "rain so grey\nRAIN SO GREY", None),
    ]
    spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark = [(7, "Bring a ladder"), (8, "rain so grey"), (9, None)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    lines = sorted(
        (plain.normalize(raw), f"{source or 'null'}/{'null' if doc is None else doc}.txt", n, raw)
        for doc, text, source in documents for n, raw in enumerate((text or "").split("\n"), 1) if plain.normalize(raw)
    )
    normalized = [line[0] for line in lines]
    alphabet = sorted(set("".join(normalized)))
    want = []
    for query in catalog.views.queries(spark, str(tmp_path)).collect():
        for rank, (score, n) in enumerate(plain.best_k(plain.normalize(query.query_text), normalized, alphabet, 5), 1):
            want.append((query.query_id, rank, lines[n][3], *lines[n][1:3], -score))
    found = catalog.fuzzy_topk_by_variants(spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    # Lines alike in text, name and number are in no order: which of them comes first is left out.
    assert sorted((q, k, *rest) for q, k, _, *rest in got) == sorted((q, k, *rest) for q, k, _, *rest in want)
    assert sorted((q, *rest) for q, _, *rest in got) == sorted((q, *rest) for q, _, *rest in want) and len(want) >= 5
    assert seen and all("original_sentence" not in columns for columns in seen)
