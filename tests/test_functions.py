import json

import plain
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lineseek.functions import scoring, text
from lineseek.functions.transcripts import best_transcript
from lineseek.operators import postings


def column(spark, values, expression, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col(name))).collect()]


NORMALIZED = {
    "don't": "dont",
    "a , b": "a b",
    "be,\tthat": "be that",
    "Python 3.8.4": "python 384",
    "@!.,$#%^&*()": "",
    "  Mixed   CASE\r\n\x0b text ": "mixed case text",
    "": "",
    "a b c　d": "a b c d",
    "﻿Start \x1c end\x85": "start end",
    "Kİs K": "kis k",
    "naïve – café": "nave caf",
    "tab\there - and - there": "tab here and there",
}


def test_normalize(spark):
    got = column(spark, list(NORMALIZED), text.normalize)
    assert got == list(NORMALIZED.values())
    assert got == [plain.normalize(raw) for raw in NORMALIZED]
    assert column(spark, got, text.normalize) == got


def test_normalize_agrees_on_every_whitespace_and_latin_character(spark):
    raws = [f"a{chr(c)}b" for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x1680, 0x3000]]
    assert column(spark, raws, text.normalize) == [plain.normalize(r) for r in raws]


def test_blank_and_strip(spark):
    assert column(spark, ["", " \t ", "a "], text.is_blank) == [True, True, False]
    assert column(spark, [" a b \n", "\t"], text.strip) == ["a b", ""]


def test_penalties_and_their_guard(spark):
    places = spark.createDataFrame([(p,) for p in range(1, 9)], "p int").orderBy("p")
    got = places.select(
        scoring.substitution_penalty(F.col("p")), scoring.indel_penalty(F.col("p"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (5, 10), (4, 8), (3, 6), (2, 4), (1, 2), (1, 2), (1, 2), (1, 2),
    ]
    with pytest.raises(PySparkException, match="counts from 1"):
        spark.createDataFrame([(0,)], "p int").select(
            scoring.indel_penalty(F.col("p"))
        ).collect()


def test_score_formulas(spark):
    one = spark.range(1)
    got = one.select(
        scoring.score_exact(F.lit(11)),
        scoring.score_substitution(F.lit(11), F.lit(11)),
        scoring.score_substitution(F.lit(11), F.lit(4)),
        scoring.score_extra_char(F.lit(12), F.lit(4)),
        scoring.score_missing_char(F.lit(10), F.lit(3)),
    ).first()
    assert tuple(got) == (22, 19, 18, 18, 14)


def test_edit_position(spark):
    cases = [("abcdef", "abcdef", 5), ("xbcdef", "abcdef", 1), ("axcdef", "abcdef", 2),
             ("abxdef", "abcdef", 3), ("abcxef", "abcdef", 4), ("abcdxf", "abcdef", 5),
             ("abcd", "abc", 4), ("abc", "abcd", 4), ("abd", "abc", 3)]
    rows = spark.createDataFrame(cases, "w string, q string, p int")
    got = rows.select("p", scoring.edit_position(F.col("w"), F.col("q")).alias("g")).collect()
    assert [r.g for r in got] == [r.p for r in got]


def test_token_classes(spark):
    def classes(pattern):
        rows = postings.pattern_tokens(spark.createDataFrame([(pattern,)], "pattern string"))
        return [(r.token, r.token_class) for r in rows.orderBy("token_pos").collect()]

    assert classes("this is") == [("this", "suffix"), ("is", "prefix")]
    assert classes(" this is ") == [("this", "whole"), ("is", "whole")]
    assert classes("numpy") == [("numpy", "infix")]
    assert classes(" a") == [("a", "prefix")]
    assert classes("e ") == [("e", "suffix")]
    assert classes("b c d") == [("b", "suffix"), ("c", "whole"), ("d", "prefix")]
    assert classes(" ") == []


def test_interior_tokens(spark):
    patterns = ["this is", " this is ", "import numpy as np", "numpy", "a b c"]
    assert column(spark, patterns, text.interior_tokens) == [
        [], ["this", "is"], ["numpy", "as"], [], ["b"],
    ]


def test_edit_pairs(spark):
    cases = [("numpy arrray", "numpy array"), ("thisis", "this is"), ("a", "a"), ("", "a"), ("a", "")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string")
    got = rows.orderBy("i").select(text.edit_pairs(F.col("a"), F.col("b"))).collect()
    assert [[tuple(p) for p in r[0]] for r in got] == [
        [("arrray", "array")], [("thisis", "this is")], [], [], [],
    ]


def test_reset_marker(spark):
    chunks = ["stale#fresh", "#", "none", "a#b#c", ""]
    assert column(spark, chunks, text.after_reset) == ["fresh", "", "none", "c", ""]


TRANSCRIPTS = [
    ({"alternative": [{"transcript": " recognized words ", "confidence": 0.9},
                      {"transcript": "wreck a nice", "confidence": 0.95}]}, "recognized words"),
    ({"alternative": []}, ""),
    ({}, ""),
    ([], ""),
    ({"alternative": [{"transcript": "  "}, {"confidence": 1}, {"transcript": "last"}]}, "last"),
    (["", " plain text "], "plain text"),
    ([{"transcript": "in array"}], "in array"),
    ("  just \"text\" \n", 'just "text"'),
    (None, ""),
]


def test_best_transcript(spark):
    got = column(spark, [json.dumps(r) for r, _ in TRANSCRIPTS], best_transcript)
    assert got == [expected for _, expected in TRANSCRIPTS]
