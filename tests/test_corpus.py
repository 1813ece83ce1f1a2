import re

import plain
import pytest
from pyspark.sql import functions as F

from lineseek.operators.ranking import number_lines, number_rows
from lineseek.sources import corpus

TREE = {
    "menu.txt": "".join(f"{n}: served until noon.\n" for n in ("Soup", "Porridge", "Toast", "Eggs")),
    "notes.txt": "Yarn comes by the metre.\n\n??\nUPPER and lower Stay.\nThe same note twice.\nRoom 42, floor 7.\n",
    "shelf/list.txt": "Semi-colons; slashes/ and (brackets)!\nOn the shelf.\n",
    "shelf/low/box.txt": "The same note twice.\nBuckets go below.\nUnder everything.\n",
    "readme.md": "other suffix\n",
    "upper.TXT": "suffix in capitals\n",
    "sub dir/a b+é%20.txt": "Odd name.\n",
    "ends.txt": "   padded on both sides  \r\n***\nsingle\rreturn\n\nlast without end",
    "bad.txt": b"a sound line\na stray \xff inside\ncut \xe2\x82\nsurrogate \xed\xa0\x80 end\n",
    "mark.txt": b"\xef\xbb\xbfMarked file\nsecond\n",
    "long.txt": "".join(f"Line number {i} of a longer file\n" + "\n" * (i % 3) for i in range(3000)),
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "my texts"
    for name, content in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def expected():
    rows = []
    for name, content in TREE.items():
        if not name.endswith(".txt"):
            continue
        raw = content if isinstance(content, bytes) else content.encode()
        for offset, line in enumerate(re.split("\r\n|\r|\n", raw.decode("utf-8", "replace")), 1):
            if plain.normalize(line):
                rows.append((line, plain.normalize(line), name, offset))
    return sorted(rows)


def rows_of(lines):
    return sorted(tuple(r) for r in lines.collect())


def test_tree_read_whole(spark, tree):
    assert rows_of(corpus.read_text_tree(spark, tree)) == expected()


def test_tree_read_in_splits(spark, tree):
    """Splits far smaller than the files; only a byte-order mark is read differently."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = rows_of(corpus.read_text_tree(spark, tree, whole_file_bytes=0))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == sorted((r[0].removeprefix("﻿"), *r[1:]) for r in expected())


def test_tree_with_both_kinds_of_files(spark, tree):
    got = corpus.read_text_tree(spark, tree, whole_file_bytes=50_000)
    assert rows_of(got) == expected()
    assert got.columns == ["original_sentence", "normalized_sentence", "source_text", "offset"]


def test_tree_without_text_files(spark, tmp_path):
    (tmp_path / "only.md").write_text("nothing")
    assert corpus.read_text_tree(spark, str(tmp_path)).count() == 0


def test_ordering_ignores_indentation(spark, tmp_path):
    (tmp_path / "doc.txt").write_text(
        "Alpha calls the parser.\n    Zeta calls the parser.\n\tYak calls the parser.\n"
        ">>> Beta calls the parser.\n"
    )
    numbered = number_lines(corpus.read_text_tree(spark, str(tmp_path))).orderBy("line_id")
    assert [r[0].split()[0] for r in numbered.select("normalized_sentence").collect()] == [
        "alpha", "beta", "yak", "zeta",
    ]


def test_alphabet_and_stats(spark, tree):
    lines = corpus.read_text_tree(spark, tree)
    kept = [r[1] for r in expected()]
    assert corpus.corpus_alphabet(lines).first()[0] == "".join(sorted(set("".join(kept))))
    words = {word for line in kept for word in line.split()}
    assert tuple(corpus.corpus_stats(lines).first()) == (len(kept), len(words))
    assert corpus.corpus_alphabet(lines.limit(0)).first()[0] == ""


def test_numbering_spreads_equal_leading_columns(spark):
    """Nine rows in ten share the first sort column; ranks stay dense and in order."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("a"),
        F.col("id").alias("b"),
    )
    numbered = number_rows(rows, ("a", "b"), "n")
    got = [(r.a, r.b) for r in numbered.orderBy("n").collect()]
    assert got == sorted(got)
    assert [r.n for r in numbered.orderBy("n").collect()] == list(range(5000))
