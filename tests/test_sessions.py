import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lineseek.operators import scan, sessions
from lineseek.streaming import jobs
from lineseek.streaming.versions import Versions

LOGS = {
    1: ["green", " tea"],
    2: ["sugar", "#", "milk"],
    3: ["cold#warm"],
    4: ["", " \t", "  "],
    5: ["lemon", ""],
    6: ["two", " ", "cups"],
    7: ["p#", "", "q", "r#s#", "t"],
}


def long_log(seed, size):
    rng = random.Random(seed)
    return [rng.choice(["a", "b ", "", " ", "x#y", "#", "word"]) if rng.random() < 0.4 else "z" for _ in range(size)]


def told(logs):
    """The texts one after another, in plain Python: (session, seq, text, fired)."""
    rows = []
    for session, log in logs.items():
        text = ""
        for seq, chunk in enumerate(log):
            if not chunk:
                continue
            text = chunk.rsplit("#", 1)[1] if "#" in chunk else text + chunk
            rows.append((session, seq, text, bool(text.strip())))
    return sorted(rows)


def chunk_table(spark, logs):
    rows = [(s, i, c) for s, log in logs.items() for i, c in enumerate(log)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "session_id long, seq long, chunk string")


@pytest.mark.parametrize("block_rows", [5, 1024])
def test_session_text(spark, block_rows):
    logs = {**LOGS, 8: long_log(1, 150), 9: long_log(2, 90), 10: ["w"] * 60}
    got = sessions.session_text(chunk_table(spark, logs), block_rows=block_rows).collect()
    assert sorted(tuple(r) for r in got) == told(logs)


def test_session_text_by_timestamps(spark):
    """Rows years and milliseconds apart fall into blocks by their number alone."""
    logs = {**LOGS, 8: long_log(5, 120)}
    at = F.expr("timestamp_millis(case when seq < 60 then seq else seq * 100000000000 end)")
    table = chunk_table(spark, logs).withColumn("at", at)
    timed = table.select("session_id", F.col("at").alias("seq"), "chunk")
    got = sessions.session_text(timed, block_rows=16).withColumnRenamed("seq", "at")
    back = got.join(table.select("session_id", "seq", "at"), ["session_id", "at"])
    rows = back.select("session_id", "seq", "session_text", "fired").collect()
    assert sorted(tuple(r) for r in rows) == told(logs)


def test_no_task_sees_more_than_a_block_of_one_session(spark):
    """The windows are dealt by block only, and a block holds so many rows, whoever's they are."""
    table = chunk_table(spark, {1: ["z"] * 200, 2: ["y"] * 3})
    placed = scan.in_order(sessions.chunk_events(table), ("session_id", "seq"))
    blocks = placed.groupBy(F.expr("_place div 16")).count().collect()
    assert len(blocks) == 13 and max(r["count"] for r in blocks) == 16
    plan = scan.running_text(placed, "session_id", 16)._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\((\w+?)#", plan))
    # `_part` deals the counts per partition by which rows are numbered.
    assert "_block" in dealt and dealt <= {"_block", "_part"}


def test_fired_texts(spark):
    got = sessions.session_queries(chunk_table(spark, LOGS)).orderBy("session_id", "seq").collect()
    assert [r.query_text for r in got if r.session_id < 6] == [
        "green", "green tea", "sugar", "milk", "warm", "lemon",
    ]


@pytest.mark.parametrize("block_rows", [2, 3, 1024])
def test_drop_repeats(spark, block_rows):
    contents = [None, None, b"A", b"A", b"B", b"A", b"A", b"A", b"C"]
    rows = [(s, i, c) for s in (1, 2, None) for i, c in enumerate(contents)]
    table = spark.createDataFrame(rows, "session long, seq long, content binary")
    kept = sessions.drop_repeats(table, "session", "seq", "content", block_rows=block_rows)
    assert kept.columns == ["session", "seq", "content", "content_hash"]
    assert {(r.session, r.seq) for r in kept.collect()} == {(s, i) for s in (1, 2, None) for i in (0, 2, 4, 5, 8)}
    assert kept.count() == 15


def test_screen_shows_texts_without_results(spark):
    fired = spark.createDataFrame([(1, 0, "tea"), (1, 1, "tea qq")], "session_id long, seq long, query_text string")
    row = (1, 0, 1, "Green tea", "menu.txt", 4, 6)
    found = spark.createDataFrame(
        [row],
        "session_id long, seq long, rank int, completed_sentence string, source_text string, offset int, score int",
    )
    got = sorted(tuple(r) for r in sessions.screen(fired, found, ("session_id", "seq")).collect())
    assert got == [
        (1, 0, 0, "Here are 1 suggestions:"), (1, 0, 1, "1. Green tea (menu.txt:4, score=6)"), (1, 0, 2, "tea"),
        (1, 1, 0, "No suggestions found."), (1, 1, 1, "tea qq"),
    ]


def test_transcribe(spark):
    def answer(*transcripts):
        return json.dumps({"alternative": [{"transcript": t} for t in transcripts]})

    rows = [
        (1, "en-US", "en-US", answer(" spoken text ", "other")),
        (1, "en-US", "en-GB", answer("not looked at")),
        (2, "en-US", "en-US", json.dumps({"alternative": []})),
        (2, "en-US", "en-GB", answer("again")),
        (3, "en-US", "en-US", answer("  ")),
        (3, "en-US", "en-GB", "[]"),
        (4, "en-GB", "en-GB", answer("words of one language")),
        (4, "en-GB", "en-US", answer("not tried")),
        (5, "fr-FR", "fr-FR", "{}"),
        (5, "fr-FR", "en-GB", answer("not tried")),
    ]
    table = spark.createDataFrame(
        rows, "recording_id long, requested_language string, language string, response string"
    )
    got = {r.recording_id: (r.transcript, r.error) for r in sessions.transcribe(table).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: "spoken text", 2: "again", 3: None, 4: "words of one language", 5: None,
    }
    assert [k for k, v in got.items() if v[1]] == [3, 5]


def test_rendering(spark):
    rows = [(1, 1, "Kettle on: boil.", "tea.txt", 1, 14), (1, 2, "Cup at 100%", "b/c.txt", 2, 3)]
    table = spark.createDataFrame(
        rows,
        "query_id int, rank int, completed_sentence string, source_text string, offset int, score int",
    )
    got = sessions.render_results(table, ("query_id",)).orderBy("rank").collect()
    assert [r.line for r in got] == [
        "1. Kettle on: boil. (tea.txt:1, score=14)",
        "2. Cup at 100% (b/c.txt:2, score=3)",
    ]
    assert {r.header for r in got} == {"Here are 2 suggestions:"}


def stream_of(spark, table, folder, bounds, order="seq"):
    for low, high in zip((None, *bounds), (*bounds, None)):
        part = table if low is None else table.where(F.col(order) >= low)
        part = part if high is None else part.where(F.col(order) < high)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_session_text_over_several_batches(spark, tmp_path):
    """One session has a third of the rows of every batch; the last batches go past a whole table."""
    logs = {**LOGS, 8: long_log(3, 40), 11: [f" {n}" for n in range(40)]}
    table = chunk_table(spark, logs)
    bounds = (2, 5, 9)
    stream = stream_of(spark, table, str(tmp_path / "in"), bounds)
    out = str(tmp_path / "out")
    jobs.write_session_text(stream, out, str(tmp_path / "check"), block_rows=16, every=2).awaitTermination()
    got = spark.read.parquet(f"{out}/text").select("session_id", "seq", "session_text", "fired")
    assert sorted(tuple(r) for r in got.collect()) == told(logs)
    reached = {r.session_id: r.session_text for r in jobs.session_versions(spark, f"{out}/reached", 2).latest().collect()}
    assert reached == {s: text for s, _, text, _ in told(logs)}
    # Only the changes since the last whole table are read.
    assert sorted(p.name for p in (tmp_path / "out" / "reached" / "full").iterdir()) == ["version=2", "version=4"]


def test_a_batch_of_sessions_runs_without_python(spark):
    batch = chunk_table(spark, LOGS)
    state = spark.createDataFrame([(1, "so "), (9, "unused")], "session_id long, session_text string")
    for out in jobs.continue_sessions(batch, state):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert {r.session_text for r in jobs.continue_sessions(batch, state)[0].where("session_id = 1").collect()} == {
        "so green", "so green tea",
    }


def test_a_batch_run_again_leaves_the_same_table(spark, tmp_path):
    kept = Versions(spark, str(tmp_path / "t"), "k", "v long", every=2)
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v long")
    steps = [row("a", 1), row("b", 2), row("a", 3), row("c", 4), row("d", 5)]
    for batch_id, changed in enumerate(steps):
        for _ in range(2):
            kept.before(batch_id).count()
            kept.store(batch_id, changed, row("b", None).select("k") if batch_id == 3 else None)
    assert sorted(map(tuple, kept.latest().collect())) == [("a", 3), ("c", 4), ("d", 5)]
