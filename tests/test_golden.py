"""Hand-made cases on the edges of the operators."""

import wave

import numpy as np
import pytest

from turnweave.functions import text as X
from turnweave.operators import corpus, scoring, stats, timing
from turnweave.plans.model import apply_model
from turnweave.sources import audio, readers
from turnweave.streaming.incremental import live_utterances, read_incremental, run_incremental

WORDS = "sample_id long, idx int, word string, start double, end double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_utterances_split_only_over_the_gap(spark):
    w = spark.createDataFrame([(1, 0, "a", 0.0, 1.3), (1, 1, "b", 2.5, 3.0), (1, 2, "c", 4.25, 5.0)], WORDS)
    assert rows(timing.utterances(w), "text") == [("a b",), ("c",)]


def test_take_turn_edges(spark):
    w = spark.createDataFrame(
        [(1, i, "x", i * 0.3, i * 0.3 + 0.3) for i in range(3)] + [(2, i, "x", i * 0.2, i * 0.2 + 0.3) for i in range(4)] + [(3, 0, "x", 0.0, 1.0), (4, 0, "x", 0.0, 0.2), (4, 1, "y", 0.5, None)], WORDS
    )
    assert rows(timing.take_turn(w), "sample_id", "take_turn") == [(1, 0), (2, 1), (3, 1), (4, 0)]


def test_merge_segments_looks_at_all_before(spark):
    s = spark.createDataFrame([(1, "user", 0.0, 10.0), (1, "user", 1.0, 2.0), (1, "user", 10.5, 11.0), (1, "user", 12.0, 13.0)], "sample_id long, channel string, start double, end double")
    assert rows(timing.merge_segments(s, 0.6), "start", "end") == [(0.0, 11.0), (12.0, 13.0)]


def test_equal_times_are_no_gap(spark):
    s = spark.createDataFrame([(1, "user", 0.0, 1.0), (1, "model", 1.0, 2.0), (1, "model", 3.0, 4.0)], "sample_id long, channel string, start double, end double")
    assert rows(timing.response_gaps(s), "user_end", "model_start") == [(1.0, 3.0)]
    assert timing.overlaps(s).count() == 0


def test_chunks(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", i * 8.0, i * 8.0 + 7) for i in range(9)]
    line = spark.createDataFrame(turns, "conv_id long, turn int, role string, start double, end double")
    prompts = spark.createDataFrame([(1, 0.0, 80.0)], "conv_id long, prompt_end double, total double")
    found = corpus.split_conversations(line, prompts, longest=40.0).collect()
    assert [round(r.duration, 3) for r in sorted(found, key=lambda r: r.chunk)] == [39.2, 32.0]
    assert all(r.turns[-1].role == "user" for r in found)


def test_robust_modes_leave_small_groups(spark):
    m = spark.createDataFrame([("pre", "a", 1.0), ("pre", "a", 1000.0), ("pre", "b", 5.0), ("pre", "b", 5.0), ("pre", "b", 5.0), ("pre", "b", 99.0)], "phase string, metric string, value double")
    assert rows(stats.robust_mean(m, "mad"), "metric", "n") == [("a", 2), ("b", 4)]
    assert rows(stats.robust_mean(m, "iqr"), "metric", "n") == [("a", 2), ("b", 3)]


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 100000, 0.05), (0.0, 5, 1.0), (2.7638, 10, 0.02)])
def test_student_table(t, df, p):
    assert stats.student(t, df) == pytest.approx(p, abs=2e-4)


def test_word_errors(spark):
    d = spark.createDataFrame([("a b c", "a c"), ("", "x"), ("(laughs)", ""), ("a b", "x y z")], "r string, h string")
    assert [r.w for r in d.select(scoring.word_errors(d.r, d.h).alias("w")).collect()] == [pytest.approx(1 / 3), 0.0, 0.0, 1.5]


def test_transcripts_and_ratings(spark):
    d = spark.createDataFrame([('```json\n{"turns": [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]}\n``` bye',), ('{"turns": [{"role": "user", "text": "hi"}]}',), ("rating: 3, no, rating: 4",)], "reply string")
    assert [None if r.turns is None else len(r.turns) for r in scoring.parse_transcripts(d).collect()] == [2, None, None]
    assert [r.x for r in d.select(scoring.last_rating(d.reply).alias("x")).collect()] == [None, None, 4]


def test_text_functions(spark):
    d = spark.createDataFrame([("a, b ,c, d", "Seven.", "seven")], "style string, p string, t string")
    r = d.select(X.short_style(d.style).alias("s"), X.answer_matches(d.p, d.t).alias("m"), X.answer_matches(d.p, X.F.lit("")).alias("e"), X.time_seconds(X.F.lit('"0:05"')).alias("s5"), X.activity_seconds(X.F.lit("[(0.5, 1.5), (2, 4)]")).alias("v")).first()
    assert tuple(r) == ("a, b, c", True, False, 5.0, 3.0)


def test_frames(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(np.repeat(np.array([[0, 16384]], "<i2"), 100, axis=0).tobytes())
    found = audio.audio_frames(spark, f"file://{tmp_path}", 50).collect()
    assert sorted((r.channel, r.frame_idx, r.rms, r.n, r.n_quiet) for r in found) == [(0, 0, 0.0, 50, 50), (0, 1, 0.0, 50, 50), (1, 0, 0.5, 50, 0), (1, 1, 0.5, 50, 0)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"path": "x"}\n\n{"path": "y"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "path string").count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "path string").count() == 0
    lines = spark.createDataFrame([("1", "0.5 2.25 A: hello"), ("1", "# no")], "call_id string, value string")
    assert rows(readers.parse_ldc(lines), "channel", "start", "end", "text") == [("A", 0.5, 2.25, "hello")]
    tasks = spark.createDataFrame([('{"x": {"y": [{"id": 1, "goal": "g"}, {"id": 2}]}, "id": 3, "goal": "h"}',)], "value string")
    assert rows(readers.explode_tasks(tasks, ["id", "goal"]), "id", "goal") == [("1", "g"), ("3", "h")]


def test_apply_model_retries_and_keeps(spark):
    d = spark.createDataFrame([(1, None), (2, "old")], "id long, answer string")
    found = apply_model(d, lambda batch: [f"n{i}" for i in batch["id"]], "answer")
    assert rows(found, "id", "answer") == [(1, "n1"), (2, "old")]


def test_incremental_rerun_is_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "1"}\n{"id": "2"}\n')
    go = lambda: run_incremental(spark, str(tmp_path / "in"), "id string", lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck"), "id")
    go(), go()
    (tmp_path / "in/b.json").write_text('{"id": "2"}\n{"id": "3"}\n')
    go()
    assert rows(read_incremental(spark, str(tmp_path / "out"), "id"), "id") == [("1",), ("2",), ("3",)]


def test_live_utterances_as_batch(spark):
    w = spark.createDataFrame([(1, 0, "a", 0.0, 0.3), (1, 1, "b", 1.0, 1.3), (1, 2, "c", 9.0, 9.3)], WORDS)
    live = live_utterances(w.withColumn("ts", X.F.timestamp_millis((w.start * 1000).cast("long"))))
    assert rows(live, "start", "text") == rows(timing.utterances(w), "start", "text")
