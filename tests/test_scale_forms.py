"""Keyed tables, ranges of audio, exact quantiles, brackets, judged replies, edit distances, traits: their edges, and that no task gets it all."""

import json
import random
import struct
import wave
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnweave.functions import brackets
from turnweave.functions import text as X
from turnweave.functions.edits import distances
from turnweave.functions.seeding import uniform
from turnweave.operators import corpus, judged, ordering, sampling, scoring, stats
from turnweave.sources import audio, readers
from turnweave.sources.versions import KeyedTable
from turnweave.streaming.incremental import read_incremental, run_incremental


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# keyed tables


def table_of(spark, tmp_path, key=("k",), buckets=4):
    return KeyedTable(spark, f"file://{tmp_path}/t", list(key), buckets)


def test_a_save_replaces_its_keys_alone(spark, tmp_path):
    t = table_of(spark, tmp_path)
    make = lambda *r: spark.createDataFrame(r, "k string, v int")
    assert t.read().collect() == []
    t.upsert(make(("a", 1), ("b", 2), (None, 3)))
    t.upsert(make(("b", 5), ("c", 6), ("c", 7), (None, 8)))
    assert rows(t.read(), "k", "v") == [("a", 1), ("b", 5), ("c", 7), (None, 8)]
    assert rows(t.read(1), "k", "v") == [("a", 1), ("b", 2), (None, 3)]
    t.upsert(spark.createDataFrame([("a", "x")], "k string, w string"))
    assert rows(t.read(), "k", "v", "w") == [("a", None, "x"), ("b", 5, None), ("c", 7, None), (None, 8, None)]
    t.upsert(t.read().where("k = 'b'").withColumn("v", F.lit(9)))  # from the table itself
    assert ("b", 9, None) in rows(t.read(), "k", "v", "w")
    t.vacuum()
    assert t.versions() == [4] and len(rows(t.read(), "k")) == 4
    assert len(list((tmp_path / "t/data").iterdir())) <= 4


def test_a_crash_between_write_and_switch_loses_nothing(spark, tmp_path, monkeypatch):
    t = table_of(spark, tmp_path)
    make = lambda *r: spark.createDataFrame(r, "k string, v int")
    t.upsert(make(("a", 1), ("b", 2)))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.upsert(make(("a", 5), ("c", 6)))
    assert rows(table_of(spark, tmp_path).read(), "k", "v") == [("a", 1), ("b", 2)]
    t.upsert(make(("a", 5), ("c", 6)))
    assert rows(t.read(), "k", "v") == [("a", 5), ("b", 2), ("c", 6)]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", 1)], "k string, v int"))
    before = t.state()
    t.upsert(spark.createDataFrame([("b", 2)], "k string, v int"))
    with pytest.raises(RuntimeError, match="another writer"):
        t.commit(before)
    assert rows(t.read(), "k", "v") == [("a", 1), ("b", 2)]


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    t = table_of(spark, tmp_path, ("id",), 32)
    make = lambda *r: spark.createDataFrame([(x,) for x in r], "id string")
    assert t.append(make("1", "2", "2"), "run", 0)
    assert not t.append(make("9"), "run", 0)  # a repeated batch
    assert t.append(make("9"), "other", 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.append(make("2", "3"), "run", 1)
    assert rows(t.read(), "id") == [("1",), ("2",), ("9",)]
    assert t.append(make("2", "3"), "run", 1)
    assert rows(t.read(), "id") == [("1",), ("2",), ("3",), ("9",)]
    state = t.state()
    touched = t.touched(make("3"), state)
    assert len(t.rows(state, touched).inputFiles()) < len(t.read().inputFiles())  # only what a batch touches is read
    monkeypatch.setattr(KeyedTable, "MOST_FOLDERS", 1)
    assert t.append(make("3", "4"), "run", 2) and rows(t.read(), "id") == [("1",), ("2",), ("3",), ("4",), ("9",)]
    assert all(len(f) <= 1 for b, f in t.state()["folders"].items() if int(b) in touched)


def test_a_stream_that_forgot_its_last_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "1"}\n')
    where = (str(tmp_path / "in"), "id string", lambda d: d.withColumn("made", F.rand()), f"file://{tmp_path}/out", str(tmp_path / "ck"), "id")
    run_incremental(spark, *where)
    before = rows(read_incremental(spark, where[3], "id"), "id", "made")
    for f in (tmp_path / "ck/commits").iterdir():
        f.unlink()
    run_incremental(spark, *where)  # the batch comes again
    assert rows(read_incremental(spark, where[3], "id"), "id", "made") == before


# audio


def wav(path, channels, rate, data, extra=b""):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(data.tobytes())
    if extra:  # a chunk before the samples
        raw = path.read_bytes()
        path.write_bytes(raw[:12] + extra + raw[12:])


def whole_file(data, size, quiet=0.01):
    x = data / 32768.0
    for c in range(x.shape[1]):
        for k in range(0, len(x), size):
            part = x[k : k + size, c]
            yield c, k // size, round(float(np.sqrt(np.mean(part**2))), 12), len(part), int((np.abs(part) < quiet).sum())


def test_one_long_file_in_many_tasks(spark, tmp_path):
    draw = np.random.default_rng(1)
    data = draw.integers(-3000, 3000, (50_007, 2)).astype("<i2")
    wav(tmp_path / "long.wav", 2, 1000, data, b"LIST\x03\x00\x00\x00abc\x00")
    wav(tmp_path / "none.wav", 1, 1000, data[:0, :1])
    read = lambda: audio.audio_frames(spark, f"file://{tmp_path}", 30, range_bytes=4000)
    found = read()
    assert sorted((r.channel, r.frame_idx, round(r.rms, 12), r.n, r.n_quiet) for r in found.collect()) == sorted(whole_file(data, 30))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 3
    raw = (tmp_path / "long.wav").read_bytes()
    at = raw.index(b"data") + 4
    (tmp_path / "long.wav").write_bytes(raw[:at] + struct.pack("<I", 0xFFFFFFFF) + raw[at + 4 : -2])  # length left open, last sample cut
    assert read().count() == 2 * 1667
    (tmp_path / "bad.wav").write_bytes(b"no sound at all")
    with pytest.raises(Exception, match="bad.wav: not a RIFF"):
        read().count()


# quantiles and order


def test_quantiles_of_a_large_group(spark):
    n = 1_000_000
    big = spark.range(n).select(F.lit("big").alias("g"), ((F.col("id") * 7919 % n) / 8.0).alias("x"))
    tied = spark.range(5000).select(F.lit("tied").alias("g"), F.when(F.col("id") < 4000, 1.5).otherwise(F.col("id")).cast("double").alias("x"))
    few = spark.createDataFrame([("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), (None, 3.0)], "g string, x double")
    found = stats.exact_quantiles(big.union(tied).union(few), ["g"], "x", {"a": 0.0, "b": 0.25, "c": 0.999, "d": 1.0})
    got = {r.g: (r.n, r.a, r.b, r.c, r.d) for r in found.collect()}
    values = {"big": np.arange(n) / 8, "tied": np.append(np.full(4000, 1.5), np.arange(4000, 5000)), "one": [4.0], "two": [1.0, 2.0], None: [3.0]}
    assert got.keys() == values.keys()
    for g, v in values.items():
        assert got[g] == (len(v), *(pytest.approx(np.quantile(v, q), rel=1e-12) for q in (0, 0.25, 0.999, 1)))
    plan = found._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_no_task_looks_through_a_group(spark):
    """What is sorted for a quantile is a small part of the group, in each of its ranges."""
    n, parts = 200_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = spark.range(n).select(F.col("id").cast("double").alias("x"))
    cuts = x.agg(F.percentile_approx("x", F.array(*(F.lit(0.5 + s / (4 * parts)) for s in (-1, 1))), F.lit(20 * parts)).alias("c")).first().c
    assert cuts[1] - cuts[0] < 2 * n / parts


def test_quantiles_without_keys_or_rows(spark):
    x = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert stats.exact_quantiles(x, [], "x", {"m": 0.5}).collect() == [(10, 4.5)]
    assert stats.exact_quantiles(x.limit(0), [], "x", {"m": 0.5}).count() == 0
    assert stats.distribution(x.limit(0), "x").select("n", "median").collect() == [(0, None)]


def test_running_sums(spark):
    draw = random.Random(2)
    data = [(draw.choice(["a", "a", "a", "b", None]), i, draw.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(7)
    groups = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "g string, w int")
    got = {(r.g, r.i): (r.s, r.s_total, r.w) for r in ordering.running_sums(df, ["i"], {"s": F.col("v")}, ("g",), groups).collect()}
    total, sums = Counter(), {}
    for g, i, v in data:
        total[g] += v
        sums[g, i] = total[g]
    assert got == {k: (s, total[k[0]], {"a": 1, "b": 2, None: 3}[k[0]]) for k, s in sums.items()}
    numbered = ordering.dense_numbers(df.select("i"), [F.desc("i")]).collect()
    assert all(r.number == 499 - r.i and r.number_total == 500 for r in numbered)
    assert ordering.dense_numbers(df.limit(0), ["i"]).count() == 0


def test_order_is_that_of_the_seed(spark):
    df = spark.range(300).repartition(6)
    got = [r.id for r in corpus.seeded_order(df, 42, "id").collect()]
    key = {r.id: r.u for r in df.select("id", uniform(42, "id").alias("u")).collect()}
    assert got == sorted(got, key=lambda i: (key[i], i)) and got != sorted(got)


# brackets and replies

DECODER = json.JSONDecoder()


def first_with(text, key):
    """Reads at each brace in turn, behind each object that was read."""
    at = text.find("{")
    while at >= 0:
        try:
            value, end = DECODER.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            if key in value:
                return value
        at = text.find("{", end)
    return None


def test_objects_of_random_texts(spark):
    draw = random.Random(7)
    parts = ["{", "}", "[", "]", '"', "\\", '"k"', '"é"', ":", ",", "1", " ", '{"k": 1}', '{"a": "}"}', '{"k": {"k": "\\"{"}}', "null", "日", '{"é": [{}]}']
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    texts += ["", "{" * 500, '{"a":' * 200 + '{"k": "x"}' + "}" * 100, "\\" * 9, '\\"{"k": 2}', '"{\\"k\\": 1}" {"k": 3}', "{}" * 40 + '{"k": []}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    for r in df.select("i", brackets.object_with_key(F.col("t"), "k").alias("o")).collect():
        assert (json.loads(r.o) if r.o is not None else None) == first_with(texts[r.i], "k"), texts[r.i]
    assert spark.createDataFrame([(None,)], "t string").select(brackets.object_with_key(F.col("t"), "k").alias("o")).first().o is None


def test_spans_of_slices():
    texts = pa.array(["x{", "é{a{b}}", None, "}", "{}"])
    spans = lambda t: [[(s["open"], s["close"]) for s in x] for x in brackets.spans_of(t, 0x7B, 0x7D).to_pylist()]
    assert spans(texts) == [[], [(1, 6), (3, 5)], [], [], [(0, 1)]]
    assert spans(texts.slice(1, 2)) == [[(1, 6), (3, 5)], []] and spans(texts.slice(0, 0)) == []


def test_first_object(spark):
    cases = [('```json\n{"a": {"b": "}"}} tail\n```', '{"a": {"b": "}"}}'), ('x {"a": 1', None), ("{bad} {}", None), ("none", None), ('{"a": "{"}', '{"a": "{"}')]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r.o for r in df.select(brackets.first_object(F.col("t")).alias("o")).collect()] == [w for _, w in cases]


def reply_events(spark, *replies):
    events, scores = judged.parse_judged(spark.createDataFrame([("s", i, r) for i, r in enumerate(replies)], "setup string, task_id int, reply string"))
    found = [[] for _ in replies]
    for r in sorted(events.collect(), key=lambda r: (r.task_id, r.block, r.pos, r.start)):
        found[r.task_id].append((r.start, r.end, r.tt, r.follow))
    tasks = {r.task_id: r.score for r in scores.collect()}
    return [(f, tasks.get(i)) for i, f in enumerate(found)]


def test_judged_replies(spark):
    e, t = f'"{judged.EVENTS}"', f'"{judged.TASK}"'
    clean = f'{{{e}: [[[1, 2], 4, 5], [[[3, 4], ["0:05", "1:06.5"]], "3", null], [7, 8, 1, 2], [[1, 2], 3], "x", [["a", "b"], 1, 2]], {t}: "4"}}'
    assert reply_events(spark, clean) == [([(1, 2, 4, 5), (3, 4, 3, None), (5, 66.5, 3, None), (7, 8, 1, 2)], 4)]
    pairs = f'{{{e}: [[{{1, 2}}, 4, 5], [{{"start": 3, "end": 4}}, 1.9, 1], [{{"endTime": 6, "startTime": 5}}, 0, 0]]}}'
    assert reply_events(spark, pairs) == [([(1, 2, 4, 5), (3, 4, 1, 1), (5, 6, 0, 0)], None)]
    half = f'So {{ {e}: [[{{1, 2}}]: 4, 5, [[3, 4], [5, 6]]: "null" , 2, [7, 8], [9, 10]: 1], {t}: 3 and more'
    assert reply_events(spark, half) == [([(1, 2, 4, 5), (3, 4, None, 2), (5, 6, None, 2), (9, 10, 1, None)], 3)]
    fences = f"A\n```json\n{{{e}: [[[1, 2], 1, 1]], {t}: 2}}\n```\nB\n```\n{{{e}: [[3, 4]: 5, 5], {t}: 0}}\n```\n```\nother\n```"
    assert reply_events(spark, fences) == [([(1, 2, 1, 1), (3, 4, 5, 5)], 0)]
    free = ["From [1, 2]: 4, 5, I think", "", None, f"{e} nothing", f"{e}: [[1, 2]: 3, 4", f'{{{t}: 3}}', clean + "]", f'{{{e}: {{"a": 1}}, {t}: 1}}']
    assert reply_events(spark, *free) == [([], None)] * 5 + [([], 3)] + [([(7, 8, None, None)], None)][:0] + reply_events(spark, *free)[6:7] + [([], 1)]


def test_loose_replies(spark):
    df = spark.createDataFrame([("s", 1, "[1, 2]: 3, 4 task score: 5")], "setup string, task_id int, reply string")
    events, scores = judged.parse_judged(df, loose=True)
    assert rows(events, "start", "end", "tt", "follow") == [(1.0, 2.0, 3.0, 4.0)] and rows(scores, "score") == [(5.0,)]


def test_task_scores_are_read_once(spark):
    e, t = f'"{judged.EVENTS}"', f'"{judged.TASK}"'
    block = lambda score: f'```json\n{{{e}: [[[1, 2], 4, 5]]{score}}}\n```'
    both, first, second, none = block(f", {t}: 1") + block(f", {t}: 2"), block(f", {t}: 1") + block(""), block(f', {t}: "x"') + block(f", {t}: 2"), block("") + block("")
    assert [s for _, s in reply_events(spark, both, first, second, none)] == [2, 1, 2, None]
    _, scores = judged.parse_judged(spark.createDataFrame([("s", 1, both)], "setup string, task_id int, reply string"))
    assert scores._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


# edit distances


def table_distance(a, b):
    row = list(range(len(a) + 1))
    for k, w in enumerate(b, 1):
        new = [k]
        for i, v in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (v != w)))
        row = new
    return row[-1]


def test_edit_distances_of_random_pairs():
    draw = random.Random(4)
    lists = lambda n: [[draw.randint(0, 6) for _ in range(draw.choice([0, 1, 2, 5, 20, 63, 64, 65, 130]))] for _ in range(n)]
    a, b = lists(300), lists(300)
    b[:40] = [[x for x in y if draw.random() < 0.9] for y in a[:40]]
    flat = lambda lists: (np.array([x for y in lists for x in y], np.int64), np.concatenate([[0], np.cumsum([len(y) for y in lists])]))
    assert distances(flat(a), flat(b)).tolist() == [table_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert distances(flat([]), flat([])).tolist() == [] and distances(flat([[]]), flat([[1, 2]])).tolist() == [2]


def test_edits_with_nulls(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["a"]), ([], []), (["x"], None), (["ä", "b", "c"], ["b", "c", "ä"])], "r array<string>, h array<string>")
    assert [r.e for r in df.select(scoring.edits("r", "h").alias("e")).collect()] == [1, None, 0, None, 2]


# draws


def test_traits_at_any_depth(spark):
    rows_ = [("A", "place", None, "sea", 1.0), ("A", "place", None, "town", 3.0), ("A", "boat", "sea", "sail", 1.0), ("A", "boat", "sea", "none", 0.0), ("A", "mast", "sail", "one", 1.0), ("A", "mast", "sail", "two", 1.0), ("A", "flag", "two", "red", 1.0), ("A", "shop", "town", "bread", 1.0)]
    taxonomy = spark.createDataFrame(rows_, "category string, slot string, parent string, option string, weight double")
    slots = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 3900, "A").otherwise("B").alias("category"))
    found = {r.id: r.traits for r in sampling.draw_traits(slots, taxonomy).collect()}
    seen = Counter(tuple(sorted(t.items())) for t in found.values() if t)
    at_sea = {k: n for k, n in seen.items() if ("place", "sea") in k}
    assert all(found[str(i)] is None for i in range(3900, 4000))
    assert set(seen) == {(("place", "town"), ("shop", "bread")), (("boat", "sail"), ("mast", "one"), ("place", "sea")), (("boat", "sail"), ("flag", "red"), ("mast", "two"), ("place", "sea"))}
    assert 850 < sum(at_sea.values()) < 1100 and all(400 < n < 600 for n in at_sea.values())
    circle = spark.createDataFrame([("A", "x", None, "a"), ("A", "y", "a", "b"), ("A", "x", "b", "a")], "category string, slot string, parent string, option string")
    with pytest.raises(Exception, match="RECURSION"):
        sampling.draw_traits(slots, circle)


def test_voices_of_empty_tables(spark):
    d, some = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("v",)], "id string")
    assert rows(sampling.assign_voices(d, some.limit(0), some), "id", "assistant_voice", "user_voice") == [("1", "default", "v"), ("2", "default", "v")]


def test_style_pairs(spark):
    slots = spark.createDataFrame([("1", "counterfactual", None), ("2", "plain", {"a": "b"}), ("3", "counterfactual", {"a": "b", "style_a": "x"})], "id string, data_type string, traits map<string,string>")
    styles = spark.createDataFrame([("pace", "fast", "slow")], "dimension string, style_a string, style_b string")
    found = {r.id: r.traits for r in sampling.style_pair(slots, styles).collect()}
    pair = {"diff_dimension": "pace", "style_a": "fast", "style_b": "slow"}
    assert found == {"1": pair, "2": {"a": "b"}, "3": {"a": "b"} | pair}


# smaller ones


def test_styles_and_ages(spark):
    df = spark.sql("SELECT * FROM VALUES (map('voice', 'v', 'tone', 'warm', 'pace', 'slow', 'mood', 'neutral', 'a', 'x', 'b', 'y'), ' Twenties '), (map('voice', 'v'), '20'), (null, null) AS t(style, age)")
    got = df.select(X.style_of_object(F.col("style")).alias("s"), X.normal_age(F.col("age")).alias("a")).collect()
    assert [tuple(r) for r in got] == [("warm, slow, x", "twenties"), (None, None), (None, None)]


def test_clear_bad_and_force(spark):
    df = spark.createDataFrame([(1, "fine", 3), (2, ' {"a"', 4), (3, None, 5), (4, "  ", 6)], "i int, transcription string, score int")
    assert rows(scoring.clear_bad(df), "i", "transcription", "score", "pending") == [(1, "fine", 3, False), (2, None, None, True), (3, None, 5, True), (4, None, None, True)]
    assert rows(scoring.clear_bad(df, force=True), "transcription", "score", "pending") == [(None, None, True)] * 4


def test_subsets_by_prefix(spark):
    df = spark.createDataFrame([("synthetic_1",), ("candor_",), ("candor_x_2",), ("candorx",), ("other_1",)], "sample_id string")
    assert rows(scoring.by_prefix(df, ["synthetic", "candor"]), "subset", "sample_id") == [("candor", "candor_"), ("candor", "x_2"), ("synthetic", "1")]


def test_paired_test_and_its_sentence(spark):
    """Five pairs that differ by 1 to 5: t, its table value and its p are those of the books."""
    data = [(i, phase, "wpm", 10.0 + (i if phase == "post" else 0)) for i in range(1, 6) for phase in ("pre", "post")]
    r = stats.paired_test(spark.createDataFrame(data, "sample_id int, phase string, metric string, value double"), None).where("pair = 'pre_post'").withColumn("said", stats.conclusion()).first()
    assert (r.n_used, r.df, r.mean_diff) == (5, 4, 3.0)
    assert r.t == pytest.approx(4.24264, abs=1e-5) and r.p == pytest.approx(0.013236, abs=1e-6) and r.d_z == pytest.approx(1.897367, abs=1e-6)
    assert (r.ci_low, r.ci_high) == (pytest.approx(3 - 2.776445 * 0.707107, abs=1e-5), pytest.approx(3 + 2.776445 * 0.707107, abs=1e-5))
    assert r.said == "wpm (pre_post): rises, reliably; 10.00 to 13.00, difference 3.00 [1.04, 4.96], t(4)=4.24, p=0.013, d_z=1.90"
    few = stats.paired_test(spark.createDataFrame(data[:2], "sample_id int, phase string, metric string, value double"), None).where("pair = 'pre_post'").withColumn("said", stats.conclusion()).first()
    assert few.said == "wpm (pre_post): too few pairs"


@pytest.mark.parametrize(
    ("kind", "good", "bad", "warning"),
    [
        ("self_coherence", ["Actually, it was four."], ["It was four."], "self_coherence: no corrective phrase"),
        ("contradiction_detection", ["Hm.", "Did something change since then?"], ["Did something change since then?", "Fine."], "contradiction_detection: no soft-flag phrase"),
        ("numerical_state_tracking", ["That makes 12."], ["That makes twelve."], "numerical_state_tracking: no digits"),
        ("progressive_synthesis", ["So the garden fence needs painting before winter."], ["So it does."], "progressive_synthesis: fewer than 3 words echoed"),
        ("incidental_memory", ["Fine.", "Your garden, then."], ["Fine.", "Good, then."], "incidental_memory: no early words"),
        ("reference_resolution", ["We met Anna there.", "Yes."], ["We met her there.", "Yes."], "reference_resolution: no proper noun"),
    ],
)
def test_memory_warnings(spark, kind, good, bad, warning):
    asked = ["My garden fence needs painting.", "It must be done before winter.", "So what now?"]
    for said, wanted in ((good, []), (bad, [warning])):
        turns = [(1, 2 * i, "user", t) for i, t in enumerate(asked)] + [(1, 2 * i + 1, "assistant", t) for i, t in enumerate(said)]
        df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
        assert scoring.memory_warnings(df, F.lit(kind)).first().warnings == wanted


def test_tasks_in_one_plan(spark):
    deep = {"id": 1, "name": 'x"{'}
    for k in range(12):
        deep = {"in": [deep, {"id": k + 2}], "t": "}{"}
    df = spark.createDataFrame([(json.dumps(deep),), ("[]",), (None,)], "value string")
    assert rows(readers.explode_tasks(df, ["id", "name"]), "id", "name") == [("1", 'x"{')]
    assert len(rows(readers.explode_tasks(df, ["id"]), "id")) == 13
    with pytest.raises(Exception, match="MALFORMED"):
        readers.explode_tasks(spark.createDataFrame([("{no",)], "value string"), ["id"]).collect()
