"""Sources and sinks on files written by the tests."""

import gzip
import json

import pytest

from turnweave.operators import corpus, scoring
from turnweave.sources import readers, sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def lines(spark, *values):
    return spark.createDataFrame([("c1", v) for v in values], "call_id string, value string")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\nbroken\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": 3, "t": "z"}\n')
    found = readers.read_jsonl(spark, f"file://{tmp_path}", "id int, t string, _corrupt_record string")
    assert {(r.id, r.t, r._corrupt_record) for r in found.collect()} == {(1, "x", None), (2, None, None), (None, None, "broken"), (3, "z", None)}
    assert readers.read_jsonl(spark, f"file://{tmp_path}/none", "id int").count() == 0


def test_documents_in_folders(spark, tmp_path):
    for category, name in (("A1", "x.json"), ("A1", "y.json"), ("B2", "z.json"), ("B2", "other.txt")):
        (tmp_path / category).mkdir(exist_ok=True)
        (tmp_path / category / name).write_text(json.dumps({"id": name, "turns": [{"role": "user"}]}, indent=1))
    found = readers.read_docs(spark, f"file://{tmp_path}", "*.json", "id string, turns array<struct<role: string>>")
    assert rows(found, "id", "category_dir") == [("x.json", "A1"), ("y.json", "A1"), ("z.json", "B2")]
    assert all(r.path.endswith(f"{r.category_dir}/{r.id}") and r.turns[0].role == "user" for r in found.collect())


def test_json_lists(spark, tmp_path):
    (tmp_path / "good.json").write_text(' [{"id": 1, "p": "a"},\n {"id": 2}]')
    assert rows(readers.read_json_array(spark, f"file://{tmp_path}/good.json", "id int, p string"), "id", "p") == [(1, "a"), (2, None)]
    (tmp_path / "bad.json").write_text('{"id": 1}')
    with pytest.raises(Exception, match="not a list"):
        readers.read_json_array(spark, f"file://{tmp_path}/bad.json", "id int").collect()


def test_taxonomy(spark):
    pytest.importorskip("yaml")
    files = {"A1_calm": "mood: [calm, {name: glad, weight: 2}]\ntopic:\n  calm: [sea]\n  glad: [sun, sky]\nnote: text\n", "A10_none": ""}
    found = readers.load_taxonomy(spark, files).collect()
    assert [tuple(r) for r in found] == [("A1", "mood", None, "calm", 1.0), ("A1", "mood", None, "glad", 2.0), ("A1", "topic", "calm", "sea", 1.0), ("A1", "topic", "glad", "sun", 1.0), ("A1", "topic", "glad", "sky", 1.0)]


def test_delimited(spark, tmp_path):
    (tmp_path / "clips.tsv").write_text("path\tsentence\tduration\na.mp3\thello, all\t4200\nb.mp3\t\t4.2\nc.mp3\tx\t\n")
    assert readers.read_clips(spark, f"file://{tmp_path}/clips.tsv", "path string, sentence string, duration double").orderBy("path").collect() == [("a.mp3", "hello, all", 4.2), ("b.mp3", None, 4.2), ("c.mp3", "x", None)]
    (tmp_path / "s.csv").write_text("id,sex\n1,F\n2,\n")
    assert readers.read_speakers(spark, f"file://{tmp_path}/s.csv", "id int, sex string").orderBy("id").collect() == [(1, "F"), (2, None)]
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("id|text\n7|one, two\n")
    assert readers.read_annotations(spark, f"file://{tmp_path}/a.txt.gz", "id int, text string").collect() == [(7, "one, two")]


def test_line_formats(spark):
    ana = lines(spark, "x -c 1 -f 8000-16000 -o u1", "x -c B -f 0-4000 -o u2", "no range", "x -c 2 -f 0-8 -o without")
    trn = lines(spark, "hello there (u1)", "yes (u2)", "words alone")
    assert rows(readers.parse_bbn(ana, trn), "channel", "start", "end", "text") == [("A", 1.0, 2.0, "hello there"), ("B", 0.0, 0.5, "yes")]
    assert rows(readers.parse_trans(lines(spark, "1-2-3 SOME WORDS", " 4 x ", "alone", "")), "id", "text") == [("1-2-3", "SOME WORDS"), ("4", "x")]
    assert rows(readers.parse_speakers(lines(spark, "; id | sex", "14 | F | train", "  16|M", "none")), "speaker", "sex") == [("14", "F"), ("16", "M")]
    assert rows(readers.parse_filelist(lines(spark, "fe_03_00001.sph", "12", "12", "")), "call_id") == [("00003",), ("00012",)]


def test_sample_folders(spark):
    files = spark.createDataFrame([("/r/a/x.wav",), ("/r/a/y.json",), ("/r/b/x.wav",), ("/r/b/x.wav",), ("/r/c/y.json",), ("/r/c/x.wav",), ("/r/c/z",)], "path string")
    assert rows(readers.discover_samples(files, ["x.wav", "y.json"]), "sample_dir") == [("/r/a",), ("/r/c",)]
    candidates = spark.createDataFrame([("s", "/new", 1), ("s", "/old", 2), ("t", "/none", 1), ("u", "/old", 1)], "source string, root string, prio int")
    assert rows(readers.resolve_source(candidates, spark.createDataFrame([("/old",), ("/old",)], "root string")), "source", "root") == [("s", "/old"), ("u", "/old")]


def test_tasks_at_any_depth(spark):
    deep = {"id": "d", "name": "deep"}
    for _ in range(9):
        deep = {"in": [deep, 1]}
    text = json.dumps({"all": [{"id": 1, "name": "a"}, {"id": 2}], "deep": deep, "id": "top", "name": "t"})
    df = spark.createDataFrame([(text,)], "value string")
    assert rows(readers.explode_tasks(df, ["id", "name"]), "id", "name") == [("1", "a"), ("d", "deep"), ("top", "t")]
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


def test_sinks(spark, tmp_path):
    out = f"file://{tmp_path}"
    manifest = spark.createDataFrame([("a", 1.0, "train"), ("b", 2.0, "eval"), ("c", 3.0, "train")], "path string, duration double, split string")
    for _ in range(2):  # a second run replaces the first
        sinks.write_manifests(manifest, f"{out}/m")
    assert rows(spark.read.parquet(f"{out}/m/train"), "path", "duration") == [("a", 1.0), ("c", 3.0)]
    assert spark.read.parquet(f"{out}/m/eval").columns == ["path", "duration"] and spark.read.parquet(f"{out}/m/combined").count() == 3
    sinks.save_docs(spark.createDataFrame([("A1", 1, "x"), ("B2", 2, "y")], "category string, id int, t string"), f"{out}/d")
    sinks.save_docs(spark.createDataFrame([("B2", 3, "z"), ("A1", 1, "new")], "category string, id int, t string"), f"{out}/d")
    assert rows(sinks.load_docs(spark, f"{out}/d"), "category", "id", "t") == [("A1", 1, "new"), ("B2", 2, "y"), ("B2", 3, "z")]
    sinks.write_scores(spark.createDataFrame([("x", 1.5), ("y, z", None)], "setup string, score double"), f"{out}/s")
    assert rows(spark.read.schema("setup string, score double").option("header", True).csv(f"{out}/s"), "setup") == [("x",), ("y, z",)]
    sinks.write_filtered(manifest.withColumn("wer", manifest.duration / 10), "wer < 0.25", ["path", "duration"], f"{out}/f")
    assert rows(spark.read.schema("path string, duration double, wer double").json(f"{out}/f"), "path", "duration", "wer") == [("a", 1.0, None), ("b", 2.0, None)]


def test_pairs_of_files(spark):
    audio, meta = (spark.createDataFrame([(p,) for p in x], "path string") for x in (["/d/a.wav", "/d/b.wav"], ["/d/a_meta.json", "/d/c_meta.json"]))
    assert rows(corpus.with_meta(audio, meta), "path", "meta_path") == [("/d/a.wav", "/d/a_meta.json")]


def test_evaluators(spark):
    records = spark.createDataFrame([("good", 1.0), ("good", 3.0), ("bad", 5.0)], "split string, value double")
    mean = lambda df: df.groupBy("split").agg({"value": "avg"}).withColumnRenamed("avg(value)", "score")
    found = scoring.score_splits(records, {"good": mean, "bad": lambda df: df.select("no_such_column")})
    assert sorted((r.split, r.score) for r in found.collect()) == [("bad", None), ("good", 2.0)]
