"""Cases that once went wrong: repeated words in benchmark items, families of near copies, reads by offset, odd column names."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnweave.functions import shared
from turnweave.llm import common, contamination, near_dedup, records, suffix_tree_lm
from turnweave.llm.queries import tokenizer_file

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(("times", "length"), [(1, 14), (4, 38), (8, 70), (9, 78), (12, 102), (16, 134)])
def test_items_that_end_in_a_repeated_word(times, length):
    """A window whose difference lies in one shingle of high weight is as near as any other."""
    draw = random.Random(times)
    word = lambda: f"w{draw.randrange(10**9)}"
    bases = [[word() for _ in range(length)] for _ in range(150)]
    items = contamination.Items([(i, " ".join([*b, *["x"] * times])) for i, b in enumerate(bases)], 5, 0.8, 20)
    texts = [" ".join([*(word() for _ in range(draw.randint(0, 30))), *b, *["y"] * times, *(word() for _ in range(draw.randint(0, 30)))]) for b in bases]
    found = {at: [items.ids[i] for i, *_ in m] for at, m in items.search(pa.array(texts))}
    assert found == {k: [[k]] for k in range(len(texts))}


def test_recall_over_a_whole_benchmark(spark):
    """Every pair of a document and an item of the given tables whose best window reaches the similarity, by all windows."""
    data, word = "/root/testdata/sf0.01", re.compile(r"[^\x20\x09-\x0D]+")
    cut = lambda t: [tuple(w[i : i + 5]) for w in [word.findall((t or "").translate(A_Z))] for i in range(max(1, len(w) - 4))] if (t or "").strip() else []
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    held = {r.item_id: cut(r.text) for r in items.collect() if r.text}
    with_shingle = defaultdict(set)
    for i, s in held.items():
        for x in s:
            with_shingle[x].add(i)
    wanted = {}
    for r in docs.collect():
        own = cut(r.text)
        for i in {i for x in own for i in with_shingle.get(x, ())}:
            item, width = Counter(held[i]), min(len(held[i]), len(own))
            best = 0
            for a in range(len(own) - width + 1):
                both = (Counter(own[a : a + width]) & item).total()
                best = max(best, both / (width + item.total() - both))
            if best >= 0.8:
                wanted[r.doc_id, i] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in contamination.find_contamination(docs, items).collect()}
    assert got.keys() == wanted.keys() and len(wanted) > 20
    assert all(got[k] == pytest.approx(v) for k, v in wanted.items())


def test_fingerprints_are_those_of_occurrences():
    draw = random.Random(1)
    import numpy as np

    shingles = np.array([draw.randint(1, 6) for _ in range(200)], np.uint64)
    starts = np.array([0, 3, 50, 150])
    got = contamination.fingerprints(shingles, starts, 40)
    for start, print_ in zip(starts, got, strict=True):
        seen, total = {}, np.zeros(64, np.int64)
        for s in shingles[start : start + 40]:
            k = seen[s] = seen.get(s, -1) + 1
            total += contamination.bits_of(np.array([s + np.uint64(k) * np.uint64(0xD1B54A32D192ED03)], np.uint64))[0]
        assert print_ == np.packbits(total > 0).view(np.uint64)[0]


def families(n):
    """One group of near copies in 12 families, each with a few words of its own, each document with others of its own: at 0.79 to its family, it is linked to none."""
    rows = []
    for i in range(n):
        words = [f"b{k}" for k in range(240)]
        for k in range(4):
            words[(i % 12) * 17 + 4 * k] = f"family{i % 12}_{k}"
        for k in range(14):
            words[17 * k + 2] = f"own{i}_{k}"
        rows.append((i, " ".join(words)))
    return rows


def test_pairs_of_families_grow_with_the_input(spark, monkeypatch):
    counts, links, across = [], [], near_dedup.across
    monkeypatch.setattr(near_dedup, "across", lambda *a: (counts.append((found := across(*a)).count()), found)[1])
    for n in (150, 300):
        rows = families(n)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
        sets = {i: set(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
        part = {i: i for i in sets}
        linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        for _ in range(6):
            for a, b in linked:
                part[a] = part[b] = min(part[a], part[b])
        assert got == part
        links.append(len(linked))
    assert counts[1] <= 2.6 * max(counts[0], links[1], 100)


def test_reads_open_wanted_files_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(400)], "doc_id long, text string")
    out = f"file://{tmp_path}/records"
    index = records.write_token_records(docs, tokenizer_file("word_bpe_49k.json"), out, file_bytes=2048)
    files = sorted(r.file for r in index.select("file").distinct().collect())
    assert len(files) > 4
    wanted = index.where(F.col("file") == files[2]).where("doc_id % 2 = 0").select("file", "offset")
    wanted = spark.createDataFrame(wanted.union(wanted).collect(), wanted.schema)
    whole = {r.doc_id: r.n_tokens for r in index.where(F.col("file") == files[2]).collect()}
    for other in (tmp_path / "records/data").iterdir():
        if other.name not in files[2]:
            other.unlink()  # whatever opened them would fail
    got = records.read_at(spark, out, wanted)
    assert {r.doc_id: len(r.ids) for r in got.collect()} == {i: n for i, n in whole.items() if i % 2 == 0}
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    (tmp_path / "records/data" / files[2].rpartition("/")[2]).write_bytes(b"\0" * 10_000)
    with pytest.raises(Exception, match="damaged length"):
        got.collect()


ODD_NAMES = ["_", "a.b", "row", "c0", "a`b", "lost_id", "text_hash", "key"]


@pytest.mark.parametrize("names", [ODD_NAMES, []])
def test_stages_with_odd_column_names(spark, tmp_path, names):
    own = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + own if own else "")
    rows = [(i, f"some words of text {i % 15}, " * 9 + f"and its end {i}", "en", "s", 3, *("x" for _ in names)) for i in range(30)] + [(30, "shared words of a test item that all may know", "en", "s", 3, *("x" for _ in names))]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "shared words of a test item that all may know")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        kept = found.collect()
        assert all(r[n] == "x" for r in kept for n in names) and kept
    assert common.quoted("a.b`") == "`a.b```"


def test_differences_are_ordered_without_a_join(spark):
    rng, sets = np.random.default_rng(3), []
    for k in range(40):
        sets.append((7 if k % 2 else 8, k, {"doc_id": k % 5, "class": k % 5}, bool(k % 5), 30, 30, np.unique(rng.integers(0, 40, 20 + k)).astype(np.uint64)))
    rows = [(p, k, part, out, m, n, len(e), e.tobytes()) for p, k, part, out, m, n, e in sets]
    seen = spark.createDataFrame(rows, "pivot long, class long, part struct<doc_id: long, class: long>, outside boolean, m long, n long, d long, elements binary")
    shown = near_dedup.differences(seen, 80)
    assert "Join" not in shown._jdf.queryExecution().executedPlan().toString()
    places = {}
    for r in shown.collect():
        assert r.excess == 180 * r.d - 20 * r.n
        places.setdefault((r.pivot, r["class"]), {})[r.place] = r.element
    counts = Counter((p, int(x)) for p, *_, e in sets for x in e)
    for p, k, *_, e in sets:
        order = sorted(map(int, e), key=lambda x: (int(8 * np.log2(counts[p, x])), x))
        assert places.get((p, k), {}).items() <= dict(enumerate(order)).items()
    assert all(k in places for k in ((p, k) for p, k, *_ in sets))
    assert not shown.where(~F.col("seeks") & ~F.col("met")).count()


def test_tasks_give_free_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 100] * 50)], names=["text"])
    assert sum(p.num_rows for p in common.pieces(iter([batch, batch]), 5000)) == 100 and calls == [1]
    assert not list(common.pieces(iter([]), 5000)) and calls == [1, 1]


def test_words_are_hashed_side_by_side(monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choice("abXY é中😀.") for _ in range(draw.randint(0, 20))) for _ in range(3000)] + ["x" * k for k in range(70)]
    for found in (pa.array(words), pa.array(words)[7:90], pa.array([], pa.string()), pa.array([""])):
        assert common.xxh64(found).tolist() == [common.xxhash.xxh64_intdigest(w.encode()) for w in found.to_pylist()]
    asked, library = [], common.xxhash.xxh64_intdigest
    monkeypatch.setattr(common.xxhash, "xxh64_intdigest", lambda w: (asked.append(w), library(w))[1])
    common.Words(pa.array(["some short words"] * 5)).unique_hashes()
    assert not asked


def test_texts_go_to_python_in_bounded_batches(spark):
    """Long texts: 40 MB in 4,000 rows are one Arrow batch by Spark's count of rows."""
    own = spark.newSession()
    docs = own.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some text ', 1000)").alias("text"))
    held = lambda batch: pa.RecordBatch.from_arrays([pa.array([batch.column("text").buffers()[2].size]), pa.array([batch.num_rows])], names=["held", "n"])
    found = common.over_texts(docs, held, "held long, n long").collect()
    assert sum(r.n for r in found) == 4000 and max(r.held for r in found) < 2 * common.BATCH_BYTES
    own = spark.newSession()
    own.conf.set(common.ARROW_BYTES, "1000000")
    common.bound_batches(own)
    assert own.conf.get(common.ARROW_BYTES) == "1000000"


def test_words_of_letters_are_learnt_without_marks():
    """op8 learns new words of letters alone in one text, cut at the last token of each; ids are the library's."""
    from tokenizers import Tokenizer

    path, draw, texts = tokenizer_file("word_bpe_49k.json"), random.Random(8), []
    library, own = Tokenizer.from_file(path), records.WordEncoder(path)

    class Recorder:
        def encode_batch_fast(self, some, **how):
            texts.extend(some)
            return library.encode_batch_fast(some, **how)

    assert own.by_word
    own.tokenizer = Recorder()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZßàéïÑÖÿÀ"
    whole = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 25))) for _ in range(25_000)]
    others = ["\x01", "a\x01b", "\x01\x01.", "x1", "don't", "'S", "</w>", "a</w>", "\u0301e", "º", "×a", "\u00a0", "日本", "<|endoftext|>", "\x01<|endoftext|>"]
    rows = [" ".join(draw.choice(whole if draw.random() < 0.9 else others) + draw.choice(["", ".", ",", "$$$"]) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    ids, starts = own.encode(pa.array(rows))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    of_letters = set(whole)
    seen = {w: t for t in texts for w in t.split() if w in of_letters}
    assert len(seen) > 15_000 and not any("\x01" in t or "<|" in t for t in seen.values())


def test_suffix_tree_scores_with_little_disk(spark, monkeypatch):
    """With a head that lacks nearly all, in shares and rounds: the scores of a whole head, and no table on the way larger than the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sum(len((r.text or "").encode()) for r in docs.collect())
    small = {"min_context": 3, "min_pair": 2, "cost": 0.2}
    whole = {r.doc_id: r.score for r in suffix_tree_lm.suffix_tree_scores(docs, **small).collect()}
    sizes = {}

    def measured(df, tag, **options):
        out = materialize(df, tag, **options)
        files = [os.path.join(d, f) for d, _, names in os.walk(out.written_at.removeprefix("file://")) for f in names if f.endswith(".parquet")]
        sizes[tag] = max(sizes.get(tag, 0), sum(map(os.path.getsize, files)) - 4096 * len(files))
        return out

    materialize = suffix_tree_lm.materialize
    monkeypatch.setattr(suffix_tree_lm, "materialize", measured)
    for name, value in {"SHARES": 6, "PLACE_BITS": 6, "CLASSES": 3, "CLASS": 1 << 9, "HEAD": 1 << 10, "ROUNDS": 3}.items():
        monkeypatch.setattr(suffix_tree_lm, name, value, raising=False)
    got = {r.doc_id: r.score for r in suffix_tree_lm.suffix_tree_scores(docs, **small, head_tokens=50, head=8).collect()}
    assert got == {i: pytest.approx(score) for i, score in whole.items()}
    assert max(sizes.values()) < texts, (sizes, texts)


def test_released_shuffle_files_go(spark):
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = there()
    table = shared.materialize(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "released", release=True)
    assert not there() - before
    assert spark.conf.get(shared.RELEASE) == "false"
    assert {r.k: r["count"] for r in table.collect()} == {k: 1429 if k < 4 else 1428 for k in range(7)}
