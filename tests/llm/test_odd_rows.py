"""Null ids and texts, repeated rows, two texts under one id, clashing columns and empty tables, for every operator."""

from collections import Counter

import numpy as np
import pytest

from turnweave.llm import bpe, contamination, line_dedup, near_dedup, quality_fm, quality_rules, records, repeats, suffix_tree_lm, toxicity
from turnweave.llm.queries import tokenizer_file

CLASHING = ["row", "key", "pos", "h1", "class", "band", "token", "score", "label", "kept", "spans", "lost_id", "text_hash", "at", "n"]
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def texts():
    some = [(i, f"the {i % 7} words of text number {i} and some that all share\nline {i % 3}") for i in range(40)]
    return [*some, (None, "a text without an id"), (None, "a text without an id"), (None, None), (3, some[3][1]), (3, some[3][1]), (5, "another text of five"), (50, None), (51, ""), (51, ""), (52, " \t\n ")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 0, *("x" for _ in CLASHING)) for i, t in texts()], SCHEMA).repartition(3).cache()
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0), "x") for i in range(30)] + [(None, 1, 1, "x"), (1, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    return docs, labels, spark.createDataFrame([(0, "words of text number 12 and some that all share"), (0, None), (None, "never here"), (1, "")], "item_id long, text string")


OPERATORS = {
    "lines": lambda d, l, b: line_dedup.line_dedup(d).select("doc_id", "n_lines", "n_dropped", "kept_text"),
    "toxicity": lambda d, l, b: toxicity.toxicity_scores(d, l).select("doc_id", "held_out", "score", "predicted"),
    "near": lambda d, l, b: near_dedup.near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept"),
    "lm": lambda d, l, b: suffix_tree_lm.suffix_tree_scores(d),
    "quality": lambda d, l, b: quality_fm.quality_scores(d, l),
    "repeats": lambda d, l, b: repeats.drop_repeats(d, 20),
    "records": lambda d, l, b: records.token_records(d, tokenizer_file("word_bpe_49k.json")).drop("start"),
    "bpe": lambda d, l, b: bpe.bpe_round_trip(d, tokenizer_file("byte_bpe_50k.json")),
    "rules": lambda d, l, b: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_row_for_each_row(tables, name):
    docs, labels, items = tables
    found = OPERATORS[name](docs, labels, items)
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts())
    shown = Counter(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in rows)
    # rows that repeat each other in full have equal results
    assert sorted(shown.values())[-3:] >= [2, 2, 3] or name == "records"
    none = OPERATORS[name](docs.limit(0), labels, items)
    assert none.columns == found.columns and none.count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels(tables, name):
    docs, labels, items = tables
    rows = OPERATORS[name](docs, labels.where("doc_id % 2 = 0 and quality = 0 and toxic = 0"), items).collect()
    assert {r.score for r in rows} == {0.0 if name == "toxicity" else 0.5}


def test_contamination_of_odd_rows(tables):
    docs, labels, items = tables
    assert contamination.find_contamination(docs, items).select("doc_id", "item_id").collect() == [(12, 0)]
    assert contamination.drop_contaminated(docs, items).count() == len(texts()) - 1
    assert contamination.find_contamination(docs.limit(0), items).count() == 0 == contamination.find_contamination(docs, items.limit(0)).count()


def test_pairs_of_features():
    """The machine's margin is the bias, the linear part and the sum over all pairs of features."""
    random = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, random.normal(size=quality_fm.WIDTH), random.normal(size=(quality_fm.WIDTH, 5)))
    lengths = [1, 2, 9, 30]
    index, value = random.integers(0, quality_fm.WIDTH, sum(lengths)), random.normal(size=sum(lengths))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        i, v = index[a:b], value[a:b]
        pairs = sum(m.factors[i[p]] @ m.factors[i[q]] * v[p] * v[q] for p in range(len(i)) for q in range(p))
        assert m.parts(index, value, starts)[0][k] == pytest.approx(0.3 + m.linear[i] @ v + pairs)
