"""The pipeline's stages on small tables."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from turnweave.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def own(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_one_whole_copy_is_left(spark):
    copied = "\n".join([own("a", 9), own("b", 12), own("c", 7)])
    texts = {i: copied for i in range(20, 30)} | {i: f"{own(f'x{i}', 30)}\nCommon line\n{own(f'y{i}', 5)}" for i in range(40, 52)}
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], SCHEMA).repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    left = stage["near_dedup"](spark, stage["line_dedup"](spark, docs, "").cache(), "").collect()
    # every line stays where it is first, the common line of the others too
    assert [r.doc_id for r in left if r.text == copied] == [20]
    got = {r.doc_id: r.text for r in left}
    assert {i: got[i] for i in range(40, 52)} == {i: t if i == 40 else t.replace("Common line\n", "") for i, t in texts.items() if i >= 40}
    assert all(r.n_chars == len(r.text) for r in left)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    """Rows (doc_id, text) and labels: toxic ones, frequent lines, copies, near copies, benchmark passages, null and repeated rows."""
    draw, item = random.Random(12), own("item", 30)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmnopqrst") + str(draw.randint(0, 9))
    texts = {i: "\n".join(" ".join(word() for _ in range(draw.randint(8, 25))) for _ in range(draw.randint(2, 6))) for i in range(160)}
    for i in range(0, 160, 4):
        texts[i] += f"\nyou {draw.choice(['awful', 'nasty', 'vile'])} {draw.choice(['awful', 'nasty', 'vile'])} thing"
    for i in range(1, 160, 10):
        texts[i] += "\n  Common line"
    copied = texts[3]
    texts |= {200 + k: copied for k in range(12)} | {220 + k: texts[7].replace(texts[7].split()[5 + k], "other", 1) + f" end{k}" for k in range(3)}
    texts |= {230: f"{texts[9]} {item}", 231: item.replace("item7", "changed"), 240: None, 241: "", 242: " \n "}
    rows = [*texts.items(), (5, texts[5]), (5, "another text of this id"), (None, "text without an id"), (None, None)]
    return rows, {i: int(i % 4 == 0) for i in range(160)}, {0: item, 1: "never seen at all in these texts here"}


def test_run_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept."""
    rows, labels, items = corpus()
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, before, left = f"file://{tmp_path}", Counter((i, t or "") for i, t in rows), spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    stages, names = dict(corpus_pipeline.STAGES), [n for n, _ in corpus_pipeline.STAGES]
    for k, name in enumerate(names[:-1]):
        stages[name](spark, left, folder).write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{folder}/{k}")
        assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        after = Counter((r.doc_id, r.text or "") for r in left.collect())
        assert after == BRUTE[name](before, items), name
        before = after
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {t: library.encode(t, add_special_tokens=False).ids for _, t in before}
    want = Counter({(i, len(ids[t]), hashlib.sha256(t.encode()).hexdigest()): n for (i, t), n in before.items()})
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == want


def without_toxic(rows, items):
    return Counter({(i, t): n for (i, t), n in rows.items() if not t.rstrip().endswith("thing")})


def without_lines(rows, items):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(A_Z)
    seen = {}
    for i, t in rows:
        for x in t.split("\n"):
            seen.setdefault(key(x), set()).add(i)
    stays, out = {}, Counter()
    for i, t in rows:
        for pos, x in enumerate(t.split("\n")):
            place = (i is not None, i or 0, t, pos)
            k = key(x)
            stays[k] = min(stays.get(k, place), place)
    for (i, t), n in rows.items():
        kept = [x for pos, x in enumerate(t.split("\n")) if not key(x) or len(seen[key(x)]) < 10 or stays[key(x)] == (i is not None, i or 0, t, pos)]
        out[i, "\n".join(kept)] += n
    return out


def without_copies(rows, items):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.translate(A_Z))
        sets[i, t] = set(zip(*(w[k:] for k in range(5)), strict=False)) or ({tuple(w)} if w else set())
    part = {r: r for r in rows if r[0] is not None and sets[r]}
    for _ in part:
        for a in part:
            for b in part:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    return Counter({r: n for r, n in rows.items() if r not in part or part[r][0] == r[0]})


def without_items(rows, items):
    grams = lambda w: Counter(zip(*(w[k:] for k in range(5)), strict=False))

    def holds(text):
        w = WORD.findall(text.translate(A_Z))
        for item in (WORD.findall(t.translate(A_Z)) for t in items.values()):
            n = min(len(item), len(w))
            for a in (grams(w[k : k + n]) for k in range(len(w) - n + 1)):
                if (a | grams(item)) and sum((a & grams(item)).values()) >= 0.8 * sum((a | grams(item)).values()):
                    return True
        return False

    return Counter({r: n for r, n in rows.items() if not holds(r[1])})


BRUTE = {"toxicity": without_toxic, "line_dedup": without_lines, "near_dedup": without_copies, "decontamination": without_items}


@pytest.mark.parametrize("name", list(BRUTE))
def test_stages_carry_other_columns(spark, tmp_path, name):
    """Extra columns whose names clash with the operators' own; an empty table."""
    rows, labels, items = corpus()
    spark.createDataFrame([(i, 1, x) for i, x in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = ["lost_id", "lost_hash", "text_hash", "row", "key", "pos", "kept", "class", "score", "label", "h1", "n_chars"]
    docs = spark.createDataFrame([(i, t, *("x" for _ in odd[:-1]), 7) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in odd[:-1]) + ", n_chars long")
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, f"file://{tmp_path}")
    assert found.columns == docs.columns and found.where("lost_id = 'x' and h1 = 'x'").count() == sum(BRUTE[name](Counter((i, t or "") for i, t in rows), items).values())
    assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
