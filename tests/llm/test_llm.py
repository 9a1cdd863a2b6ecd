"""The operators of the subpackage against brute force, on a small table with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from turnweave.llm import bpe, contamination, line_dedup, near_dedup, quality_rules, records, repeats, suffix_tree_lm, toxicity
from turnweave.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, key string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("an", "the", "Ém", "to", "ing") for b in ("", "or", "ß", "x1", ",")]
    some = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 120))) for _ in range(60)]
    out = {i: t.replace(" to ", "\n", 2) for i, t in enumerate(some)}
    for i in range(60, 75):
        out[i] = out[i - 60] + draw.choice(["", " tail", "\n \tCommon LINE"])
    for i in range(75, 90):
        out[i] = f"own{i} words\nCommon line  \n{'-' * i}\n\nlast"
    out |= {90: None, 91: "", 92: "  \n\t ", 93: "one", 94: "ab " * 4000, 95: "日本語\x0b<|endoftext|> a  b   c\r\n", 96: out[3], 97: "x" * 450}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, 0, "p", "k", "r") for i, t in texts.items()], SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def test_lines(spark, docs, texts):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(A_Z)
    seen = Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")})
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    twice = docs.union(docs)
    assert line_dedup.line_dedup(twice).select("doc_id", "kept_text").distinct().count() == len(texts)


def test_near_duplicates(spark, docs, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == {i: (len(sets[i]), part[i], part[i] == i) for i in sets}
    assert near_dedup.near_duplicates(empty(spark), 2).count() == 0


def test_suffix_tree(spark, docs, texts):
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in suffix_tree_lm.suffix_tree_scores(docs).collect()}
    for i, t in tokens.items():
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert suffix_tree_lm.suffix_tree_scores(empty(spark)).count() == 0


def test_contamination(spark, docs, texts):
    items = spark.createDataFrame([(0, " ".join(words(texts[5])[:15]).replace("x", "X")), (1, "never seen words in any of these texts at all"), (2, None), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.find_contamination(docs, items).collect()}
    assert {d for d, _ in got} >= {5, 65} and {i for _, i in got} == {0}
    kept = {r.doc_id for r in contamination.drop_contaminated(docs, items).collect()}
    assert kept == set(texts) - {d for d, _ in got}
    assert contamination.find_contamination(empty(spark), items).count() == 0


@pytest.mark.parametrize("length", [20, 200])
@pytest.mark.parametrize("wide", [repeats.WIDE, 1])
def test_repeats(spark, docs, texts, length, wide):
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    got = {r.doc_id: r for r in repeats.drop_repeats(docs, length, wide).collect()}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])[: len(b)]).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()), i
    assert repeats.drop_repeats(empty(spark), length).count() == 0


def test_records(spark, docs, texts):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in records.token_records(docs, tokenizer_file("word_bpe_49k.json")).collect()}
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_damaged_record():
    good = records.frame(1, b"\1\0", False) + b"\n"
    assert [x[2].tolist() for x in records.unframe(memoryview(good))] == [[1]]
    with pytest.raises(ValueError, match="damaged"):
        list(records.unframe(memoryview(good[:-4] + b"\0\0\0\n")))


def test_bpe(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=True).collect()}
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False) and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    own = bpe.transducer(tokenizer_file("byte_bpe_50k.json"))
    long = b"abcabd" * 500
    assert list(own.stream([long[k : k + 7] for k in range(0, len(long), 7)])) == own.merge(long)
    parts = [b"", *(long[k:] for k in range(0, 2900, 97))]
    tokens, starts = own.stream_many(parts)
    assert [tokens[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == list(map(own.merge, parts))


def test_rules(spark, docs, texts):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in texts.items():
        w, lines = WORD.findall(t or ""), (t or "").split("\n")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert tuple(got[i])[1:7] == want, i
    assert quality_rules.quality_rules(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["op2_toxicity", "op6_quality_fm"])
def test_held_out(spark, name):
    from turnweave.llm.queries import QUERIES

    column, least = {"op2_toxicity": ("toxic", 0.8), "op6_quality_fm": ("quality", 0.9)}[name]
    folder = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r[column] for r in rows) / len(rows) >= least


def test_contamination_of_short_documents(spark):
    """A document with fewer words than an item is compared with it as a whole."""
    item = [f"w{k}" for k in range(59)]
    cut = {n: item[:n] for n in (59, 58, 57, 48, 47, 4)} | {100: item[2:], 101: [*item[:30], "other", *item[31:58]], 102: item[:20]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in cut.items()], "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(item)), (1, "a b c")], "item_id long, text string")
    grams = lambda t: Counter(zip(*(t[k:] for k in range(5)), strict=False))
    like = {i: sum((grams(t) & grams(item)).values()) / sum((grams(t) | grams(item)).values()) for i, t in cut.items()}
    got = {r.doc_id: (r.similarity, r.first_word, r.n_words) for r in contamination.find_contamination(docs, items).collect()}
    assert got == {i: (pytest.approx(j), 0, len(cut[i])) for i, j in like.items() if j >= 0.8}
    assert got.keys() == {59, 58, 57, 48, 100, 101}
    assert {r.doc_id for r in contamination.drop_contaminated(docs, items).collect()} == cut.keys() - got.keys()


def test_near_copies_between_components(spark):
    """Copies of one text that differ from it by 0 to 30 words, many of them not linked to it: no link is lost, few pairs are compared."""
    draw = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    texts = {}
    for i in range(260):
        w = list(base)
        for k in draw.sample(range(120), draw.choice([1, 2, 4, 8, 12, 16, 24, 30])):
            w[k] = draw.choice([f"own{i}k{k}", f"shared{k % 7}"])
        texts[i] = " ".join(w)
    texts |= {260 + k: texts[k].replace("b50", "other") for k in range(0, 40, 3)} | {300: None, 301: "", 302: " \n"}
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in texts.items()], "doc_id long, text string, lost_id int, lost_hash string").repartition(4)
    sets = {i: (w := words(t)) and set(zip(w, w[1:], strict=False)) for i, t in texts.items()}
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                part[high] = low
    found = near_dedup.near_duplicates(docs, 2)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: top(i) for i in sets}
    assert len(set(map(top, sets))) > 20
    left = near_dedup.keep_representatives(docs, 2)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in sets if top(i) == i}


def test_near_duplicates_of_odd_rows(spark):
    """Null doc_ids take no part, repeated rows share their fate, two texts under one doc_id are judged apart."""
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x y z"), (3, "a b c d"), (4, "x y z"), (5, None), (5, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == Counter({(None, 3, None, True): 2, (1, 3, 1, True): 2, (2, 3, 1, False): 1, (3, 2, 3, True): 1, (3, 3, 1, False): 1, (4, 2, 3, False): 1, (5, 0, 5, True): 2})


def test_word_encoder_against_the_library():
    """Odd texts: dotted capital I, combining marks, added tokens, Unicode spaces, stops and commas in any place."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library, own, draw = Tokenizer.from_file(path), records.WordEncoder(path), random.Random(3)
    parts = ["İ", "İ.", "e\u0301", "\u0301", ".", ",", "..", "ß.", "ÿ,", "Σ", "ΑΣ.", "ªº.", "ab", "Ab", "'s", "n't", "x'", "7", "½", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "\u00a0", "\u2003", "\u200b", "\x1c", "\x85", "日本", "🙂", "\ufeff", "ﬁ.", "Å", "A\u030a,", " ", " ", "  ", "\t", "\n", "\r\n", "\x0b"]
    texts = ["İ.", "İ,", "", " ", "a. b, c.d e,.", *("".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(6000))]
    assert own.by_word
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        ids, starts = own.encode(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_shuffled_reads(spark, docs, texts, tmp_path):
    """Records fetched by their offsets, in any order, and odd rows."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    out = f"file://{tmp_path}/records"
    index = records.write_token_records(docs, tokenizer_file("word_bpe_49k.json"), out, file_bytes=4096)
    assert index.select("file").distinct().count() > 3
    wanted = index.where("doc_id % 7 = 3").select("file", "offset").orderBy("offset", ascending=False)
    got = {r.doc_id: r.ids for r in records.read_at(spark, out, wanted).collect()}
    assert got == {i: [*t.encode(texts[i] or "", add_special_tokens=False).ids, 1] for i in texts if i % 7 == 3}
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, None), (5, "c"), (5, "c")], "doc_id long, text string")
    rows = sorted((r.start, r.doc_id or -1, r.n_tokens) for r in records.token_records(odd, tokenizer_file("word_bpe_49k.json")).collect())
    assert [(a, d) for a, d, _ in rows] == list(zip(np.cumsum([0, *(n for _, _, n in rows[:-1])]).tolist(), [-1, -1, 5, 5, 5], strict=True))
    assert sorted(n for _, _, n in rows) == [1, 2, 2, 3, 3]
    assert records.token_records(empty(spark), tokenizer_file("word_bpe_49k.json")).count() == 0


def brute_tree(tokens, min_context, min_pair, prior, cost):
    """chance(past, symbol) by the definition, from lists of training tokens (None: end), and the nodes; past is a tuple from START ('^') on."""
    runs = Counter(tuple(["^", *t][a:b]) for t in tokens for b in range(1, len(t) + 2) for a in range(b))
    n, v = sum(map(len, tokens)), len({w for t in tokens for w in t})
    price, nodes = cost * math.log(max(n, 2)), {}

    def chance(context, symbol):
        if not context:
            return (runs[(symbol,)] + 1) / (n + v + 1)
        if context not in nodes:
            return chance(context[1:], symbol)
        kept, weight = nodes[context]
        return kept[symbol] if symbol in kept else weight * chance(context[1:], symbol)

    def counted(r):
        stays = lambda x: x[:-1] in nodes and x[-1] in nodes[x[:-1]][0]
        return len(r) == 1 or (runs[r] >= min_pair and (len(r) == 2 or counted(r[:-1]) and stays(r[1:])))

    follow = {}
    for r, c in runs.items():
        if len(r) > 1 and c >= min_pair:
            follow.setdefault(r[:-1], {})[r[-1]] = c
    for k in range(1, max(map(len, tokens)) + 1):
        found = {}
        for context in (x for x in follow if len(x) == k and runs[x] >= min_context and counted(x)):
            whole, kept, won, seen, share = runs[context], {}, 0, 0, 0
            for s, c in follow[context].items():
                if not counted((*context, s)):
                    continue
                q = chance(context[1:], s)
                p = (c + prior * q) / (whole + prior)
                if c * math.log(p / q) > price:
                    kept[s], won, seen, share = p, won + c * math.log(p / q), seen + c, share + q
            if kept:
                weight = max(1 - sum(kept.values()), 1e-12) / max(1 - share, 1e-12)
                if won + (whole - seen) * math.log(weight) > price * (1 + len(kept)):
                    found[context] = kept, weight
        if not found:
            break
        nodes |= found
    return chance, nodes


@pytest.mark.parametrize("head", [8, suffix_tree_lm.HEAD])
def test_suffix_tree_against_brute_force(spark, head):
    draw = random.Random(2)
    phrase = "the licence of this text is given to all who read it with care".split()
    texts = {}
    for i in range(100):
        t = [draw.choice("a b c d e f g".split()) for _ in range(draw.randint(0, 30))]
        k, m = draw.randint(1, 2), draw.randint(1, 2)  # what comes fourth depends on the first two
        texts[i] = " ".join(t[:9] + phrase[draw.randint(0, 3) : draw.randint(5, 13)] + [f"k{k}", f"m{m}", "n", f"o{k}{m}"] + t[9:] + phrase[: draw.randint(0, 9)])
    texts |= {100: None, 101: "", 102: texts[3], 103: "a b a b a b c d"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    chance, nodes = brute_tree([t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2], 3, 2, 4.0, 0.2)
    assert {1, 2, 3} <= set(map(len, nodes))
    symbols = {w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t} | {"never seen"}
    for context in [(), *nodes]:
        assert sum(chance(context, s) for s in symbols) == pytest.approx(1)

    def score(t):
        total, past = 0, ("^",)
        for s in t:
            longest = next((past[-k:] for k in range(len(past), 0, -1) if past[-k:] in nodes), ())
            total += math.log10(chance(longest, s))
            past = (*past, s)
        return total

    got = {r.doc_id: r.score for r in suffix_tree_lm.suffix_tree_scores(docs, min_context=3, min_pair=2, cost=0.2, head_tokens=5 if head == 8 else 1000, head=head).collect()}
    assert got == {i: pytest.approx(score(t)) for i, t in tokens.items()}


def test_suffix_tree_on_held_out_rows(spark):
    rows = suffix_tree_lm.suffix_tree_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)


def test_toxicity_against_brute_force(spark):
    """Weights, cosines over whole texts, nearest examples (ties by place in the index) and their votes, by the definition."""
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = {}
    for i in range(400):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(1, 40))]
        if i % 5 == 0:
            w.insert(draw.randint(0, len(w)), draw.choice(["Awful,", "nasty.", '"vile"']))
        texts[i] = " ".join(w)
    texts |= {400: None, 401: "", 402: "...", 403: texts[7], 404: "never seen"}
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in texts.items()], "doc_id long, text string, label string, score double").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    index = toxicity.build_index(docs, labels, 4, 2, 1000, 16, 5)
    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    bags = {i: Counter(filter(None, (w.strip(strip) for w in words(t)))) for i, t in texts.items()}
    examples = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    df, seen, toxic = Counter(w for b in bags.values() for w in b), Counter(w for i in examples for w in bags[i]), Counter(w for i in examples if i % 5 == 0 for w in bags[i])
    n, n1 = len(examples), sum(i % 5 == 0 for i in examples)
    x = lambda k, m: k * math.log(k / m) if k else 0

    def weight(w):
        a, b = toxic[w], seen[w] - toxic[w]
        ratio = x(a, n1 * seen[w] / n) + x(n1 - a, n1 * (n - seen[w]) / n) + x(b, (n - n1) * seen[w] / n) + x(n - n1 - b, (n - n1) * (n - seen[w]) / n)
        return (math.log((len(texts) + 1) / (df[w] + 1)) + 1) * max(ratio, 0)

    scale = {w: weight(w) if seen[w] else 0 for w in df}
    vectors = {i: {w: (1 + math.log(c)) * scale[w] for w, c in b.items()} for i, b in bags.items()}
    norm = {i: math.sqrt(sum(v * v for v in vec.values())) for i, vec in vectors.items()}
    assert sorted(index.ids.tolist()) == examples
    place = {i: k for k, i in enumerate(index.ids.tolist())}
    for r in toxicity.toxicity_scores(docs, labels, per_class=1000, block=16, nearest=5).collect():
        mine = vectors[r.doc_id]
        cosines = {e: sum(v * vectors[e].get(w, 0) for w, v in mine.items()) / (norm[r.doc_id] * norm[e]) for e in examples if norm[e] and norm[r.doc_id]}
        want = sorted(((-round(c, 9), place[e], c) for e, c in cosines.items() if c > 0))[:5]
        assert r.similarity == pytest.approx([c for _, _, c in want], abs=1e-9)
        pull = [c * c * index.weights[k] for _, k, c in want]
        raw = (sum(p * index.labels[k] for p, (_, k, _) in zip(pull, want, strict=True)) + 0.05 * index.prior) / (sum(pull) + 0.05)
        assert r.score == pytest.approx(float(index.calibrated(np.array([raw]))[0]), abs=1e-6)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_votes_by_expectation_maximisation():
    """Planted accuracies: the posterior finds the hidden class, and better than counting votes."""
    draw, right, votes = random.Random(4), [0.95, 0.9, 0.6, 0.55, 0.55], []
    for _ in range(6000):
        good = draw.random() < 0.7
        cast = "".join("-" if draw.random() < 0.15 else ("g" if good == (draw.random() < r) else "b") for r in right)
        votes.append((cast, good))
    posterior = quality_rules.fit_votes(sorted(Counter(v for v, _ in votes).items()))
    found = sum((posterior[v] >= 0.5) == good for v, good in votes) / len(votes)
    counted = sum((v.count("g") >= v.count("b")) == good for v, good in votes) / len(votes)
    assert found > 0.9 and found > counted + 0.05
    assert quality_rules.fit_votes([]) == {}


def test_posterior_decides(spark):
    """Of documents that pass the base rules, those with signs at every word are dropped by their posterior alone."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    text = lambda end: "\n".join(" ".join(word() + end for _ in range(12)) + "." for _ in range(8))
    docs = spark.createDataFrame([(i, text("%%%" if i % 10 == 0 else "")) for i in range(200)] + [(None, None), (1000, "")], "doc_id long, text string")
    rows = quality_rules.quality_rules(docs).where("doc_id < 1000").collect()
    assert not any(r.base_failed for r in rows)
    assert {r.doc_id for r in rows if not r.kept} == set(range(0, 200, 10))


def test_quality_rules_on_labels(spark):
    """Held against labels that the method never sees: most low-quality documents that pass the base rules go, good ones stay."""
    folder = "/root/testdata/sf0.01"
    rows = quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    bad, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.98 * len(good)


def test_contamination_against_brute_force(spark):
    """All windows of all items' lengths by brute force: nothing at similarity 0.8 or more is lost; the index leaves most items out."""
    draw = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    items = {i: [draw.choice(vocabulary) for _ in range(draw.randint(6, 40))] for i in range(40)}
    items |= {40: items[3], 41: ["one", "two"], 42: ["to", "be", "or", "not"] * 5}
    texts = {}
    for i in range(150):
        w = list(items[draw.randint(0, 42)])
        for _ in range(draw.randint(0, 4)):
            k = draw.randrange(len(w))
            w[k : k + 1] = draw.choice([[], ["other"], [w[k], "more"]]) or ["x"]
        texts[i] = [draw.choice(vocabulary) for _ in range(draw.randint(0, 30))] + w + [draw.choice(vocabulary) for _ in range(draw.randint(0, 30))]
    grams = lambda t: Counter(zip(*(t[k:] for k in range(min(5, len(t)))), strict=False))
    want = {}
    for d, t in texts.items():
        for i, item in items.items():
            b, n = grams(item), min(len(item), len(t))
            for at in range(len(t) - n + 1):
                if len(item) < 5 and len(t) < len(item):
                    continue
                a = grams(t[at : at + n])
                j = sum((a & b).values()) / sum((a | b).values())
                if j >= 0.8 and j > want.get((d, i), (0, 0))[0] + 1e-12:
                    want[d, i] = j, at
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()] + [(None, None), (900, "")], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in contamination.find_contamination(docs, table).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    random_prints = np.random.default_rng(0).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    index = contamination.MultiIndex(random_prints, 20)
    assert np.mean([len(index.in_reach(p ^ np.uint64(0x123456789ABCDEF))) for p in random_prints]) < 0.4 * 500
    for p in random_prints[:50]:
        flipped = p
        for bit in draw.sample(range(64), 20):
            flipped ^= np.uint64(1 << bit)
        assert np.array_equal(index.near(flipped), np.flatnonzero(np.bitwise_count(random_prints ^ flipped) <= 20))
    assert contamination.find_contamination(docs, table.limit(0)).count() == 0
    assert contamination.drop_contaminated(docs, table).where("doc_id is null or doc_id = 900").count() == 2
