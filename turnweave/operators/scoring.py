"""Judged benchmarks: score tables, reply parsing, text checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from turnweave.functions.edits import distances
from turnweave.functions.text import bad_transcription, content_words, drop_short_directions
from turnweave.operators.timing import bin_overlap


def accuracy(records: DataFrame) -> DataFrame:
    """A2: share of correct among decided records, per category and OVERALL (category null)."""
    rolled = records.where("correct is not null").rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.grouping("category").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("category")).alias("category"), "n", "accuracy")


def score_summary(events: DataFrame, task_scores: DataFrame) -> DataFrame:
    """A3: per setup and task, mean turn and follow score of the events that have both, mean of the files' task scores; three digits, null if none."""
    key = ["setup", "task_id"]
    both = F.col("tt").isNotNull() & F.col("follow").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(both, F.col(c))), 3)
    e = events.groupBy(*key).agg(F.count_if(both).alias("n_events"), mean("tt").alias("turn_score"), mean("follow").alias("follow_score"))
    t = task_scores.groupBy(*key).agg(F.count("score").alias("n_files"), F.round(F.avg("score"), 3).alias("task_score"))
    return e.join(t, key, "full").select(*key, F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_events", F.lit(0)).alias("n_events"), "turn_score", "follow_score", "task_score")


def task_scores(scores: DataFrame) -> DataFrame:
    """A4: mean task score per split, null if none, and how many."""
    return scores.groupBy("split").agg(F.avg("score").alias("score"), F.count("score").alias("n"), F.count(F.lit(1)).alias("tasks"))


def per_task(scores: DataFrame) -> DataFrame:
    """A4: the score of each split/task that has one."""
    return scores.where("score is not null").select(F.concat_ws("/", "split", "task_id").alias("task"), F.col("score").cast("double").alias("score"))


#: The cells of the benchmark's table, in order: task, measure.
BENCHMARK_CELLS = (
    ("pause_synthetic", "turn_rate"), ("pause_candor", "turn_rate"), ("backchannel", "turn_rate"), ("backchannel", "frequency"), ("backchannel", "distance"),
    ("smooth", "turn_rate"), ("smooth", "latency"), ("interruption", "turn_rate"), ("interruption", "rating"), ("interruption", "latency"),
)


def benchmark_table(values: DataFrame) -> DataFrame:
    """A row for each model, its ten cells as columns; null where there is no value.  values: model, task, measure, value."""
    cell = lambda t, m: F.max(F.when((F.col("task") == t) & (F.col("measure") == m), F.col("value"))).alias(f"{t}_{m}")
    return values.groupBy("model").agg(*(cell(t, m) for t, m in BENCHMARK_CELLS))


def by_prefix(samples: DataFrame, prefixes: list[str], key: str = "sample_id") -> DataFrame:
    """Samples of the subsets that their ids name ("subset_rest"), with columns subset and key, the rest of the id (all of it if nothing is left).

    A sample is in every subset whose name and an underscore begin its id; others are dropped.
    """
    names = F.explode(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col(key), F.concat(p, F.lit("_")))))
    found = samples.select("*", names.alias("subset"))
    rest = F.substring(F.col(key), F.length("subset") + 2, F.length(key))
    return found.withColumn(key, F.when(rest == "", F.col(key)).otherwise(rest))


def score_by_bin(events: DataFrame, width: float = 15.0, until: float = 120.0) -> DataFrame:
    """A5, long form: duration-weighted means for each setup and bin."""
    b = bin_overlap(events, width, until)
    mean = lambda c: F.sum(F.col(c) * F.col("overlap")) / F.sum(F.when(F.col(c).isNotNull(), F.col("overlap")))
    return b.groupBy("setup", "bin").agg(mean("tt").alias("turn_score"), mean("follow").alias("follow_score"), F.sum("overlap").alias("seconds"))


def score_table(events: DataFrame, width: float = 15.0, until: float = 120.0) -> DataFrame:
    """A5, wide form: one column pair a bin."""
    return score_by_bin(events, width, until).groupBy("setup").pivot("bin", list(range(int(until / width)))).agg(F.first("turn_score").alias("tt"), F.first("follow_score").alias("follow"))


def leaderboard(records: DataFrame, scales: dict[str, float]) -> DataFrame:
    """A subset's score is the mean of its regions' means, times its scale (1 by default); OVERALL the mean of the subsets that have one.

    records: subset, region, evaluator, transcription, score array<string>.  Records without a
    transcription are dropped and counted, and those without a score where the evaluator is a
    judge (open, qa).  A record's score is the mean of the numbers in its list.
    """
    mean = F.aggregate(F.filter(F.transform("score", lambda x: x.try_cast("double")), lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))
    scale = reduce(lambda c, kv: F.when(F.col("subset") == kv[0], F.lit(float(kv[1]))).otherwise(c), scales.items(), F.lit(1.0))
    dropped = F.col("transcription").isNull() | (F.col("evaluator").isin("open", "qa") & (F.coalesce(F.size("score"), F.lit(0)) <= 0))
    regions = records.withColumn("v", F.when(~dropped, mean)).groupBy("subset", "region").agg(F.avg("v").alias("v"), F.count_if(dropped).alias("dropped"))
    by = regions.groupBy("subset").agg((F.avg("v") * F.first(scale)).alias("score"), F.sum("dropped").alias("dropped"))
    return by.unionByName(by.agg(F.lit("OVERALL").alias("subset"), F.avg("score").alias("score"), F.sum("dropped").alias("dropped")))


def clear_bad(records: DataFrame, force: bool = False) -> DataFrame:
    """Records (transcription, score) with a column pending; a bad transcription is pending, and if there is one it goes with its score; with ``force`` every record's go."""
    bad = F.lit(True) if force else bad_transcription(F.col("transcription"))
    stale = bad & (F.lit(True) if force else F.col("transcription").isNotNull())
    kept = {c: F.when(~stale, F.col(c)) for c in ("transcription", "score")}
    return records.withColumns(kept | {"pending": bad})


def keep_old_scores(current: DataFrame, old: DataFrame) -> DataFrame:
    """An old score stays only where its transcription is the current one.  Both: unique_id, transcription; old: score."""
    o = old.select("unique_id", F.col("transcription").alias("old_text"), F.col("score").alias("old_score"))
    return current.join(o, "unique_id", "left").withColumn("score", F.when(F.col("transcription").eqNullSafe(F.col("old_text")), F.col("old_score"))).drop("old_text", "old_score")


def merge_verdicts(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts back on their records, with correct: true, false, or null for ERROR and none."""
    v = verdicts.select("unique_id", "verdict")
    return records.join(v, "unique_id", "left").withColumn("correct", F.when(F.col("verdict") == "CORRECT", True).when(F.col("verdict") == "INCORRECT", False))


def lookup_or_report(rows: DataFrame, index: DataFrame, key: str, field: str) -> DataFrame:
    """Fill a missing field from an index, and say where nothing was found."""
    i = index.select(key, F.col(field).alias("found"))
    return rows.join(i, key, "left").withColumn(field, F.coalesce(field, "found")).withColumn("not_found", F.col(field).isNull()).drop("found")


def tag_ratios(tags: DataFrame) -> DataFrame:
    """A10: each tag's share of all tags, two digits.  tags: sample_id, behaviour array<string>."""
    n = tags.select(F.explode("behaviour").alias("tag")).groupBy("tag").count()
    return n.select("tag", "count", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 2).alias("ratio"))


def with_behaviour(samples: DataFrame, tags: DataFrame, wanted: str) -> DataFrame:
    """Samples whose tags hold ``wanted``."""
    return samples.join(tags.where(F.array_contains("behaviour", wanted)), "sample_id", "left_semi")


@F.arrow_udf(IntegerType())
def edits(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Word edit distance of two arrays, see ``distances``."""
    ends = np.cumsum([0, len(reference.flatten()), len(hypothesis.flatten())])
    codes = pa.concat_arrays([x.flatten().cast(pa.string()) for x in (reference, hypothesis)]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [(codes[ends[k] : ends[k + 1]], np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))])) for k, x in enumerate((reference, hypothesis))]
    null = pc.or_(reference.is_null(), hypothesis.is_null()).to_numpy(zero_copy_only=False)
    return pa.array(distances(*parts), pa.int32(), mask=null)


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Q1: word error rate: edits over reference words; 0 for an empty reference.

    The words are cut in generated code; the edit distance comes in Arrow batches, many pairs
    side by side.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    ref, hyp = words(drop_short_directions(reference)), words(F.lower(F.trim(hypothesis)))
    return F.when(F.size(ref) == 0, 0.0).otherwise(edits(ref, hyp) / F.size(ref))


TURNS = "turns array<struct<role string, text string>>"


def parse_transcripts(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Q2: turns of a reply: without code fences, from the first { to the last }; null unless two turns or more all have role and text."""
    bare = F.regexp_extract(F.regexp_replace(column, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    turns = F.from_json(bare, f"struct<{TURNS.replace(' array', ': array', 1).replace('role string', 'role: string').replace('text string', 'text: string')}>")["turns"]
    ok = (F.size(turns) >= 2) & F.forall(turns, lambda t: (F.length(t["role"]) > 0) & (F.length(t["text"]) > 0))
    return replies.withColumn("turns", F.when(ok, turns))


def last_rating(reply: Column, low: int = 0, high: int = 5) -> Column:
    """Q4: the last "rating: n" of a reply within bounds, or null."""
    found = F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(?i)(?:rating|score)\W{0,4}(\d+)"), 1), F.lit(-1)).try_cast("int")
    return F.when(found.between(low, high), found)


#: Phrases that correct, and that flag a contradiction.
CORRECTIVE = ["actually", "mix-up", "mixup", "i think you mean", "i said", "what i said", "to be precise", "small mix"]
SOFT_FLAGS = ["did i catch that wrong", "has something shifted", "did something change", "i thought you mentioned", "i had it in my head", "did i misunderstand", "to double-check", "you mentioned earlier", "you said earlier you"]


def memory_warnings(turns: DataFrame, memory_type: Column) -> DataFrame:
    """Q5: what is wrong with a conversation for its memory type; an empty array if nothing.  turns: conv_id, turn, role, text."""
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    texts = lambda role: F.transform(F.filter("ts", lambda t: t["role"] == role), lambda t: F.coalesce(t["text"], F.lit("")))
    r = lists.withColumn("memory_type", memory_type).withColumn("said", texts("assistant")).withColumn("asked", texts("user"))
    r = r.withColumn("last", F.coalesce(F.try_element_at("said", F.lit(-1)), F.lit("")))
    every = F.lower(F.array_join("said", " "))
    any_of = lambda text, phrases: reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))
    early = content_words(F.array_join(F.slice("asked", 1, F.greatest(F.size("asked") - 1, F.lit(0))), " "))
    planted = content_words(F.array_join(F.slice("asked", 1, 2), " "))
    echoed = content_words(F.col("last"), 4)
    proper = F.exists(F.split(F.array_join("said", " "), r"[.!?]\s+"), lambda s: F.substr(s, F.lit(2)).rlike(r"\b[A-Z][a-z]{2,}"))
    kind = F.col("memory_type")
    rules = [
        ((kind == "self_coherence") & ~any_of(every, CORRECTIVE), "self_coherence: no corrective phrase"),
        ((kind == "contradiction_detection") & ~any_of(F.lower("last"), SOFT_FLAGS), "contradiction_detection: no soft-flag phrase"),
        ((kind == "numerical_state_tracking") & ~every.rlike(r"\d"), "numerical_state_tracking: no digits"),
        ((kind == "progressive_synthesis") & (F.size(F.array_intersect(early, echoed)) < 3), "progressive_synthesis: fewer than 3 words echoed"),
        ((kind == "incidental_memory") & (F.size(planted) > 0) & (F.size(F.array_intersect(planted, echoed)) == 0), "incidental_memory: no early words"),
        ((kind == "reference_resolution") & ~proper & (F.size("said") >= 2), "reference_resolution: no proper noun"),
    ]
    found = F.filter(F.array(*(F.when(c, m) for c, m in rules)), lambda w: w.isNotNull())
    return r.select("conv_id", F.when(F.size("said") == 0, F.array(F.lit("no assistant turns"))).otherwise(found).alias("warnings"))


def turn_drift(turns: DataFrame, requested: DataFrame) -> DataFrame:
    """Q6: turns asked for and got.  requested: conv_id, n."""
    got = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("got"))
    return requested.join(got, "conv_id", "left").select("conv_id", F.col("n").alias("requested"), F.coalesce("got", F.lit(0)).alias("got"), (F.coalesce("got", F.lit(0)) - F.col("n")).alias("drift"))


def reduce_scores(records: DataFrame) -> DataFrame:
    """Q7: mean of a record's raw scores; scorable only with one or more."""
    values = F.filter(F.transform("score", lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))
    return records.withColumn("scorable", F.coalesce(F.size("score") > 0, F.lit(False))).withColumn("mean_score", mean)


def score_splits(records: DataFrame, evaluators: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each split's records through its evaluator (a DataFrame function that returns split, score); a split whose function fails to plan has a null score."""
    parts = []
    for name, fn in evaluators.items():
        own = records.where(F.col("split") == name)
        try:
            parts.append(fn(own).select("split", F.col("score").cast("double").alias("score")))
        except Exception:  # any failure of one evaluator leaves the others
            parts.append(records.sparkSession.createDataFrame([(name, None)], "split string, score double"))
    return reduce(DataFrame.unionByName, parts)
