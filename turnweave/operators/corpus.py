"""Building a corpus: caps, splits, merges, timelines, chunks and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.seeding import uniform
from turnweave.operators.stats import exact_quantiles

#: Parts of the unit interval in which running sums are taken apart; each then holds few rows.
PARTS = 4096


def cap_hours(manifest: DataFrame, hours: DataFrame, seed: int = 42) -> DataFrame:
    """Per source, rows in seeded order while their running duration is within the cap (hours: source, max_hours; null: no cap).

    Two passes, so no source has to fit one task: sums of parts of the seeded order, then a
    running sum inside each part.
    """
    keyed = manifest.withColumn("u", uniform(seed, "path")).withColumn("part", F.floor(F.col("u") * PARTS))
    sums = keyed.groupBy("source", "part").agg(F.sum("duration").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(before, F.lit(0.0)).alias("before"))
    inside = F.sum("duration").over(Window.partitionBy("source", "part").orderBy("u", "path").rowsBetween(Window.unboundedPreceding, 0))
    joined = keyed.withColumn("inside", inside).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    capped = joined.join(hours.select(F.col("source").alias("capped"), "max_hours"), F.col("source").eqNullSafe(F.col("capped")), "left")
    return capped.where(F.col("max_hours").isNull() | (F.col("before") + F.col("inside") <= F.col("max_hours") * 3600)).select(*manifest.columns)


def merge_datasets(manifests: list[DataFrame], hours: DataFrame, seed: int = 42) -> DataFrame:
    """All sources' capped manifests in one; missing columns are null."""
    return cap_hours(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), manifests), hours, seed)


def seeded_order(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """O1: rows in seeded order."""
    return df.orderBy(uniform(seed, *key), *key)


def seeded_sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """O2: the first n rows of the seeded order."""
    return seeded_order(df, seed, *key).limit(n)


def train_eval_split(manifest: DataFrame, seed: int = 42, most: int = 500, given: DataFrame | None = None) -> DataFrame:
    """Rows with a column split.  Rows of an eval manifest that is ``given`` are eval, and all others train.

    Without such rows, the first least(most, greatest(1, n div 2)) rows in seeded order are
    eval.  Paths are unique.
    """
    if given is not None and not given.isEmpty():
        return manifest.withColumn("split", F.lit("train")).unionByName(given.withColumn("split", F.lit("eval")))
    first = seeded_sample(manifest, most, seed, "path").select(F.col("path").alias("eval_path"))  # few rows, so one task numbers them
    place = F.row_number().over(Window.orderBy(uniform(seed, "eval_path"), "eval_path"))
    k = manifest.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2)).alias("k"))
    evals = first.withColumn("place", place).crossJoin(F.broadcast(k)).where("place <= k").select("eval_path")
    return manifest.join(evals, F.col("path") == F.col("eval_path"), "left").withColumn("split", F.when(F.col("eval_path").isNotNull(), "eval").otherwise("train")).drop("eval_path")


def dataset_stats(manifest: DataFrame, datasets: DataFrame) -> DataFrame:
    """A1: entries and hours per dataset and TOTAL; datasets without rows, disabled ones too, have 0."""
    sums = manifest.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("sec"))
    joined = datasets.select(F.col("source").alias("name")).join(sums, F.col("name") == F.col("source"), "left")
    rolled = joined.rollup("name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("entries"), F.sum(F.coalesce("sec", F.lit(0.0)) / 3600).alias("hours"), F.grouping("name").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("name")).alias("dataset"), "entries", "hours")


def threshold_report(rows: DataFrame, value: str, least: float, duration: str = "duration") -> DataFrame:
    """Kept and removed rows and hours for a threshold; a null value is removed."""
    kept = F.coalesce(F.col(value) >= least, F.lit(False))
    hours = lambda c: F.coalesce(F.sum(F.when(c, F.col(duration))), F.lit(0.0)) / 3600
    return rows.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"), hours(kept).alias("kept_hours"), hours(~kept).alias("removed_hours"))


def training_steps(datasets: DataFrame, batch: int, seconds: float, epochs: int) -> DataFrame:
    """Hours of enabled sets within their caps, steps an epoch and in all.  datasets: enabled, total_hours, max_hours."""
    hours = F.sum(F.least("total_hours", F.coalesce("max_hours", "total_hours")))
    out = datasets.where("enabled").agg(hours.alias("hours"))
    return out.withColumn("steps_per_epoch", F.ceil(F.col("hours") * 3600 / seconds / batch)).withColumn("total_steps", F.col("steps_per_epoch") * epochs)


def only_in(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The different values of ``key`` that the other table lacks."""
    return rows.select(key).subtract(others.select(key))


def sample_counts(rows: DataFrame, done: DataFrame, key: str, by: str) -> DataFrame:
    """Per group, how many samples there are, are done and are pending."""
    j = rows.join(done.select(key).distinct().withColumn("done", F.lit(1)), key, "left")
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count("done").alias("resumed"), F.count_if(F.col("done").isNull()).alias("pending"))


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def prompt_words(prompts: DataFrame) -> DataFrame:
    """The words of each prompt, evenly spaced on [0, prompt_end].  prompts: id, prompt, prompt_end."""
    words = F.filter(F.split("prompt", r"\s+"), lambda w: w != "")
    listed = prompts.select("id", "prompt_end", F.size(words).alias("n"), F.posexplode(words).alias("idx", "word"))
    step = F.col("prompt_end") / F.col("n")
    return listed.select("id", "idx", "word", (F.col("idx") * step).alias("start"), ((F.col("idx") + 1) * step).alias("end"))


def with_prompt(words: DataFrame, prompts: DataFrame, shift: bool, seed: int = 42, rephrased_share: float = 0.5) -> DataFrame:
    """Prompt words, then the recording's words (id, idx, word, start, end), later by the prompt's length if ``shift``.

    A share of the ids, by seed, uses the column ``rephrased`` if it isn't null.
    """
    chosen = F.when((uniform(seed, "id") < rephrased_share) & F.col("rephrased").isNotNull(), F.col("rephrased")).otherwise(F.col("prompt"))
    head = prompt_words(prompts.withColumn("prompt", chosen)).withColumn("part", F.lit(0))
    late = F.col("prompt_end") if shift else F.lit(0.0)
    tail = words.join(prompts.select("id", "prompt_end"), "id").select("id", "idx", "word", (F.col("start") + late).alias("start"), (F.col("end") + late).alias("end"), F.lit(1).alias("part"))
    order = Window.partitionBy("id").orderBy("start", "part", "idx")
    return head.unionByName(tail).withColumn("pos", F.row_number().over(order) - 1).drop("idx", "part")


def plan_timeline(
    turns: DataFrame, seed: int = 42, prompt_end: float = 5.7, same: tuple[float, float] = (0.2, 0.8),
    reply: tuple[float, float] = (0.1, 0.4), think: tuple[float, float] = (0.3, 1.2),
    barge_share: float = 0.0, barge: tuple[float, float] = (0.3, 1.0), silence_share: float = 0.0, silence: tuple[float, float] = (2.0, 5.0), longest: float | None = None,
) -> DataFrame:
    """Start and end of each turn (conv_id, turn, role, duration).

    The first turn begins at ``prompt_end``.  The gap before an assistant's turn after the user
    is drawn from ``reply``, before a user's turn after the assistant from ``think``, else from
    ``same``; a user turn after the assistant may instead begin before the assistant's end (not
    before prompt_end), or, where it doesn't, after a long silence.  Turns stop at
    ``longest``; a turn is cut there only if over a second of it fits.  One fold over each
    conversation's turns; a conversation is one row of few turns.
    """
    draw = lambda name, lo, hi: lo + (hi - lo) * uniform(seed, "conv_id", "turn", F.lit(name))
    kind = uniform(seed, "conv_id", "turn", F.lit("kind"))
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    asks, answers = (before == "assistant") & (F.col("role") == "user"), (before == "user") & (F.col("role") == "assistant")
    plain = F.when(answers, draw("gap", *reply)).when(asks, draw("gap", *think)).otherwise(draw("gap", *same))
    gap = F.when(before.isNull(), 0.0).when(asks & (kind < barge_share), -draw("barge", *barge))
    gap = gap.when(asks & (kind < barge_share + (1 - barge_share) * silence_share), draw("silence", *silence)).otherwise(plain)
    rows = turns.select("conv_id", F.struct("turn", "role", "duration", gap.alias("gap")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    limit = F.lit(float("inf") if longest is None else float(longest))
    state = F.struct(F.lit(float(prompt_end)).alias("at"), F.lit(False).alias("over"), F.expr("CAST(array() AS array<struct<turn:int,role:string,start:double,end:double>>)").alias("out"))

    def step(a: Column, t: Column) -> Column:
        start = F.greatest(a["at"] + t["gap"], F.lit(float(prompt_end)))
        end = F.least(start + t["duration"], limit)
        fits = ~a["over"] & ((start + t["duration"] <= limit) | (limit - start > 1.0))
        placed = F.struct(t["turn"].cast("int").alias("turn"), t["role"].alias("role"), start.alias("start"), end.alias("end"))
        return F.struct(F.when(fits, end).otherwise(a["at"]).alias("at"), (~fits | (end >= limit)).alias("over"), F.when(fits, F.concat(a["out"], F.array(placed))).otherwise(a["out"]).alias("out"))

    return rows.select("conv_id", F.explode(F.aggregate("ts", state, step)["out"]).alias("p")).select("conv_id", "p.*")


def split_conversations(timeline: DataFrame, prompts: DataFrame, longest: float = 163.84, shortest: float = 10.0, tail: float = 0.2) -> DataFrame:
    """Chunks that end after user turns, with times from the chunk's start.

    A chunk closes at a user turn that is the last, or makes 80 % of ``longest``, or after which
    the next user turn would exceed it, unless it is shorter than ``shortest``; then it goes on.
    What follows the last closed chunk is dropped.  prompts: conv_id, prompt_end, total.  The
    prompt stays with the first chunk; a conversation's only chunk keeps its id.
    """
    ts = F.array_sort(F.collect_list(F.struct("turn", "role", "start", "end")))
    rows = timeline.groupBy("conv_id").agg(ts.alias("ts")).join(prompts, "conv_id")
    users = F.filter("ts", lambda t: t["role"] == "user")
    state = F.struct(F.lit(0.0).alias("start"), F.lit(-1).alias("after"), F.lit(0).alias("i"), F.expr("CAST(array() AS array<struct<start:double,end:double,after:int,upto:int>>)").alias("out"))

    def step(a: Column, u: Column) -> Column:
        length = u["end"] - a["start"]
        following = F.get(F.col("users"), a["i"] + 1)["end"]
        closes = ((length >= longest * 0.8) | following.isNull() | (following - a["start"] > longest)) & (length >= shortest)
        end = F.least(u["end"] + tail, F.col("total"))
        chunk = F.struct(a["start"].alias("start"), end.alias("end"), a["after"].alias("after"), u["turn"].cast("int").alias("upto"))
        return F.struct(
            F.when(closes, end).otherwise(a["start"]).alias("start"), F.when(closes, u["turn"].cast("int")).otherwise(a["after"]).alias("after"),
            (a["i"] + 1).alias("i"), F.when(closes, F.concat(a["out"], F.array(chunk))).otherwise(a["out"]).alias("out"),
        )

    cut = rows.withColumn("users", users).withColumn("chunks", F.aggregate("users", state, step)["out"])
    listed = cut.select("conv_id", "ts", "prompt_end", F.size("chunks").alias("of"), F.posexplode("chunks").alias("chunk", "c"))
    own = F.filter("ts", lambda t: (t["turn"] > F.col("c.after")) & (t["turn"] <= F.col("c.upto")))
    moved = F.transform(own, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), (t["start"] - F.col("c.start")).alias("start"), (t["end"] - F.col("c.start")).alias("end")))
    kept = F.filter(moved, lambda t: (t["start"] >= 0) & (t["end"] > t["start"]))
    return listed.select("conv_id", "chunk", "of", (F.col("c.end") - F.col("c.start")).alias("duration"), F.when(F.col("chunk") == 0, F.col("prompt_end")).otherwise(0.0).alias("prompt_end"), kept.alias("turns"))


def turn_checks(turns: DataFrame, shortest: float = 0.3, silence: float = 0.5, errors: float = 0.3) -> DataFrame:
    """Per turn (duration, silence_ratio, wer), passed and the checks made.

    A too short turn has no further checks; missing audio (null duration) fails with a reason.
    """
    check = lambda v, ok: F.struct(v.cast("double").alias("value"), ok.alias("passed"))
    d, s, w = F.col("duration"), F.col("silence_ratio"), F.col("wer")
    first = F.create_map(F.lit("duration"), check(d, d >= shortest))
    every = F.create_map(F.lit("duration"), check(d, d >= shortest), F.lit("silence_ratio"), check(s, s <= silence), F.lit("wer"), check(w, w <= errors))
    passed = F.coalesce((d >= shortest) & (s <= silence) & (w <= errors), F.lit(False))
    return turns.withColumn("passed", passed).withColumn("reason", F.when(d.isNull(), "missing audio")).withColumn("checks", F.when(d.isNull(), None).when(d < shortest, first).otherwise(every))


def conversation_quality(checked: DataFrame) -> DataFrame:
    """A conversation passes if every turn does."""
    return checked.groupBy("conv_id").agg(F.bool_and("passed").alias("quality_passed"), F.count(F.lit(1)).alias("turns"))


def length_report(timeline: DataFrame, longest: float = 163.84) -> DataFrame:
    """Lengths of conversations, how many need a split, how they end, how many are good already."""
    by = timeline.groupBy("conv_id").agg(F.max("end").alias("length"), F.max_by("role", "turn").alias("last"))
    good = (F.col("length") <= longest) & (F.col("last") == "user")
    told = by.agg(
        F.count(F.lit(1)).alias("conversations"), F.avg("length").alias("mean"), F.max("length").alias("longest"), F.count_if(F.col("length") > longest).alias("need_split"),
        F.count_if(F.col("last") == "user").alias("end_user"), F.count_if(F.col("last") == "assistant").alias("end_assistant"), F.count_if(good).alias("good"),
    )
    return told.join(F.broadcast(exact_quantiles(by, [], "length", {"median": 0.5}).drop("n")), how="left")  # one row


def split_report(timeline: DataFrame, chunks: DataFrame) -> DataFrame:
    """After ``split_conversations``: conversations, those that gave a chunk, chunks, hours, and how many chunks end with the user or the assistant, in per cent too (of one at least)."""
    last = F.try_element_at("turns", F.lit(-1))["role"]
    share = lambda role: (F.count_if(last == role) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)))
    told = chunks.agg(
        F.count_distinct("conv_id").alias("split"), F.count(F.lit(1)).alias("chunks"), (F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600).alias("hours"),
        F.count_if(last == "user").alias("end_user"), share("user").alias("end_user_pct"), F.count_if(last == "assistant").alias("end_assistant"), share("assistant").alias("end_assistant_pct"),
    )
    return timeline.agg(F.count_distinct("conv_id").alias("conversations")).crossJoin(F.broadcast(told))  # one row each


def with_meta(audio: DataFrame, meta: DataFrame) -> DataFrame:
    """Audio files with the meta file of the same stem; either without the other is dropped.  Both have ``path``."""
    a = audio.withColumn("stem", F.regexp_replace("path", r"\.wav$", ""))
    m = meta.withColumnRenamed("path", "meta_path").withColumn("stem", F.regexp_replace("meta_path", r"_meta\.json$", ""))
    return a.join(m, "stem")


def loss_frames(chunks: DataFrame, per_second: float = 12.5) -> DataFrame:
    """One row a codec frame of each chunk (id, start, duration, prompt_end), with whether it counts in the loss."""
    first = F.floor(F.greatest(F.col("prompt_end") - F.col("start"), F.lit(0.0)) * per_second)
    n = F.floor(F.col("duration") * per_second).cast("long")
    return chunks.where(n > 0).select("id", first.alias("masked"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("frame")).select("id", "frame", (F.col("frame") >= F.col("masked")).alias("in_loss"))
