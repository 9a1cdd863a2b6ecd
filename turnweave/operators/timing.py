"""Turn taking on timed words and segments.  Every operator is keyed by sample_id, so work spreads by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utterances(words: DataFrame, gap: float = 1.2, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Words joined into utterances; a new one where the next start is more than ``gap`` after this end."""
    order = Window.partitionBy(*keys).orderBy("start", "idx")
    new = F.coalesce((F.col("start") - F.lag("end").over(order) > gap).cast("long"), F.lit(1))
    numbered = words.withColumn("brk", new).withColumn("utt", F.sum("brk").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "idx", "word"))), lambda w: w["word"]), " ")
    return numbered.groupBy(*keys, "utt").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"), text.alias("text"))


def dialogue(words: DataFrame, max_time: float = 120.0, gap: float = 1.2) -> DataFrame:
    """Both channels' utterances up to ``max_time`` in order of start, channel."""
    found = utterances(words.where(F.col("end") <= max_time), gap, ("sample_id", "channel"))
    order = Window.partitionBy("sample_id").orderBy("start", "channel", "utt")
    return found.withColumn("pos", F.row_number().over(order)).drop("utt")


def merge_segments(segments: DataFrame, gap: Column | float) -> DataFrame:
    """Segments of a channel whose gap to all before is at most ``gap`` are one."""
    order = Window.partitionBy("sample_id", "channel").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - reach > gap).cast("long"), F.lit(1))
    run = segments.withColumn("brk", new).withColumn("run", F.sum("brk").over(order))
    return run.groupBy("sample_id", "channel", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def pad_segments(segments: DataFrame, pad: float) -> DataFrame:
    """Ends later by ``pad``; starts earlier, but not before the last padded end."""
    order = Window.partitionBy("sample_id", "channel").orderBy("start", "end")
    start = F.greatest(F.lag("end").over(order) + pad, F.col("start") - pad)
    return segments.withColumn("padded_start", F.coalesce(start, F.greatest(F.lit(0.0), F.col("start") - pad))).withColumn("padded_end", F.col("end") + pad)


def milliseconds(t: Column) -> Column:
    return F.round(t * 1000).cast("long")


def sides(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda who, s, e: segments.where(F.col("channel") == who).select("sample_id", F.col("start").alias(s), F.col("end").alias(e))
    return side("user", "us", "ue"), side("model", "ms", "me")


def binned_sides(segments: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """The user's and the model's segments that last, each under all its bins."""
    user, model = sides(segments)
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    return user.where("ue > us").withColumn("bin", bins("us", "ue")), model.where("me > ms").withColumn("bin", bins("ms", "me"))


def overlaps(segments: DataFrame, width: float = 30.0) -> DataFrame:
    """Stretches where user and model speak at once; for each end (ms) the shortest.

    An equi-join on (sample, bin of ``width`` seconds): each segment is listed under all its
    bins, and a pair counts in the first bin that both have.
    """
    user, model = binned_sides(segments, width)
    pairs = user.join(model, ["sample_id", "bin"])
    pairs = pairs.where((F.col("us") < F.col("me")) & (F.col("ms") < F.col("ue")) & (F.col("bin") == F.floor(F.greatest("us", "ms") / width)))
    found = pairs.select("sample_id", F.greatest("us", "ms").alias("start"), F.least("ue", "me").alias("end"))
    order = Window.partitionBy("sample_id", milliseconds(F.col("end"))).orderBy(F.desc("start"), "end")
    return found.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def response_gaps(segments: DataFrame) -> DataFrame:
    """From each user end to the next model start strictly later; for each model start (ms) the latest user end."""
    user, model = sides(segments)
    events = user.select("sample_id", F.col("ue").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("m"))
    events = events.unionByName(model.select("sample_id", F.col("ms").alias("t"), F.lit(0).alias("kind"), F.col("ms").alias("m")))
    later = Window.partitionBy("sample_id").orderBy("t", "kind").rowsBetween(1, Window.unboundedFollowing)
    pairs = events.withColumn("next", F.first("m", ignorenulls=True).over(later)).where("kind = 1 and next is not null")
    return pairs.groupBy("sample_id", milliseconds(F.col("next")).alias("start_ms")).agg(F.max("t").alias("user_end"), F.max_by("next", "t").alias("model_start"))


def has_overlap(segments: DataFrame, width: float = 30.0) -> DataFrame:
    """Per sample, whether user and model ever overlap."""
    user, model = binned_sides(segments, width)
    u, m = user.alias("u"), model.alias("m")
    meet = (F.col("u.sample_id") == F.col("m.sample_id")) & (F.col("u.bin") == F.col("m.bin")) & (F.col("us") < F.col("me")) & (F.col("ms") < F.col("ue"))
    found = u.join(m, meet, "left_semi").select("sample_id").distinct().withColumn("overlap", F.lit(True))
    return segments.select("sample_id").distinct().join(found, "sample_id", "left").select("sample_id", F.coalesce("overlap", F.lit(False)).alias("overlap"))


def words_in_segments(words: DataFrame, segments: DataFrame, width: float = 30.0) -> DataFrame:
    """Words that touch a segment: inside it, or over its right or left edge; words without start don't count."""
    w = words.where("start is not null").select("sample_id", "idx", F.col("start").alias("ws"), F.coalesce("end", "start").alias("we"), F.col("end").isNull().alias("open"))
    s = segments.select("sample_id", F.col("start").alias("ss"), F.col("end").alias("se"))
    w = w.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ws") / width), F.floor(F.greatest("ws", "we") / width))))
    s = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ss") / width), F.floor(F.greatest("ss", "se") / width))))
    ws, we, ss, se = map(F.col, ("ws", "we", "ss", "se"))
    touches = (ws >= ss) & (we <= se) | (ws <= se) & (we > se) | (ws <= ss) & (we > ss)
    pairs = w.join(s, ["sample_id", "bin"]).where(touches & (~F.col("open") | (ws >= se)))
    return pairs.select("sample_id", "ss", "se", "idx").distinct()


def bin_overlap(events: DataFrame, width: float = 15.0, until: float = 120.0) -> DataFrame:
    """Each event under every bin that it overlaps, with the seconds; events that end at or before their start go."""
    inside = events.where((F.col("end") > F.col("start")) & (F.col("start") < until) & (F.col("end") > 0))
    n = int(until / width)
    bins = F.sequence(F.floor(F.greatest("start", F.lit(0.0)) / width), F.least(F.ceil(F.col("end") / width) - 1, F.lit(n - 1)))
    listed = inside.withColumn("bin", F.explode(bins))
    over = F.least(F.col("end"), (F.col("bin") + 1) * width) - F.greatest(F.col("start"), F.col("bin") * width)
    return listed.withColumn("overlap", over).where("overlap > 0")


def take_turn(words: DataFrame) -> DataFrame:
    """Whether the model took the turn: words spanning a second or more, or over three.  A null last end counts as its start."""
    by = words.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("start", "idx").alias("first"), F.max_by(F.coalesce("end", "start"), "idx").alias("last"))
    return by.select("sample_id", F.when(F.col("last") - F.col("first") < 1, (F.col("n") > 3).cast("int")).otherwise(1).alias("take_turn"), F.col("first").alias("first_start"))


def turn_rate(words: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean over ``samples``; those without words are 0."""
    joined = samples.select("sample_id").distinct().join(take_turn(words), "sample_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("samples"), F.avg(F.coalesce("take_turn", F.lit(0))).alias("turn_rate"))


def latency(words: DataFrame, turn_ends: DataFrame) -> DataFrame:
    """First word after the user's end, at least 0, for samples whose turn was taken."""
    return take_turn(words).where("take_turn = 1").join(turn_ends, "sample_id").select("sample_id", F.greatest(F.col("first_start") - F.col("user_end"), F.lit(0.0)).alias("latency"))


def backchannels(segments: DataFrame, words: DataFrame, longest: float = 3.0) -> DataFrame:
    """Per sample, segments of at most ``longest`` seconds before the first longer one, and the turn flag of the last one looked at."""
    order = Window.partitionBy("sample_id").orderBy("start", "end")
    length = F.col("end") - F.col("start")
    looked = segments.select("sample_id", "start", "end").withColumn("long", (length > longest).cast("int"))
    looked = looked.withColumn("before", F.coalesce(F.sum("long").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before = 0")
    inside = words_in_segments(words, looked.where("long = 0")).groupBy("sample_id", "ss", "se").agg(F.count(F.lit(1)).alias("n"))
    seen = looked.join(inside.select("sample_id", F.col("ss").alias("start"), F.col("se").alias("end"), "n"), ["sample_id", "start", "end"], "left")
    n = F.coalesce("n", F.lit(0))
    flag = F.when(F.col("long") == 1, 1).when(n > 3, 1).when((length < 1) & (n <= 2), 0).otherwise(1)
    return seen.groupBy("sample_id").agg(F.sum(1 - F.col("long")).alias("n_backchannels"), F.max_by(flag, F.struct("start", "end")).alias("turn_flag"))


def backchannel_summary(found: DataFrame, distances: DataFrame, totals: DataFrame) -> DataFrame:
    """Mean and population deviation of turn flag, backchannels a second and timing distance over the samples of totals (sample_id, duration).

    found: ``backchannels``; distances: ``timing_divergence``.  A sample without segments has flag 0, frequency 0 and distance 1.
    """
    every = totals.join(found, "sample_id", "left").join(distances, "sample_id", "left")
    value = {"turn_flag": F.coalesce("turn_flag", F.lit(0)), "frequency": F.coalesce("n_backchannels", F.lit(0)) / F.col("duration"), "distance": F.coalesce("distance", F.lit(1.0))}
    rows = every.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in value.items()))).alias("m")).select("m.*")
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))


def timing_divergence(segments: DataFrame, curve: DataFrame, totals: DataFrame, width: float = 0.2) -> DataFrame:
    """Jensen-Shannon distance of a sample's histogram of segment time to its reference curve; 1 without segments.

    curve: sample_id, pos, p.  totals: sample_id, duration.  The curve is stretched to the number
    of bins by linear interpolation; both sides are normalised.
    """
    bins = totals.select("sample_id", (F.floor(F.col("duration") / width).cast("int") + 1).alias("n"))
    frame = bins.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    hit = segments.select("sample_id", F.explode(F.sequence(F.floor(F.col("start") / width).cast("int"), F.floor(F.col("end") / width).cast("int"))).alias("bin")).groupBy("sample_id", "bin").agg(F.count(F.lit(1)).alias("c"))
    size = curve.groupBy("sample_id").agg(F.max("pos").alias("last"))
    at = F.when(F.col("n") > 1, F.col("bin") * F.col("last") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    placed = frame.join(hit, ["sample_id", "bin"], "left").join(size, "sample_id").withColumn("at", at).withColumn("lo", F.floor("at").cast("int")).withColumn("hi", F.least(F.col("lo") + 1, F.col("last")))
    side = lambda k: curve.select("sample_id", F.col("pos").alias(k), F.col("p").alias(f"p_{k}"))
    both = placed.join(side("lo"), ["sample_id", "lo"]).join(side("hi"), ["sample_id", "hi"])
    both = both.select("sample_id", (F.coalesce("c", F.lit(0)) + 1e-10).alias("p"), (F.col("p_lo") + (F.col("p_hi") - F.col("p_lo")) * (F.col("at") - F.col("lo"))).alias("q"), F.col("c"))
    whole = both.groupBy("sample_id").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum("c").alias("hits"))
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    far = both.drop("c").join(whole, "sample_id").groupBy("sample_id").agg(F.sqrt(F.greatest(F.sum(part(p) + part(q)) / 2, F.lit(0.0))).alias("d"), F.max("hits").alias("hits"))
    return far.select("sample_id", F.when(F.col("hits").isNull(), 1.0).otherwise(F.col("d")).alias("distance"))


def word_lines(words: DataFrame) -> DataFrame:
    """Per sample, its words in order, a line each: "[start, end]: word"."""
    line = F.format_string("[%.2f, %.2f]: %s", "start", "end", "word")
    return words.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda w: w["line"]), "\n").alias("lines"))


def split_metrics(words: DataFrame, marks: DataFrame) -> DataFrame:
    """Span, count and words a minute before and after a word-aligned split near the mark.

    The split is the first word start after the mark or of the word that holds it, else the last end, else the mark.
    """
    j = marks.select("sample_id", "mark").join(words, "sample_id", "left")
    s, e, m = F.col("start"), F.coalesce("end", "start"), F.col("mark")
    splits = j.groupBy("sample_id", "mark").agg(F.coalesce(F.min(F.when((s > m) | (s <= m) & (m < e), s)), F.max_by(e, "idx"), F.first("mark")).alias("split_t"))
    k = splits.join(words, "sample_id", "left").withColumn("pre", e <= F.col("split_t"))
    stats = []
    for name, side in (("pre", F.col("pre")), ("post", ~F.col("pre"))):
        stats += [F.count(F.when(side, 1)).alias(f"{name}_n"), (F.max(F.when(side, e)) - F.min(F.when(side, s))).alias(f"{name}_span")]
    out = k.groupBy("sample_id", "split_t").agg(*stats)
    for name in ("pre", "post"):
        span = F.coalesce(f"{name}_span", F.lit(0.0))
        out = out.withColumn(f"{name}_span", span).withColumn(f"{name}_wpm", F.when(span > 0, F.col(f"{name}_n") * 60 / span).otherwise(0.0))
    return out
