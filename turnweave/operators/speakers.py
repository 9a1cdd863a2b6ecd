"""Speaker pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_durations(clips: DataFrame, durations: DataFrame) -> DataFrame:
    """Clips with durations in seconds; over 1000 means milliseconds."""
    d = durations.select("path", F.when(F.col("duration") > 1000, F.col("duration") / 1000).otherwise(F.col("duration")).alias("duration"))
    return clips.join(d, "path", "left")


def with_splits(clips: DataFrame, splits: list[tuple[str, DataFrame]]) -> DataFrame:
    """The split of each clip; of several, the last in the list."""
    every = reduce(DataFrame.unionByName, (d.select("path", F.lit(k).alias("prio"), F.lit(name).alias("split")) for k, (name, d) in enumerate(splits)))
    return clips.join(every.groupBy("path").agg(F.max_by("split", "prio").alias("split")), "path", "left")


def only_present(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose key is there."""
    return rows.join(present, key, "left_semi")


def speaker_sides(sides: DataFrame) -> DataFrame:
    """Packed "call_channel/file;..." as rows call_id (five digits), channel."""
    one = sides.select("pin", F.explode(F.split("side_data", ";")).alias("s"))
    call, channel = F.regexp_extract("s", r"^(\d+)_([AB])", 1), F.regexp_extract("s", r"^(\d+)_([AB])", 2)
    return one.select("pin", F.lpad(call, 5, "0").alias("call_id"), channel.alias("channel")).where("channel <> ''")


def sides_with_segments(sides: DataFrame, segments: DataFrame) -> DataFrame:
    """Each speaker's segments."""
    return speaker_sides(sides).join(segments, ["call_id", "channel"])


def rank_rule(rule: str, target: float, tolerance: float) -> list[Column]:
    """What comes first under each rule; ties go by path."""
    d, text = F.col("duration"), F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    far, inside = F.abs(d - target), F.abs(d - target) <= tolerance
    tier = F.when(d.isNotNull() & text, 0).when(d.isNotNull(), 1).when(text, 2).otherwise(3)
    rules = {
        "closest": [far.asc_nulls_last()],
        "known_first": [tier, far.asc_nulls_last()],
        "in_tolerance": [F.when(inside, 0).otherwise(1), far.asc_nulls_last()],
        "first_in_tolerance": [F.when(inside, F.lit(0.0)).otherwise(far).asc_nulls_last()],
    }
    return [*rules[rule], F.col("path")]


def best_clip(clips: DataFrame, rule: str = "closest", target: float = 10.0, tolerance: float = 5.0) -> DataFrame:
    """One clip a speaker: closest to the target; known duration and text first; in tolerance first; or the first path in tolerance, and the closest where none is."""
    order = Window.partitionBy("speaker").orderBy(*rank_rule(rule, target, tolerance))
    return clips.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def dedup_pool(pool: DataFrame, sources: list[str]) -> DataFrame:
    """The first row of an id, by the order of sources, then path."""
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    order = Window.partitionBy("id").orderBy(F.when(rank > 0, rank).otherwise(len(sources) + 1), "source", "ref_path")
    return pool.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pool_summary(pool: DataFrame, by: list[str]) -> DataFrame:
    """Counts and durations in all and by each attribute alone: attribute (null: all), value.  The pool is read once."""
    measures = [F.count(F.lit(1)).alias("n"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"), F.avg("duration").alias("mean")]
    known = pool.select("duration", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by))
    sets = known.groupingSets([*([known[c]] for c in by), []], *(known[c] for c in by)).agg(*measures)
    attribute = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in by))
    return sets.select(attribute.alias("attribute"), F.coalesce(*by).alias("value"), "n", "shortest", "longest", "mean")


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """O3: the k commonest values, ties by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def transcripts_with_fallback(first: DataFrame, second: DataFrame, key: str = "call_id") -> DataFrame:
    """The first format's rows of a call, else the second's."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
